"""Pairs of edges that meet in a node, carried as lists of ends: a pair then costs a shuffle the 8 bytes of one end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ends in a list at most: a node of more has several lists.
CHUNK = 1024
#: Pairs that a task takes apart, about.
PAIRS = 1 << 21


def lists(edges: DataFrame, key: str, end: str) -> DataFrame:
    """(at, ends): for each value of ``key`` its values of ``end``, in lists of at most ``CHUNK``."""
    rank = F.row_number().over(Window.partitionBy("at").orderBy("_e"))
    rows = edges.select(F.col(key).alias("at"), F.col(end).alias("_e")).withColumn("_c", F.floor((rank - 1) / CHUNK))
    return rows.groupBy("at", "_c").agg(F.collect_list("_e").alias("ends")).drop("_c")


def tasks(edges: DataFrame, into: str, out: str) -> int:
    """How many tasks are needed for the pairs of ``edges``, one of which has as ``into`` what the other has as ``out``."""
    x, y = (edges.groupBy(F.col(c).alias("at")).agg(F.count(F.lit(1)).alias(n)) for c, n in ((into, "n"), (out, "m")))
    total = x.join(y.hint("merge"), "at").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    return max(edges.sparkSession.sparkContext.defaultParallelism, -(-total // PAIRS))


def across(edges: DataFrame, by: str, held: DataFrame) -> DataFrame:
    """``edges`` with the lists ``held`` of the node ``by``, as ``ends``."""
    return edges.join(held.withColumnRenamed("at", by).hint("merge"), by)


def above(rows: DataFrame, bound: str) -> DataFrame:
    """``rows`` with those of their ``ends`` above their ``bound``, if there are any."""
    return rows.withColumn("ends", F.filter("ends", lambda x: x > F.col(bound))).where(F.size("ends") > 0)
