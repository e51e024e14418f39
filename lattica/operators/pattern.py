"""Pattern matching over a graph: hops, optional and absent patterns, shared neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.graph import Graph


def prefixed(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(*(F.col(c).alias(f"{name}_{c}") for c in nodes.columns))


def hop(g: Graph, left: DataFrame, on: str, rel: str | list[str], label: str | None, name: str, direction: str = "out") -> DataFrame:
    """``left`` joined along edges of ``rel`` from its uid column ``on``; the other end's columns get ``name`` in front.

    Two equi-joins; without a label only the other end's uid comes along.
    """
    ends = ("src", "dst") if direction == "out" else ("dst", "src")
    edges = g.rel(*([rel] if isinstance(rel, str) else rel)).select(F.col(ends[0]).alias("_from"), F.col(ends[1]).alias(f"{name}_uid"))
    out = left.join(edges, F.col(on) == F.col("_from")).drop("_from")
    return out if label is None else out.join(prefixed(g.label(label), name), f"{name}_uid")


def absent(left: DataFrame, on: str, edges: DataFrame, end: str) -> DataFrame:
    """Rows of ``left`` whose uid is at no ``end`` of ``edges``: NOT (a)-[:T]->()."""
    return left.join(edges.select(F.col(end).alias("_end")), F.col(on) == F.col("_end"), "left_anti")


def present(left: DataFrame, on: str, edges: DataFrame, end: str) -> DataFrame:
    return left.join(edges.select(F.col(end).alias("_end")), F.col(on) == F.col("_end"), "left_semi")


def counted(left: DataFrame, on: str, edges: DataFrame, end: str, name: str, what=None) -> DataFrame:
    """``left`` with how many edges (or an aggregate ``what``) it has at ``end``; 0 for none. Aggregated before the join, so
    several branches don't multiply."""
    per = edges.groupBy(F.col(end).alias("_end")).agg((F.count(F.lit(1)) if what is None else what).alias(name))
    return left.join(per, F.col(on) == F.col("_end"), "left").drop("_end").withColumn(name, F.coalesce(name, F.lit(0)))


def first_of(df: DataFrame, keys: list[str], order: list, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= k).drop("_k")
