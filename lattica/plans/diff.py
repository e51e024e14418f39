"""Differences of two snapshots of a graph, by natural keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.identity import occurrence_key


def snapshot_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes (label, name, file, startLine, endLine, signature, bodySnippet) with their key; nameless ones are dropped.

    Nodes of one label, name and file are told apart by their order of lines.
    """
    place = F.row_number().over(Window.partitionBy("label", "name", "file").orderBy("startLine", "endLine", "signature")) - 1
    return nodes.where("name IS NOT NULL").withColumn("key", occurrence_key(F.col("label"), F.col("name"), F.col("file"), place))


def node_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(key, label, name, file, status, reasons): added, removed or changed in signature, body or span; a mere move of
    lines is no change."""
    cols = ["label", "name", "file", "signature", "bodySnippet"]
    span = (F.col("endLine") - F.col("startLine")).alias("span")
    a, b = base.select("key", *cols, span).alias("a"), head.select("key", *cols, span).alias("b")
    both = a.join(b, F.col("a.key") == F.col("b.key"), "full")
    differs = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in ("signature", "bodySnippet", "span")]
    status = F.when(F.col("a.key").isNull(), "added").when(F.col("b.key").isNull(), "removed").otherwise("changed")
    reasons = F.when(F.col("a.key").isNull() | F.col("b.key").isNull(), "").otherwise(F.concat_ws(",", *differs))
    out = both.select(F.coalesce("a.key", "b.key").alias("key"), *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in cols[:3]), status.alias("status"), reasons.alias("reasons"))
    return out.where("status <> 'changed' OR reasons <> ''")


def edge_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(rel_type, src, dst, status) of edges that only one side has."""
    keys = ["rel_type", "src", "dst"]
    a, b = base.select(keys).distinct(), head.select(keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("status", F.lit("added")).unionByName(a.join(b, keys, "left_anti").withColumn("status", F.lit("removed")))


def file_diff(nodes: DataFrame) -> DataFrame:
    """Changed nodes by file and status."""
    return nodes.groupBy("file").agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("added", "removed", "changed")))


def blast_radius(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, reasons, n): nodes not changed themselves with gained or lost edges."""
    ends = edges.select(F.col("src").alias("key"), F.concat(F.when(F.col("status") == "added", "gained").otherwise("lost"), F.lit("-out")).alias("reason")).unionAll(edges.select(F.col("dst").alias("key"), F.concat(F.when(F.col("status") == "added", "gained").otherwise("lost"), F.lit("-in")).alias("reason")))
    ends = ends.join(nodes.select("key"), "key", "left_anti")
    return ends.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.count(F.lit(1)).alias("n"))
