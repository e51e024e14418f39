"""Read views of a graph: a node's surroundings, trees of calls, tasks with what they touch, waves, leases, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators import traverse
from lattica.scratch import written

CALLS = "CALLS"


def expand(g: Graph, uid: str, rel: str = CALLS) -> DataFrame:
    """(direction, uid, name, file): what a function calls and what calls it."""
    e, f = g.rel(rel), g.label("Function").select("uid", "name", "file")
    out = e.where(F.col("src") == uid).select(F.lit("child").alias("direction"), F.col("dst").alias("uid"))
    back = e.where(F.col("dst") == uid).select(F.lit("parent").alias("direction"), F.col("src").alias("uid"))
    return out.unionAll(back).distinct().join(f, "uid").select("direction", "uid", "name", "file")


def call_tree(g: Graph, uid: str, max_hops: int = 6, direction: str = "out", rel: str = CALLS) -> DataFrame:
    """(node, dist, child): functions within ``max_hops`` of one, and the calls among them that lead further."""
    seed = g.label("Function").where(F.col("uid") == uid).select("uid")
    near = written(traverse.reach(g, seed, [rel], max_hops, direction).select("node", "dist"))
    ends = ("src", "dst") if direction == "out" else ("dst", "src")
    steps = g.rel(rel).where("src <> dst").select(F.col(ends[0]).alias("node"), F.col(ends[1]).alias("child")).distinct()
    known = steps.join(near.select(F.col("node").alias("child")), "child", "left_semi")
    return near.join(known, "node", "left").select("node", "dist", "child")


def relation_summary(g: Graph, uid: str, types: list[str] | None = None) -> DataFrame:
    """(rel_type, incoming, outgoing) of a node, most edges first, then by type."""
    e = g.edges(types)
    n = lambda end: F.count(F.when(F.col(end) == uid, 1))
    per = e.where((F.col("src") == uid) | (F.col("dst") == uid)).groupBy("rel_type").agg(n("dst").alias("incoming"), n("src").alias("outgoing"))
    return per.orderBy(F.desc(F.col("incoming") + F.col("outgoing")), "rel_type")


def graph_stats(g: Graph, labels: list[str], types: list[str]) -> DataFrame:
    """One row: nodes, edges, files."""
    nodes = g.nodes(labels).agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.col("label") == "File", 1)).alias("files"))
    return nodes.join(F.broadcast(g.edges(types).agg(F.count(F.lit(1)).alias("edges"))), F.lit(True))  # a row each


def call_context(g: Graph, functions: DataFrame, rel: str = CALLS) -> DataFrame:
    """(uid, callers, callees): names on either side of each function (column uid), each side aggregated by itself."""
    name = g.label("Function").select(F.col("uid").alias("other"), F.col("name").alias("said"))
    out = functions.select("uid").distinct()
    for side, (own, other) in {"callers": ("dst", "src"), "callees": ("src", "dst")}.items():
        e = g.rel(rel).select(F.col(own).alias("uid"), F.col(other).alias("other")).join(out.select("uid"), "uid", "left_semi").join(name, "other")
        out = out.join(e.groupBy("uid").agg(F.array_join(F.array_sort(F.collect_set("said")), ",").alias(side)), "uid", "left").withColumn(side, F.coalesce(side, F.lit("")))
    return out


def task_context(tasks: DataFrame, affects: DataFrame, nodes: DataFrame) -> DataFrame:
    """(uid, status, nodes): each task with the nodes it affects as structs of uid and name, in order; empty for none."""
    held = affects.select(F.col("src").alias("task"), F.col("dst").alias("uid")).distinct().join(nodes.select("uid", "name"), "uid")
    per = held.groupBy(F.col("task").alias("uid")).agg(F.array_sort(F.collect_list(F.struct("uid", "name"))).alias("nodes"))
    return tasks.join(per, "uid", "left").select("uid", "status", F.coalesce("nodes", F.array().cast("array<struct<uid:string,name:string>>")).alias("nodes"))


def wave_status(waves: DataFrame, tasks: DataFrame) -> DataFrame:
    """(wave, total, done, in_review, open, passed): a wave's gate is passed when all its tasks are done or in review."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    per = waves.join(tasks.select("uid", "status"), "uid").groupBy("wave").agg(F.count(F.lit(1)).alias("total"), n("done").alias("done"), n("review").alias("in_review"))
    return per.select("wave", "total", "done", "in_review", (F.col("total") - F.col("done") - F.col("in_review")).alias("open"), (F.col("total") == F.col("done") + F.col("in_review")).alias("passed"))


def epic_sequence(tasks: DataFrame, epic: str, order: list[str] | None = None) -> DataFrame:
    """(epic, uid, place): tasks of each epic from 1, by the columns of their stored order, then uid."""
    along = Window.partitionBy(epic).orderBy(*(order or []), "uid")
    return tasks.select(F.col(epic).alias("epic"), "uid", F.row_number().over(along).cast("long").alias("place"))


def locked_nodes(g: Graph, nodes: DataFrame, rel: str = CALLS) -> DataFrame:
    """(uid, callers, callees, reads, writes, returns) of nodes (column uid): names around each, in order, by commas.

    Each side is aggregated by itself, so sides don't multiply; types that the graph lacks give empty text.
    """
    out = call_context(g, nodes, rel)
    for side, kind, label in (("reads", "READS_STATE", "State"), ("writes", "WRITES_STATE", "State"), ("returns", "RETURNS", "ReturnValue")):
        if kind not in g.types or label not in g.labels:
            out = out.withColumn(side, F.lit(""))
            continue
        said = g.label(label).select(F.col("uid").alias("dst"), F.col("name").alias("said"))
        e = g.rel(kind).select(F.col("src").alias("uid"), "dst").join(out.select("uid"), "uid", "left_semi").join(said, "dst")
        out = out.join(e.groupBy("uid").agg(F.array_join(F.array_sort(F.collect_set("said")), ",").alias(side)), "uid", "left").withColumn(side, F.coalesce(side, F.lit("")))
    return out


def lock_summary(leases: DataFrame, now: int) -> DataFrame:
    """(owner, live, expired) leases (owner, lockExpires)."""
    live = F.col("lockExpires") > now
    return leases.groupBy("owner").agg(F.count(F.when(live, 1)).alias("live"), F.count(F.when(~live, 1)).alias("expired"))
