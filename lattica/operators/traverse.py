"""Traversal by frontiers: one join and one distinct a level, cut from its lineage as it goes."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators import cycles
from lattica.operators.pattern import first_of
from lattica.scratch import written

#: Levels between written tables.
EVERY = 2


def _steps(g: Graph, rels: list[str], direction: str) -> DataFrame:
    edges = g.rel(*rels).select("src", "dst").where("src <> dst").distinct()
    if direction == "in":
        return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct() if direction == "both" else edges


def reach(g: Graph, seeds: DataFrame, rels: list[str], max_hops: int | None, direction: str = "out") -> DataFrame:
    """(origin, node, dist): nodes within ``max_hops`` (None: any number) of each seed (column uid), by their shortest
    distance; seeds at 0."""
    steps = _steps(g, rels, direction)
    seen = seeds.select(F.col("uid").alias("origin"), F.col("uid").alias("node"), F.lit(0).cast("long").alias("dist")).distinct()
    frontier = seen
    for level in count(1) if max_hops is None else range(1, max_hops + 1):
        new = frontier.join(steps, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        frontier = new.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("dist", F.lit(level).cast("long"))
        if level % EVERY == 0:
            frontier = written(frontier)
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen


def cyclic(g: Graph, rels: list[str], max_hops: int) -> DataFrame:
    """(uid): nodes on a closed walk of 2 to ``max_hops`` edges, self-loops aside."""
    return cycles.on_short(g.rel(*rels).select("src", "dst"), max_hops)


def paths(g: Graph, seeds: DataFrame, rels: list[str], max_hops: int, enough: int | None = None, direction: str = "out") -> DataFrame:
    """(origin, node, hops, path): all simple paths of 1 to ``max_hops`` edges from the seeds (column uid), along edges,
    against them or either way.

    With ``enough``, longer ones are left out once the shorter are so many: for a caller that wants the first by hops.
    """
    steps = _steps(g, rels, direction)
    front = seeds.select(F.col("uid").alias("origin"), F.col("uid").alias("node"), F.array("uid").alias("path"))
    out, found = None, 0
    for level in range(1, max_hops + 1):
        front = front.join(steps, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("origin", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        if enough or level % EVERY == 0:
            front = written(front)
        this = front.select("origin", "node", F.lit(level).cast("long").alias("hops"), "path")
        out = this if out is None else out.unionByName(this)
        if enough:
            found += front.limit(enough).count()
            if found >= enough:
                break
    return out


def routes(g: Graph, start: str, target: str, rels: list[str], max_hops: int = 8, max_paths: int = 1) -> DataFrame:
    """(hops, path): up to ``max_paths`` shortest routes, in order of their uids; none if the target is further away.

    The hop that first meets the target ends the search, so all have the least length and are simple. A node that is met
    keeps its first ``max_paths`` routes only: any other would continue to routes behind those. So a level has at most
    that many rows a node, however many routes there are.
    """
    steps = written(_steps(g, rels, "out"))
    seen = g.spark.range(1).select(F.lit(start).alias("node"))
    front = seen.select("node", F.array("node").alias("path"))
    for hops in range(1, max_hops + 1):
        new = front.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")).join(seen, "node", "left_anti")
        front = written(first_of(new, ["node"], ["path"], max_paths))
        found = front.where(F.col("node") == target)
        if not found.isEmpty():
            return found.orderBy("path").limit(max_paths).select(F.lit(hops).cast("long").alias("hops"), "path")
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front.select("node").distinct()))
    return front.where(F.lit(False)).select(F.lit(0).cast("long").alias("hops"), "path")


def induced(g: Graph, seeds: DataFrame, rels: list[str], hops: int = 1) -> DataFrame:
    """Edges (rel_type, src, dst) among all nodes within ``hops`` undirected steps of the seeds."""
    near = written(reach(g, seeds, rels, hops, "both").select("node").distinct())
    return g.edges(rels).join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select("rel_type", "src", "dst")


def degree(g: Graph, labels: list[str], rels: list[str]) -> DataFrame:
    """(uid, degree): edges at either end, 0 for none."""
    edges = g.edges(rels)
    ends = edges.select(F.col("src").alias("uid")).unionAll(edges.select(F.col("dst").alias("uid")))
    per = ends.groupBy("uid").agg(F.count(F.lit(1)).alias("degree"))
    return g.nodes(labels).select("uid").join(per, "uid", "left").select("uid", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def adjacency(g: Graph, labels: list[str], rels: list[str]) -> DataFrame:
    """(from_label, to_label): labels that an edge joins, in both directions, without pairs of one label."""
    label_of = g.nodes(labels).select("uid", "label")
    pairs = g.edges(rels).join(label_of.select(F.col("uid").alias("src"), F.col("label").alias("from_label")), "src").join(label_of.select(F.col("uid").alias("dst"), F.col("label").alias("to_label")), "dst").select("from_label", "to_label").distinct()
    return pairs.unionByName(pairs.select(F.col("to_label").alias("from_label"), F.col("from_label").alias("to_label"))).where("from_label <> to_label").distinct()


def waves(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """(uid, wave): topological waves of tasks (uid) by dependencies (src needs dst); a cycle raises ValueError.

    As many rounds as the longest chain is long.
    """
    needs = written(needs.where("src <> dst").select("src", "dst").distinct())
    left = written(tasks.select("uid").distinct())
    done = None
    wave = 0
    while not left.isEmpty():
        wave += 1
        open_ = needs.join(left.select(F.col("uid").alias("dst")), "dst", "left_semi")
        ready = written(left.join(open_.select(F.col("src").alias("uid")), "uid", "left_anti").withColumn("wave", F.lit(wave).cast("long")))
        if ready.isEmpty():
            raise ValueError("CYCLE: some tasks depend on each other")
        done = ready if done is None else done.unionByName(ready)
        left = written(left.join(ready, "uid", "left_anti"))
        if wave % 50 == 0:
            done = written(done)
    return tasks.select("uid", F.lit(0).cast("long").alias("wave")).where(F.lit(False)) if done is None else done


def components(edges: DataFrame) -> DataFrame:
    """(uid, root): the smallest uid that each node of ``edges`` (src, dst) reaches either way, by labels that spread and
    jump."""
    both = written(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = written(both.groupBy(F.col("src").alias("uid")).agg(F.least(F.min("dst"), F.first("src")).alias("root")))
    while True:
        near = both.join(label, F.col("dst") == F.col("uid")).groupBy("src").agg(F.min("root").alias("other"))
        new = label.join(near, F.col("uid") == F.col("src")).select("uid", F.least("root", "other").alias("root"))
        jump = new.alias("a").join(new.alias("b"), F.col("a.root") == F.col("b.uid")).select(F.col("a.uid").alias("uid"), F.col("b.root").alias("root"))
        jump = written(jump)
        same = jump.join(label.withColumnRenamed("root", "old"), "uid").where("root <> old").isEmpty()
        label = jump
        if same:
            break
    return label
