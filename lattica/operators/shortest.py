"""Shortest paths between many pairs of nodes, from both ends at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.cycles import numbers
from lattica.scratch import written


class _Side:
    """The nodes that a search from one end has reached, a level at a time, with the number of shortest paths to each."""

    def __init__(self, begins: DataFrame, steps: DataFrame):
        self.steps, self.depth, self.links = steps, 0, []
        self.front = written(begins.select(F.col("id").alias("origin"), F.col("id").alias("node"), F.lit(1).cast("long").alias("n")))
        self.seen = self.front.select("origin", "node")

    def rows(self) -> int:
        return self.front.count()

    def grow(self) -> None:
        """One level further; ``links`` keeps by which nodes each new one was reached."""
        new = self.front.join(self.steps, F.col("node") == F.col("a")).select("origin", F.col("b").alias("node"), F.col("a").alias("by"), "n")
        new = written(new.join(self.seen, ["origin", "node"], "left_anti"))
        self.links.append(new.select("origin", "node", "by"))
        self.front = written(new.groupBy("origin", "node").agg(F.sum("n").alias("n")))
        self.seen = self.seen.unionByName(self.front.select("origin", "node"))  # a union of written tables
        self.depth += 1

    def only(self, origins: DataFrame) -> None:
        """Searches that no open pair needs are given up."""
        self.front = self.front.join(origins, "origin", "left_semi")

    def paths(self, met: DataFrame, end: str, into: str) -> DataFrame:
        """``met`` with ``into``: for each shortest path from the origin in column ``end`` to ``node``, the ids along it."""
        out = met.withColumns({into: F.array("node"), "_at": F.col("node")})
        for links in reversed(self.links[: self.depth]):
            link = links.select(F.col("origin").alias("_o"), F.col("node").alias("_n"), "by")
            out = out.join(link, (F.col(end) == F.col("_o")) & (F.col("_at") == F.col("_n"))).withColumns({into: F.concat(F.array("by"), into), "_at": F.col("by")}).drop("_o", "_n", "by")
        return out.drop("_at")


def shortest(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None, listed: bool = False) -> DataFrame:
    """(start, target, hops, paths): for each distinct pair (start, target: uids) the length of its shortest paths along
    ``edges`` (src, dst) and their number; with ``listed``, (start, target, hops, path), a row for each of them.

    Pairs further apart than ``max_hops``, or not joined at all, are left out; a node and itself are 0 hops apart, one
    path. Parallel edges are one. Searches run from all starts forward and from all targets backward; each round takes
    the side with the smaller frontier one level on, and a pair is settled when its frontiers meet, so each search goes
    about half way. Paths of a settled pair all cross the level where they meet: their number is the sum of products there.
    """
    ids, steps = numbers(edges)
    asked = pairs.select("start", "target").distinct()
    same = asked.where("start = target").select("start", "target", F.lit(0).cast("long").alias("hops"), F.lit(1).cast("long").alias("paths"), F.array("start").alias("path"))
    s, t = (ids.select(F.col("uid").alias(end), F.col("id").alias(name)) for end, name in (("start", "s"), ("target", "t")))
    open_ = written(asked.where("start <> target").join(s, "start").join(t, "target").select("s", "t"))
    ahead = _Side(open_.select(F.col("s").alias("id")).distinct(), steps)
    behind = _Side(open_.select(F.col("t").alias("id")).distinct(), steps.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found, hops = None, 0
    while max_hops is None or hops < max_hops:
        a, b = ahead.rows(), behind.rows()
        if not a or not b:
            break
        (ahead if a <= b else behind).grow()
        hops += 1
        x = ahead.front.select(F.col("origin").alias("s"), "node", F.col("n").alias("n_s"))
        y = behind.front.select(F.col("origin").alias("t"), "node", F.col("n").alias("n_t"))
        met = written(open_.join(x, "s").join(y, ["t", "node"]))
        settled = written(met.groupBy("s", "t").agg(F.sum(F.col("n_s") * F.col("n_t")).alias("paths")).withColumn("hops", F.lit(hops).cast("long")))
        if settled.isEmpty():
            continue
        if listed:
            both = behind.paths(ahead.paths(met.select("s", "t", "node"), "s", "path"), "t", "rest")
            settled = written(both.select("s", "t", F.lit(hops).cast("long").alias("hops"), F.concat("path", F.slice(F.reverse("rest"), F.lit(2), F.size("rest"))).alias("ids")))
        found = settled if found is None else found.unionByName(settled)
        open_ = written(open_.join(settled, ["s", "t"], "left_anti"))
        ahead.only(open_.select(F.col("s").alias("origin")))
        behind.only(open_.select(F.col("t").alias("origin")))
    last = "path" if listed else "paths"
    if found is None:
        return same.select("start", "target", "hops", last)
    if listed:
        found = _named(found, ids)
    out = found.join(s, "s").join(t, "t").select("start", "target", "hops", last)
    return out.unionByName(same.select(out.columns))


def _named(found: DataFrame, ids: DataFrame) -> DataFrame:
    """Arrays of ids as arrays of uids."""
    each = found.select("ids").distinct().select("ids", F.posexplode("ids").alias("k", "id")).join(ids, "id")
    names = each.groupBy("ids").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "uid"))), lambda x: x["uid"]).alias("path"))
    return found.join(names, "ids").drop("ids")
