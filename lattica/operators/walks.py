"""Walks that use no edge twice: nodes may come again, self-loops and returns count, as a pattern of several hops asks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.scratch import written

#: Levels between looks at whether any walk goes on.
EVERY = 2


def numbered(g: Graph, rels: list[str], direction: str = "out") -> DataFrame:
    """(src, dst, edge): the edges to walk, each with a number; written, so that numbers stay.

    Edges of one type between the same nodes are one unless their properties differ. Either way, an edge has one number in
    both directions, and a self-loop one row.
    """
    kinds = []
    for rel in rels:
        e = g.rel(rel)
        more = [F.to_json(F.struct(*sorted(set(e.columns) - {"src", "dst"})))] if len(e.columns) > 2 else [F.lit("")]
        kinds.append(e.select("src", "dst", F.lit(rel).alias("type"), *(m.alias("more") for m in more)).distinct())
    out = written(reduce(DataFrame.unionByName, kinds).select("src", "dst", F.monotonically_increasing_id().alias("edge")))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge")
    return {"out": out, "in": back, "both": out.unionByName(back.where("src <> dst"))}[direction]


def _begin(seeds: DataFrame) -> DataFrame:
    return seeds.select(F.col("uid").alias("origin"), F.col("uid").alias("node"), F.array("uid").alias("path"), F.array().cast("array<bigint>").alias("used"))


def _onward(front: DataFrame, steps: DataFrame) -> DataFrame:
    """All walks of one edge more: one join by the node they stand on."""
    new = front.join(steps, F.col("node") == F.col("src")).where(~F.array_contains("used", F.col("edge")))
    return new.select("origin", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("used", F.array("edge")).alias("used"))


def _enough(found: list[DataFrame], enough: int | None, ends: DataFrame | None = None) -> bool:
    if enough is None:
        return False
    out = reduce(DataFrame.unionByName, found)
    if ends is not None:
        out = out.join(ends, F.col("node") == F.col("uid"), "left_semi")
    return out.limit(enough).count() >= enough


def walks(g: Graph, seeds: DataFrame, rels: list[str], low: int, high: int | None, direction: str = "out", enough: int | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(origin, node, hops, path): all walks of ``low`` to ``high`` edges from the seeds (column uid), no edge twice.

    Without ``high`` they end where all edges that lead on are used: the number of walks in a dense graph grows without
    measure, but none is left out. With ``enough``, longer ones may be left out once the shorter that end at one of ``ends``
    (column uid; without it at any node) are so many.
    """
    steps, front = numbered(g, rels, direction), _begin(seeds.select("uid").distinct())
    found, level = [], 0
    if low == 0:
        found.append(front.select("origin", "node", F.lit(0).cast("long").alias("hops"), "path"))
    while high is None or level < high:
        level += 1
        front = _onward(front, steps)
        look = high is None or enough is not None or level % EVERY == 0
        if look:
            front = written(front)
        if level >= low:
            found.append(front.select("origin", "node", F.lit(level).cast("long").alias("hops"), "path"))
        if look and (front.isEmpty() or level >= low and _enough(found, enough, ends)):
            break
    return reduce(DataFrame.unionByName, found) if found else _begin(seeds.limit(0)).select("origin", "node", F.lit(0).cast("long").alias("hops"), "path")


def closed(g: Graph, rels: list[str], low: int, high: int, direction: str = "out", origins: DataFrame | None = None, enough: int | None = None) -> DataFrame:
    """(origin, node, hops, path): walks of ``low`` to ``high`` edges that end where they begin, no edge twice.

    A walk is cut in half: its first edges go forward from the origin, its last ones backward, and the halves meet at a
    node with no edge in common. So walks of half the length are all that is ever listed. ``origins`` (column uid) limits
    where walks begin. With ``enough``, longer ones may be left out once the shorter are so many.
    """
    steps = numbered(g, rels, direction)
    back = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge")
    begin = _begin((steps.select(F.col("src").alias("uid")) if origins is None else origins.select("uid")).distinct())
    ahead, behind, found = {0: begin}, {0: begin}, []
    for hops in range(max(low, 1), high + 1):
        h, b = hops - hops // 2, hops // 2
        for half, at, along in ((ahead, h, steps), (behind, b, back)):
            for k in range(max(half) + 1, at + 1):
                half[k] = written(_onward(half[k - 1], along))
        end = behind[b].select(F.col("origin").alias("o"), F.col("node").alias("n"), F.reverse("path").alias("rest"), F.col("used").alias("others"))
        met = ahead[h].join(end, (F.col("origin") == F.col("o")) & (F.col("node") == F.col("n"))).where(~F.arrays_overlap("used", "others"))
        path = F.concat("path", F.slice("rest", 2, b + 1))
        this = met.select("origin", F.col("origin").alias("node"), F.lit(hops).cast("long").alias("hops"), path.alias("path"))
        found.append(written(this) if enough is not None else this)
        if _enough(found, enough):
            break
    if low == 0:
        found.append(begin.select("origin", "node", F.lit(0).cast("long").alias("hops"), "path"))
    return reduce(DataFrame.unionByName, found)
