"""Edges added to a graph that must stay without cycles, a batch at a time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import cycles
from lattica.scratch import written

#: Components of at most so many edges and candidates are decided one by one in a task; larger ones in rounds.
SMALL = 4096


def insertable(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """``candidates`` (src, dst, place: distinct whole numbers) with ``accepted``: as if they were added to ``edges`` (src,
    dst; without cycles) one by one by ``place``, each refused that would close a cycle with those before.

    A cycle lies in one strongly connected component of the edges and all candidates, so a candidate between components
    is accepted at once, whatever becomes of the others. Within each component the first half of those undecided is
    tried: if all of it closes no cycle it is accepted, else a half of it is tried, down to one candidate, which is refused if
    it closes one. All components go side by side; a component takes some logarithm of its candidates in rounds for each
    refused one. Small components don't need rounds: each is decided in one task. Self-loops are refused.
    """
    base = written(edges.select("src", "dst").where("src <> dst").distinct())
    asked = written(candidates.select("src", "dst", F.col("place").cast("long").alias("place")))
    done = asked.where("src = dst").select("place", F.lit(False).alias("accepted"))
    open_ = asked.where("src <> dst")
    while True:
        group = written(cycles.components(base.unionByName(open_.select("src", "dst"))))
        a, b = (group.select(F.col("uid").alias(end), F.col("component").alias(name)) for end, name in (("src", "x"), ("dst", "y")))
        placed = written(open_.join(a, "src", "left").join(b, "dst", "left"))
        apart = ~F.coalesce(F.col("x") == F.col("y"), F.lit(False))
        free = written(placed.where(apart).select("src", "dst", "place"))
        done = done.unionByName(free.select("place", F.lit(True).alias("accepted")))
        base = base.unionByName(free.select("src", "dst"))
        inside = written(placed.where(~apart).select("src", "dst", "place", F.col("x").alias("component")))
        base = written(base.distinct())
        few, inside, base = _small(inside, base, group)
        done = done.unionByName(few)
        if inside.isEmpty():
            break
        inside, base, done = _round(inside, base, done, group)
        open_ = inside.select("src", "dst", "place")
    return asked.join(done, "place").select("src", "dst", "place", "accepted")


def _decide(batches):
    """(place, accepted) of components one after another: stored edges first (no place), then candidates by place."""
    last, ahead, out = None, {}, []
    for batch in batches:
        for component, src, dst, place in zip(*(batch.column(c).to_pylist() for c in ("component", "src", "dst", "place")), strict=True):
            if component != last:
                last, ahead = component, {}
            seen, todo = set(), [dst] if place is not None else []
            while todo and src not in seen:
                for x in ahead.get(todo.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            good = src not in seen
            if good:
                ahead.setdefault(src, []).append(dst)
            if place is not None:
                out.append((place, good))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([g for _, g in out], pa.bool_())], names=["place", "accepted"])
        out.clear()


def _small(inside: DataFrame, base: DataFrame, group: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions on the candidates of small components; the other candidates; and the stored edges with those accepted."""
    ends = [group.select(F.col("uid").alias(end), F.col("component").alias(f"c_{end}")) for end in ("src", "dst")]
    own = base.join(ends[0], "src").join(ends[1], "dst").where("c_src = c_dst").select("src", "dst", F.lit(None).cast("long").alias("place"), F.col("c_src").alias("component"))
    every = written(own.unionByName(inside))
    size = every.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    small = written(size.where(F.col("n") <= SMALL).select("component"))
    rows = every.join(small, "component", "left_semi").select("component", "src", "dst", "place")
    few = written(rows.repartition("component").sortWithinPartitions("component", F.col("place").asc_nulls_first()).mapInArrow(_decide, "place long, accepted boolean"))
    more = inside.join(few.where("accepted"), "place").select("src", "dst")
    return few, written(inside.join(small, "component", "left_anti")), base.unionByName(more)


def _round(inside: DataFrame, base: DataFrame, done: DataFrame, group: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """In each component, candidates up to and with the first that is refused are decided."""
    rank = F.row_number().over(Window.partitionBy("component").orderBy("place"))
    ranked = written(inside.withColumn("rank", rank))
    # within a component: so many candidates are known to close no cycle, and so many do
    state = ranked.groupBy("component").agg(F.count(F.lit(1)).alias("bad")).withColumn("good", F.lit(0).cast("long"))
    state = written(state.withColumn("bad", F.col("bad")))
    ends = [group.select(F.col("uid").alias(end), F.col("component").alias(f"c_{end}")) for end in ("src", "dst")]
    own = written(base.join(ends[0], "src").join(ends[1], "dst").where("c_src = c_dst").select("src", "dst"))
    while not state.where("bad - good > 1").isEmpty():
        tried = state.withColumn("size", F.when(F.col("bad") - F.col("good") > 1, F.expr("(good + bad) div 2")).otherwise(F.col("good")))
        some = ranked.join(tried.select("component", "size"), "component").where("rank <= size")
        found = cycles.components(own.unionByName(some.select("src", "dst"))).select("uid").distinct()
        # a component of nodes lies in one of the tried ones
        closed = group.join(found, "uid", "left_semi").select("component").distinct().withColumn("closed", F.lit(True))
        next_ = tried.join(closed, "component", "left")
        shut = F.coalesce("closed", F.lit(False))
        state = written(next_.select("component", F.when(shut, F.col("size")).otherwise(F.col("bad")).alias("bad"), F.when(shut, F.col("good")).otherwise(F.greatest("good", "size")).alias("good")))
    met = ranked.join(state, "component")
    kept = written(met.where("rank <= good").select("src", "dst", "place"))
    refused = met.where("rank = bad").select("place")
    done = done.unionByName(kept.select("place", F.lit(True).alias("accepted"))).unionByName(refused.select("place", F.lit(False).alias("accepted")))
    return written(met.where("rank > bad").select("src", "dst", "place")), base.unionByName(kept.select("src", "dst")), written(done)
