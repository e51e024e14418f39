"""Joins of line ranges: which spans an edit touches, and the innermost span about a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.scratch import written

#: Rows that a task sorts, about: a larger input has more tasks, not larger ones.
ROWS = 1 << 20


def _level(start: Column, end: Column) -> Column:
    """The size of bucket of a range: the least power of two that is no shorter than it, as its exponent."""
    return F.ceil(F.log2((end - start + 1).cast("double"))).cast("int")


def _dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in tasks of about ``ROWS`` of ``rows``, where the session's number of tasks is too small for that."""
    parts = -(-rows // ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _bucketed(ranges: DataFrame, levels: list[int], name: str) -> DataFrame:
    """A row for each bucket that a range lies in, at its own level and all coarser ones of ``levels``: at most two each."""
    own = _level(F.col("start"), F.col("end"))
    sizes = F.array(*(F.struct(F.lit(x).alias("level"), F.lit(1 << x).cast("long").alias("lines")) for x in levels))
    rows = ranges.select("*", own.alias(f"{name}_own"), F.explode(F.filter(sizes, lambda x: x["level"] >= own)).alias("_size"))
    rows = rows.withColumn("level", F.col("_size.level"))
    size = F.col("_size.lines")
    first, last = F.floor(F.col("start") / size).cast("long"), F.floor(F.col("end") / size).cast("long")
    return rows.withColumn(f"{name}_first", first).withColumn("bucket", F.explode(F.sequence(first, last))).drop("_size")


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of ranges (``key``, start, end: whole numbers, both ends included, and further columns) that share a line.

    Columns of ``right`` but the key come with ``other_`` in front. Each range lies in one or two buckets of its own size;
    a pair meets in buckets of the larger one's size, in the first that both lie in, so it comes out once, and neither
    long ranges nor a key with a third of all rows make a large group unless their ranges do overlap there. Ranges with a
    null or an end before the start touch nothing.
    """
    sound = lambda df: df.where(F.col(key).isNotNull() & (F.col("start") <= F.col("end")))
    left, right = sound(left), sound(right.select(key, *(F.col(c).alias(c if c in ("start", "end") else f"other_{c}") for c in right.columns if c != key)))
    sizes = left.select(_level(F.col("start"), F.col("end")).alias("x")).union(right.select(_level(F.col("start"), F.col("end"))))
    held = sorted((r.x, r.n) for r in sizes.groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect())  # at most 63
    levels = [x for x, _ in held] or [0]
    rows = sum(n * (2 if x else 1) * (len(held) - k) for k, (x, n) in enumerate(held))
    a = _dealt(_bucketed(left, levels, "_l"), rows, key, "level", "bucket")
    b = _dealt(_bucketed(right, levels, "_r").withColumnsRenamed({"start": "other_start", "end": "other_end"}), rows, key, "level", "bucket")
    met = a.join(b, [key, "level", "bucket"])
    once = (F.greatest("_l_own", "_r_own") == F.col("level")) & (F.greatest("_l_first", "_r_first") == F.col("bucket"))
    touch = (F.col("start") <= F.col("other_end")) & (F.col("other_start") <= F.col("end"))
    return met.where(once & touch).drop("level", "bucket", "_l_own", "_r_own", "_l_first", "_r_first")


def innermost(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """``points`` (``key``, line, ...) with ``inner``: the uid of the shortest of ``spans`` (``key``, start, end, uid) that
    holds the line; of equally short ones the last to begin, then the smallest uid; null where none does.

    Distinct lines alone are joined, and reduced to one span each before they meet the points again. Points are read three times.
    """
    rows = points.count()
    lines = points.select(key, F.col("line").alias("start"), F.col("line").alias("end")).distinct()
    pairs = overlapping(lines, spans.select(key, "start", "end", "uid"), key)
    rank = F.struct((F.col("other_end") - F.col("other_start")).alias("size"), (-F.col("other_start")).alias("start"), F.col("other_uid").alias("uid"))
    pairs = _dealt(pairs.select(key, F.col("start").alias("line"), rank.alias("rank")), rows, key, "line")
    best = pairs.groupBy(key, "line").agg(F.min("rank").alias("best")).select(key, "line", F.col("best.uid").alias("inner"))
    return _dealt(points, rows, key, "line").join(best, [key, "line"], "left")


def nested(spans: DataFrame, key: str) -> DataFrame:
    """``spans`` (``key``, start, end, uid) with ``parent``: the innermost larger span of the same key about each.

    The parent is the shortest span that holds both ends and is longer; of equally short ones the last to begin, then the
    smallest uid; null at the top. Spans that cross are no parents of each other.
    """
    sides = spans.select(key, "start", "end", "uid")
    # a span that holds another holds its first line: these alone are joined
    first = sides.select(key, F.col("start").alias("start"), F.col("start").alias("end"), F.col("end").alias("last"), "uid")
    pairs = overlapping(first, sides, key).where("other_end >= last AND other_end - other_start > last - start")
    rank = F.struct((F.col("other_end") - F.col("other_start")).alias("size"), (-F.col("other_start")).alias("start"), F.col("other_uid").alias("uid"))
    best = pairs.groupBy("uid").agg(F.min(rank).alias("best")).select("uid", F.col("best.uid").alias("parent"))
    return spans.join(best, "uid", "left")


def touches(edits: DataFrame, spans: DataFrame) -> DataFrame:
    """(task, uid, file, at, firstAt, edits, lines): spans that a task's edits touched.

    ``edits``: task, file, start, end, at; ``spans``: uid, file, start, end. ``at`` and ``firstAt`` are the last and first
    time, ``edits`` how many, ``lines`` how many lines of the span all of them covered, a line as often as it was edited.
    Equal edits of a task are joined once, with their number.
    """
    same = edits.groupBy("task", "file", "start", "end").agg(F.max("at").alias("at"), F.min("at").alias("firstAt"), F.count(F.lit(1)).alias("n"))
    # ranges alone are joined: a range that many tasks edited meets the spans once
    ranges = written(same.select("file", "start", "end").distinct())
    pairs = overlapping(ranges, spans.select("file", "start", "end", "uid"), "file")
    pairs = pairs.withColumn("shared", F.least("end", "other_end") - F.greatest("start", "other_start") + 1)
    met = same.join(pairs.select("file", "start", "end", F.col("other_uid").alias("uid"), "shared"), ["file", "start", "end"])
    return met.groupBy("task", "uid", "file").agg(F.max("at").alias("at"), F.min("firstAt").alias("firstAt"), F.sum("n").alias("edits"), F.sum(F.col("n") * F.col("shared")).alias("lines"))
