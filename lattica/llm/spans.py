"""Spans of regular expressions in code points, by SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A kind of span: its name, its expression (Java), and a cheaper condition on the text that every match implies.
Kind = tuple[str, str, Column | None]


def _row(kind: int, context: int, marks: dict[str, str]):
    def row(x: Column, i: Column) -> Column:
        counts = [F.regexp_count(x["gap"], F.lit(pattern)).alias(name) for name, pattern in marks.items()]
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.right(x["gap"], F.lit(context)).alias("before"), x["match"].alias("match"), *counts)

    return row


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def _matches(kinds: list[Kind], text: Column, context: int, marks: dict[str, str]) -> Column:
    """An array of all matches: kind, number within its kind, code points since the last one, text before, text, marks since."""
    found = []
    none = "array<struct<kind:int,i:int,gap:int,before:string,match:string" + "".join(f",{name}:int" for name in marks) + ">>"
    for number, (_, pattern, holds) in enumerate(kinds):
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("match"))
        rows = F.transform(parts, _row(number, context, marks))
        found.append(F.when(text.rlike(pattern) if holds is None else holds, rows).otherwise(F.array().cast(none)))
    return F.concat(*found)


def spans(docs: DataFrame, kinds: list[Kind], context: int = 0, marks: dict[str, str] | None = None) -> DataFrame:
    """Leftmost non-overlapping matches of each kind: doc_id, text_hash, kind (number), start, end (exclusive), before, match.

    ``docs`` has doc_id and a text without nulls. Equal rows (same doc_id and text) give their spans once. A document's
    matches meet in one task: as many as one text holds. For each of ``marks``, a pattern whose matches lie between
    spans, a column of its name counts those before the span.
    """
    text = F.col("text")
    marks = marks or {}
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.explode(_matches(kinds, text, context, marks)).alias("m")).select("doc_id", "text_hash", "m.*")
    rows = rows.repartition("doc_id", "text_hash").dropDuplicates(["doc_id", "text_hash", "kind", "i"])
    along = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(along)
    return rows.withColumns({"end": end} | {name: F.sum(name).over(along) for name in marks}).withColumn("start", F.col("end") - F.length("match")).drop("i", "gap")


def listing(rows: Column) -> Column:
    """``kind:start:end`` of an array of structs with those fields, in its order, comma-joined."""
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, found: DataFrame, base: list[str], by_start: bool) -> DataFrame:
    """Per row of ``docs``: counts of the base kinds, the digest of their listing, and the listing of all spans.

    ``found``: doc_id, text_hash, kind, name, start, end. Rows without spans, null and empty texts, get zeros and empty
    listings; repeated rows get the same, a row each; a null doc_id stays null; spans that begin together are listed by
    kind, then end.
    """
    order = ("start", "kind", "end") if by_start else ("kind", "start", "end")
    every = F.array_sort(F.collect_list(F.struct(*order, "name")))
    per = found.groupBy("doc_id", "text_hash").agg(every.alias("every"))
    keep = F.filter("every", lambda s: s["kind"] < len(base))
    counts = [F.size(F.filter("every", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(base)]
    per = per.select("doc_id", "text_hash", *counts, F.sha2(listing(keep), 256).alias("base_sha256"), listing(F.col("every")).alias("spans"))
    keys = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).alias("d")
    per = per.alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash"))
    none = {**{f"n_{name}": F.lit(0).cast("long") for name in base}, "base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")}
    return keys.join(per, same, "left").select("d.doc_id", *(F.coalesce(F.col(f"p.{k}"), v).alias(k) for k, v in none.items()))
