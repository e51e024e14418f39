"""Fill-in-the-middle: texts cut at unit boundaries into prefix, middle and suffix, and put together in a new order.

A unit grammar is given by the character classes that meet at a boundary; it becomes one zero-width regular expression
(a class behind, a class ahead), at which ``split`` cuts without losing a character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: For each grammar, the classes that stand before and behind a boundary.
GRAMMARS = {
    "tokens": [(r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]")],  # white space and what follows it, up to the next
    "lines": [(r"\n", r"[\s\S]")],
    "words": [(r"[A-Za-z0-9_]", r"[^A-Za-z0-9_]"), (r"[^A-Za-z0-9_]", r"[\s\S]")],  # words, and each other character
    "characters": [(r"[\s\S]", r"[\s\S]")],
}
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Code points that are split at once: only so much of a text is held as single units.
BLOCK = 1 << 20


def boundary(grammar: list[tuple[str, str]]) -> str:
    """The expression that matches between two neighbours of the given classes, and nothing of them."""
    return "|".join(f"(?<={behind})(?={ahead})" for behind, ahead in grammar)


def _block(text: Column, i: Column, size: int) -> Column:
    """Block ``i`` of a text, with the character before it: every boundary lies inside exactly one."""
    return F.substring(text, F.when(i == 0, 1).otherwise(i * size), F.when(i == 0, size).otherwise(size + 1))


def _units(text: Column, i: Column, pattern: str, size: int) -> Column:
    return F.split(_block(text, i, size), pattern, -1)


def _cut(text: Column, length: Column, before: Column, n: Column, units: Column, pattern: str, size: int) -> Column:
    """Code points of the first ``units`` of ``n`` units; ``before``: boundaries before each block."""
    i = (F.size(F.filter(before, lambda b: b < units)) - 1).cast("int")
    rest = (units - F.element_at(before, i + 1)).cast("int")
    ahead = F.length(F.array_join(F.slice(_units(text, i, pattern, size), F.lit(1), rest), ""))
    inside = F.when(i == 0, 0).otherwise(i * size - 1) + ahead
    return F.when(units == 0, 0).when(units >= n, length).otherwise(inside).cast("long")


def transform(docs: DataFrame, unit: str = "tokens", seed: int = 42, rate: int = 50, spm: int = 80, marks: tuple[str, str, str] = MARKS, block: int = BLOCK) -> DataFrame:
    """doc_id, text, n (units), form, prefix_chars, middle_chars, output, for every row.

    Of the texts that are neither empty nor hold a mark, ``rate`` percent are cut at two units drawn from the hash of
    ``seed`` and doc_id; of these ``spm`` percent come as suffix, prefix, middle (spm), the others as prefix, suffix, middle
    (psm). All else is ``plain``: the text as it is, without character counts. A null text is empty and has no units; a
    null doc_id is hashed as nothing; rows with the same doc_id and text give the same; long texts are split a million
    code points at a time; further columns aren't read. Rows stay where they are: nothing is shuffled but small inputs.
    """
    pattern, text, length = boundary(GRAMMARS[unit]), F.col("text"), F.length("text")
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(length / block).cast("int") - 1))
    counts = F.transform(blocks, lambda i: F.size(_units(text, i, pattern, block)) - 1)
    before = F.aggregate(counts, F.array(F.lit(0).cast("long")), lambda held, c: F.concat(held, F.array(F.element_at(held, -1) + c)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    rows = common.spread(common.keyed(docs)).withColumns({"before": before, "digest": digest})
    rows = rows.withColumn("n", F.when(length == 0, 0).otherwise(F.element_at("before", -1) + 1).cast("long"))
    plain = (length == 0) | (h3 % 100 >= rate)
    for mark in marks:
        plain = plain | F.contains(text, F.lit(mark))
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.withColumns({"form": F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm"), "low": F.least(a, b), "high": F.greatest(a, b)})

    def cut(units):
        return F.when(F.col("form") != "plain", _cut(text, length, F.col("before"), F.col("n"), F.col(units), pattern, block))

    rows = rows.withColumns({"prefix_chars": cut("low"), "end": cut("high")})
    first, second = F.col("prefix_chars").cast("int"), F.col("end").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, length)
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return rows.select("doc_id", "text", "n", "form", "prefix_chars", (F.col("end") - F.col("prefix_chars")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text behind an output, by its marks alone."""
    parts = F.split(output, "|".join(rf"\Q{x}\E" for x in marks), -1)
    first, second, third = (F.element_at(parts, k) for k in (2, 3, 4))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transform(common.table(spark, sf_dir, "documents"))
    hashes = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


ORACLE_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""
