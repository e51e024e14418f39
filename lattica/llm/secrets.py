"""Secret scans: base patterns, and weak credential parts joined with complementary ones by the scopes that hold both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, spans

#: Code points between parts of one credential at most, where they share no object.
SCOPE = 300
#: A blank line ends a block; braces begin and end objects, which nest.
MARKS = {"block": r"\n[\x20\t\r]*+\n"}
OPEN, CLOSE = r"\{", r"\}"
BASE = ["assign", "access", "hex"]
#: The number of the kind of opening braces; closing ones are the next.
BRACES = 6
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"  # shorter ones fail, and hold no other match
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Weak parts: a run of letters and digits of mixed kinds, a named identifier, an address with a scheme.
SECRET = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,64}+={0,2}+(?![A-Za-z0-9+/=_-])"
IDENTIFIER = r"""(?i:user_?name|user_?id|client_?id|account_?id|access_?key_?id)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9@._-]{3,}+"""
ENDPOINT = r"""(?<![A-Za-z0-9+.-])[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~%:@/?&=+-]++"""


def _kinds() -> list[spans.Kind]:
    text = F.col("text")
    small = F.lower(text)

    def any_of(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(small, F.lit(w))
        return out

    return [
        ("assign", ASSIGN, any_of("passw", "secret", "token", "api")),
        ("access", ACCESS, F.contains(text, F.lit("AKIA"))),
        ("hex", HEX, None),
        ("weak_secret", SECRET, None),
        ("identifier", IDENTIFIER, any_of("user", "client", "account", "access")),
        ("endpoint", ENDPOINT, F.contains(text, F.lit("://"))),
        ("open", OPEN, F.contains(text, F.lit("{"))),
        ("close", CLOSE, F.contains(text, F.lit("{"))),
    ]


def _within_objects(found: DataFrame) -> DataFrame:
    """``found`` without braces, each span with ``object``: where the innermost braces about it open; null outside of any.

    The height at a place is the running sum of braces above its least; the last brace that opened this height is the
    one about a span there, as on a stack. An end brace that closes nothing changes nothing.
    """
    doc = ("doc_id", "text_hash")
    along = Window.partitionBy(*doc).orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == BRACES, 1).when(F.col("kind") == BRACES + 1, -1).otherwise(0)
    found = found.withColumn("sum", F.sum(step).over(along)).withColumn("height", F.col("sum") - F.least(F.lit(0), F.min("sum").over(along)))
    level = Window.partitionBy(*doc, "height").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("kind") == BRACES, F.col("start")), ignorenulls=True).over(level)
    found = found.withColumn("object", F.when(F.col("height") > 0, opened))
    return found.where(F.col("kind") < BRACES).drop("sum", "height")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """All base spans, and weak ones with complementary parts: doc_id, text_hash, kind, name, start, end.

    A weak secret (20 to 64 letters, digits and signs, of both cases and digits) counts with an access or other
    identifier; an identifier with an assignment, hex run or weak secret; an endpoint with one of each. Both parts must
    lie in one scope: directly in the same object, whatever objects stand between, or in one block without a blank line and
    at most ``scope`` code points apart. Scopes are intervals of the text, which nest; parts are joined with the innermost
    about them by a sweep in order of place, so a scope of very many parts costs no pairs. A secret that a base span covers is no part of its own.
    Null and empty texts have no spans; equal rows (same doc_id and text) give theirs once; ties in place go by kind.
    """
    kinds = _kinds()
    found = _within_objects(spans.spans(docs, kinds, marks=MARKS))
    value = F.regexp_extract("match", ASSIGN, 1)
    mixed = F.col("match").rlike("[A-Z]") & F.col("match").rlike("[a-z]") & F.col("match").rlike("[0-9]")
    found = found.where(F.when(F.col("kind") == 0, F.length(value) >= 6).when(F.col("kind") == 3, mixed).otherwise(F.lit(True)))
    doc = ("doc_id", "text_hash")
    base_before = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(Window.partitionBy(*doc).orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("covered", (F.col("kind") == 3) & F.coalesce(base_before > F.col("start"), F.lit(False))).where("NOT covered")
    parts = {"identifier": F.col("kind").isin(1, 4), "secret": F.col("kind").isin(0, 2, 3)}
    forth = Window.partitionBy(*doc, "block").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*doc, "block").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*doc, "object")
    for name, holds in parts.items():
        found = found.withColumn(f"before_{name}", F.max(F.when(holds, F.col("end"))).over(forth)).withColumn(f"after_{name}", F.min(F.when(holds, F.col("start"))).over(back))
        found = found.withColumn(f"object_{name}", F.coalesce(F.max(holds).over(within), F.lit(False)) & F.col("object").isNotNull())

    def near(name: str) -> Column:
        return F.coalesce(F.col("start") - F.col(f"before_{name}") <= scope, F.lit(False)) | F.coalesce(F.col(f"after_{name}") - F.col("end") <= scope, F.lit(False)) | F.col(f"object_{name}")

    linked = F.when(F.col("kind") < 3, True).when(F.col("kind") == 3, near("identifier")).when(F.col("kind") == 4, near("secret")).otherwise(near("identifier") & near("secret"))
    names = F.array(*(F.lit(k[0]) for k in kinds[:BRACES]))
    return found.where(linked).select("doc_id", "text_hash", "kind", F.get(names, F.col("kind")).alias("name"), "start", "end")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, a row each; nulls, ties, repeats and empty tables as in ``spans.digests``."""
    docs = common.spread(common.keyed(common.table(spark, sf_dir, "documents")))
    return spans.digests(docs, find_secrets(docs), BASE, by_start=True)
