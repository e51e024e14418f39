"""Elements and literals extracted from texts, JVM-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def number_literals(texts: DataFrame, key: str, text: str, file: str) -> DataFrame:
    """Number literals as nodes (uid, value, file, startLine: their place among a text's numbers): digits with an optional fraction, not inside a word."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?<![A-Za-z0-9_.])[0-9]+(?:[.][0-9]+)?(?![A-Za-z0-9_.])"), F.lit(0))
    return texts.select(F.col(key).alias("k"), F.col(file).alias("file"), F.posexplode(found).alias("n", "value")).select(F.concat_ws(":", F.lit("ASTNode"), "k", "n").alias("uid"), "value", "file", F.col("n").cast("long").alias("startLine"))


def start_tags(pages: DataFrame) -> DataFrame:
    """Start tags of pages by kind: (page_id, tagName, n)."""
    tags = F.transform(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), lambda t: F.lower(t))
    return pages.select("page_id", F.explode(tags).alias("tagName")).groupBy("page_id", "tagName").agg(F.count(F.lit(1)).alias("n"))


def elements(pages: DataFrame, label: str) -> DataFrame:
    """Each start tag of a page as a node: (uid, tagName, testId, file, startLine: its place among them)."""
    tags = F.transform(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), lambda t: F.lower(t))
    each = pages.select("page_id", "url", F.posexplode(tags).alias("n", "tagName"))
    return each.select(F.concat_ws(":", F.lit(label), "page_id", "n").alias("uid"), "tagName", F.lit(None).cast("string").alias("testId"), F.col("url").alias("file"), F.col("n").cast("long").alias("startLine"))
