"""Hierarchical addresses of files and declarations: a file's part, its top-level declaration's, a member's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.identity import segment

#: The prefix of all addresses: a private range, and the project's number.
PREFIX = "fd00:0001"


def address(*parts: Column) -> Column:
    """The prefix, up to six groups, and zeros."""
    return F.concat_ws(":", F.lit(PREFIX), *parts, *[F.lit("0000")] * (6 - len(parts)))


def containment(nodes: DataFrame) -> DataFrame:
    """``nodes`` (uid, file, startLine, endLine) with ``owner``: the top-level declaration about each, null for one itself.

    A declaration is nested if a larger span of its file holds its own; equal spans don't hold each other. By one sweep
    over the spans of a file in order, so a file of very many declarations makes no pairs. Of several top-level spans
    that hold a node the last counts, of equal ones the smallest uid. Nodes without lines are left out.
    """
    spans = nodes.where("startLine IS NOT NULL AND endLine IS NOT NULL").groupBy("file", "startLine", "endLine").agg(F.min("uid").alias("first"))
    along = Window.partitionBy("file").orderBy("startLine", F.desc("endLine"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("nested", F.coalesce(F.max("endLine").over(before) >= F.col("endLine"), F.lit(False)))
    spans = spans.withColumn("owner", F.when(F.col("nested"), F.last(F.when(~F.col("nested"), F.col("first")), ignorenulls=True).over(before))).drop("nested", "first")
    a, b = nodes.alias("a"), spans.alias("b")
    same = F.col("a.file").eqNullSafe(F.col("b.file")) & (F.col("a.startLine") == F.col("b.startLine")) & (F.col("a.endLine") == F.col("b.endLine"))
    return a.join(b, same).select("a.*", "b.owner")


def addresses(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(uid, ipv6, mask) of files (uid, path) and of declarations in them (uid, file, startLine, endLine).

    48 bits for a file, 64 for a top-level declaration, 80 for one inside it.
    """
    home = files.select(F.col("path").alias("file"), segment(F.col("uid")).alias("site"))
    inside = containment(nodes).join(home, "file")
    own = segment(F.col("uid"))
    held = inside.select("uid", F.when(F.col("owner").isNull(), address(F.col("site"), own)).otherwise(address(F.col("site"), segment(F.col("owner")), own)).alias("ipv6"), F.when(F.col("owner").isNull(), 64).otherwise(80).alias("mask"))
    return files.select("uid", address(segment(F.col("uid"))).alias("ipv6"), F.lit(48).alias("mask")).unionByName(held)


def overview(nodes: DataFrame) -> DataFrame:
    """Addresses by label and mask."""
    return nodes.where("ipv6 IS NOT NULL").groupBy(F.col("label").alias("type"), "mask").agg(F.count(F.lit(1)).alias("count"))


def file_subnets(nodes: DataFrame, contains: DataFrame) -> DataFrame:
    """Files with their subnet and how many addressed nodes they hold; files that hold none are left out."""
    held = contains.join(nodes.where("ipv6 IS NOT NULL").select(F.col("uid").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("uid")).agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.where("label = 'File'").join(held, "uid").select("file", F.col("ipv6").alias("subnet"), "nodes")


def hierarchy(nodes: DataFrame, contains: DataFrame, part: str) -> DataFrame:
    """Files whose path holds ``part``, with what they contain."""
    f = nodes.where((F.col("label") == "File") & F.contains("file", F.lit(part))).select(F.col("uid").alias("src"), "file", F.col("ipv6").alias("fileAddr"))
    inner = contains.join(nodes.where("ipv6 IS NOT NULL").select(F.col("uid").alias("dst"), F.col("name").alias("node"), F.col("label").alias("type"), F.col("ipv6").alias("nodeAddr"), "mask", "line"), "dst")
    return f.join(inner, "src", "left").select("file", "fileAddr", "node", "type", "nodeAddr", "mask", "line")


def lookup(nodes: DataFrame, ipv6: str) -> DataFrame:
    return nodes.where(F.col("ipv6") == ipv6).select("name", F.col("label").alias("type"), "file", "uid", "ipv6", "mask")


def subnet_members(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.where(F.startswith("ipv6", F.lit(prefix))).select("name", F.col("label").alias("type"), "uid", "ipv6", "mask", "line")


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where((F.col("name") == name) & F.col("ipv6").isNotNull()).select("name", F.col("label").alias("type"), "file", "uid", "ipv6", "mask")
