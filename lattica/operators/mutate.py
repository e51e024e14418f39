"""Changes of a graph as rewrites of its tables: new rows, keyed merges, set and removed properties, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def create(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with ``rows`` added; columns that one side lacks are null there."""
    return table.unionByName(rows, allowMissingColumns=True)


def merge_nodes(nodes: DataFrame, rows: DataFrame, on_create: dict[str, Column] | None = None) -> DataFrame:
    """``nodes`` with ``rows`` merged by uid: what a row says replaces what was there, nulls say nothing; a uid that was
    not there is created, with the values of ``on_create`` where the row has none. Of rows with one uid the greatest
    value of each column counts."""
    said = [c for c in rows.columns if c != "uid"]
    new = rows.groupBy("uid").agg(*(F.max(c).alias(c) for c in said))
    a, b = nodes.alias("a"), new.alias("b")
    joined = a.join(b, F.col("a.uid") == F.col("b.uid"), "full")
    fresh = F.col("a.uid").isNull()

    def value(c: str) -> Column:
        known = [F.col(f"b.{c}")] * (c in said) + [F.col(f"a.{c}")] * (c in nodes.columns)
        start = [F.when(fresh, on_create[c])] if on_create and c in on_create else []
        return F.coalesce(*known, *start).alias(c)

    extra = [c for c in said if c not in nodes.columns]
    return joined.select(F.coalesce("a.uid", "b.uid").alias("uid"), *(value(c) for c in [*(c for c in nodes.columns if c != "uid"), *extra]))


def merge_counters(edges: DataFrame, rows: DataFrame, count: str = "count", last: str = "lastSeen") -> DataFrame:
    """(src, dst, count, last): counters of edges with those of ``rows`` added; an edge that was not there begins with its own."""
    both = edges.select("src", "dst", count, last).unionByName(rows.select("src", "dst", count, last))
    return both.groupBy("src", "dst").agg(F.sum(count).alias(count), F.max(last).alias(last))


def set_properties(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """``table`` with ``values`` in the rows that fit; a value of null removes the property. All see the rows as they were."""
    old = {c: F.col(c) if c in table.columns else F.lit(None) for c in values}
    return table.withColumns({c: F.when(where, v).otherwise(old[c]) for c, v in values.items()})


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the uids of ``gone``, and without edges at them."""
    ids = gone.select("uid").distinct()
    left = edges.join(ids.select(F.col("uid").alias("src")), "src", "left_anti").join(ids.select(F.col("uid").alias("dst")), "dst", "left_anti")
    return nodes.join(ids, "uid", "left_anti"), left.select(edges.columns)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no end of ``edges``: shared ones that nothing needs any more."""
    ends = edges.select(F.col("src").alias("uid")).unionAll(edges.select(F.col("dst").alias("uid")))
    return nodes.join(ends, "uid", "left_anti")
