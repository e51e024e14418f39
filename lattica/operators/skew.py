"""Joins of tables that may be heavy on a few keys: with one that has each key once, and of all pairs of a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with over a thousandth of all rows is heavy: there are fewer than a thousand of these.
HEAVY = 1000
#: Pairs that a task makes, about.
PAIRS = 1 << 25
#: Equal rows that one row stands for at most, so that two of them stand for 65,536 pairs.
EQUAL = 256


def lookup(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``left`` joined (inner or left) with ``right``, which has each value of the column ``on`` once.

    Rows of heavy keys stay where they are and meet a broadcast of those keys' rows, fewer than a thousand; each other key
    has at most a thousandth of all rows. Null keys meet nothing. ``left`` is read three times: write it first if it is dear.
    """
    per = left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    total = left.count()
    heavy = per.where(F.col("_n") * HEAVY > total).select(on)
    few = F.broadcast(heavy)
    hot = left.join(few, on, "left_semi").join(F.broadcast(right.join(few, on, "left_semi")), on, how)
    return hot.unionByName(left.join(few, on, "left_anti").join(right, on, how))


def _cells(side: DataFrame, keys: list[str], heavy: DataFrame, own: str, other: str) -> DataFrame:
    """``side`` with a part ``own`` of its key for each row, by the row's hash, once for each part ``other``."""
    columns = [c for c, kind in side.dtypes if "map<" not in kind and "variant" not in kind]
    parts = side.join(F.broadcast(heavy.withColumnsRenamed({f"_k{i}": f"_h{i}" for i in range(len(keys))})), reduce(Column.__and__, [F.col(c) == F.col(f"_h{i}") for i, c in enumerate(keys)]), "left")
    parts = parts.withColumn(own, F.pmod(F.xxhash64(*columns), F.coalesce("_p", F.lit(1))))
    return parts.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_p", F.lit(1)) - 1))).drop("_p", *(f"_h{i}" for i in range(len(keys))))


def counted(rows: DataFrame, times: str) -> DataFrame:
    """Equal ``rows`` as one, or one for every ``EQUAL`` of them, with their number ``times``."""
    per = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    cut = per.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / EQUAL))))
    return cut.select(*rows.columns, F.least(F.lit(EQUAL), F.col("_n") - F.col("_s") * EQUAL).alias(times), F.col("_s").alias(f"{times}_at"))


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says, without that."""
    columns = [c for c in rows.columns if c != times]
    return rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*(F.col(f"`{c}`") for c in columns))


def crossed(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], each: int | None = None, times: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """All pairs of rows of ``left`` and ``right`` that agree in ``keys``, tables without a column name in common.

    Pairs grow with the square of a key's rows while both tables stay small, so tasks go by the pairs: a key of more than
    ``each`` (``PAIRS``) is a grid of cells, rows of one side against columns of the other, and there are about as many
    tasks as ``each`` is contained in all pairs. Both tables are read twice, their keys alone at first. Null keys meet nothing.
    ``times`` are columns that say how many rows a row stands for (``counted``); a pair then stands for their product.
    """
    each = each or PAIRS
    left, right = (df.where(reduce(Column.__and__, [F.col(pair[k]).isNotNull() for pair in keys])) for k, df in enumerate((left, right)))
    names = [f"_k{i}" for i in range(len(keys))]
    x, y = (df.groupBy(*(F.col(pair[k]).alias(n) for n, pair in zip(names, keys, strict=True))).agg((F.sum(times[k]) if times[k] else F.count(F.lit(1))).alias(f"_n{k}")) for k, df in enumerate((left, right)))
    per = x.join(y, names).select(*names, (F.col("_n0") * F.col("_n1")).alias("_n"))
    total = per.agg(F.sum("_n")).first()[0] or 0
    if total <= each:
        return left.join(right, reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in keys]))
    heavy = per.where(F.col("_n") > each).select(*names, F.ceil(F.sqrt(F.col("_n") / each)).cast("long").alias("_p"))
    tasks = 2 * -(-total // each)
    a = _cells(left, [k for k, _ in keys], heavy, "_li", "_lj").repartition(tasks, *(k for k, _ in keys), "_li", "_lj")
    b = _cells(right, [k for _, k in keys], heavy, "_rj", "_ri").repartition(tasks, *(k for _, k in keys), "_ri", "_rj")
    same = [F.col(k) == F.col(m) for k, m in [*keys, ("_li", "_ri"), ("_lj", "_rj")]]
    return a.join(b.hint("merge"), reduce(Column.__and__, same)).drop("_li", "_lj", "_ri", "_rj")
