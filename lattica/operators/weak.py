"""Connected components by alternating large-star and small-star steps; no node or edge reaches the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.scratch import written


def local_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and for each the smallest node it reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return nodes, nodes[label]
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (up := label[label])[...].tobytes() != label.tobytes():
            label = up


def _contract(batches):
    """A partition's edges as stars about the smallest node of each of its own components."""
    held = [batch for batch in batches if batch.num_rows]
    if held:
        a, b = (np.concatenate([np.asarray(batch.column(k)) for batch in held]) for k in ("a", "b"))
        nodes, roots = local_labels(a, b)
        leaf = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(roots[leaf])], names=["u", "v"])


#: Edges that one task contracts at most; more are contracted side by side, then joined by star steps.
TASK_EDGES = 1 << 20


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long, no nulls): root is the smallest node it reaches.

    Self-loops and repeated edges are harmless; no edges give no rows.
    """
    stars = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contract, "u long, v long").distinct())
    seen = None
    while True:
        parts = -(-stars.count() // task_edges)
        pairs = stars.select(F.col("u").alias("a"), F.col("v").alias("b")).coalesce(max(1, parts))
        stars = written(pairs.mapInArrow(_contract, "u long, v long"))
        if parts <= 1:
            break
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        stars = written(small.distinct())
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).collect()[0]
        if now == seen:
            break
        seen = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
