"""Obligation traces and findings over workflow nodes and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.scratch import written

# Link types followed either way, those followed back to where something comes from, labels not expanded.
OBLIGATION = ["HAS_CRITERION", "VALIDATED_BY", "VALIDATES", "IMPLEMENTED_BY", "IMPLEMENTS", "AFFECTS"]
PROVENANCE = ["HAS_REQUIREMENT", "HAS_PHASE", "DERIVES", "IMPACTS", "REFERENCES", "APPLIES_TO", "PROMOTED_TO"]
STOPS = ["Flow", "Change", "Phase", "SourceAnalysis", "Idea"]
PASSES = 3


def trace(nodes: DataFrame, links: DataFrame, seeds: DataFrame, most: int = 100) -> DataFrame:
    """(seed, uid, label): what each seed (uid) is obliged to or proven by, then where that comes from.

    Obligation links are followed both ways, not beyond a stop label, for at most ``most`` levels (ValueError if that
    isn't all); provenance links backwards, three times. ``nodes`` (uid, label), ``links`` (rel_type, src, dst). Seeds
    and ends that aren't nodes are left out.
    """
    label = nodes.select("uid", "label")
    links = links.where("src <> dst")
    duty = links.where(F.col("rel_type").isin(OBLIGATION)).select("src", "dst")
    duty = written(duty.unionByName(duty.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    back = links.where(F.col("rel_type").isin(PROVENANCE)).select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    front = seen = written(seeds.select(F.col("uid").alias("seed"), "uid").distinct().join(label, "uid"))

    def further(front: DataFrame, steps: DataFrame) -> DataFrame:
        new = front.select("seed", F.col("uid").alias("src")).join(steps, "src").select("seed", F.col("dst").alias("uid")).distinct()
        return written(new.join(seen, ["seed", "uid"], "left_anti").join(label, "uid"))

    for _ in range(most):
        front = further(front.where(~F.col("label").isin(STOPS)), duty)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    else:
        raise ValueError(f"the trace goes on beyond {most} levels")
    front = seen
    for _ in range(PASSES):
        front = further(front, back)
        seen = seen.unionByName(front)
    return seen.select("seed", "uid", "label")


def findings(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(uid, code): requirements without intended tests, test cases without an implementation, tasks without a duty.

    A requirement is fine if it, or each of its criteria (one at least), is validated by something.
    """

    def of(label: str) -> DataFrame:
        return nodes.where(F.col("label") == label).select("uid")

    def having(rel: str) -> DataFrame:
        return links.where(F.col("rel_type") == rel).select(F.col("src").alias("uid"), "dst")

    proven = having("VALIDATED_BY").select("uid").distinct()
    criteria = having("HAS_CRITERION")
    open_ = criteria.join(proven.select(F.col("uid").alias("dst")), "dst", "left_anti").select("uid")
    fine = criteria.select("uid").distinct().join(open_, "uid", "left_anti").unionByName(proven)
    parts = [("missing-test-intent", of("Requirement").join(fine, "uid", "left_anti"))]
    parts += [(code, of(label).join(having(rel), "uid", "left_anti")) for code, label, rel in (("missing-test-implementation", "TestCase", "IMPLEMENTED_BY"), ("missing-task-obligation", "Task", "IMPLEMENTS"))]
    out = None
    for code, rows in parts:
        rows = rows.select("uid", F.lit(code).alias("code"))
        out = rows if out is None else out.unionByName(rows)
    return out
