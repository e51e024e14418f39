"""Impact of a change: what depends on a node, by which paths and how surely; what is attached to that, which tests to run."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.paths import is_test_path
from lattica.graph import Graph
from lattica.operators.traverse import first_of
from lattica.scratch import written

# Evidence by which a call counts as exact, relations that are exact by structure, ranks of confidence,
# relations that an impact follows, and labels of what is attached to code.
EXACT = "uid element-id exact named-import receiver-type self-receiver same-file".split()
STRUCTURAL = "CONTAINS IMPORTS IMPORTS_SYMBOL EXPORTS_SYMBOL AFFECTS APPLIES_TO REALIZED_BY".split()
RANKS = ["unknown", "possible", "likely", "exact"]
RELATIONS = "CALLS CALLS_CONDITIONALLY PASSES_CALLBACK IMPORTS IMPORTS_SYMBOL RESOLVES_TO RENDERS READS_STATE WRITES_STATE FETCHES AWAITS CONTAINS INHERITS REALIZED_BY AFFECTS APPLIES_TO".split()
QUICK_RELATIONS = "CALLS CALLS_CONDITIONALLY PASSES_CALLBACK RENDERS AFFECTS APPLIES_TO REALIZED_BY".split()
SECTIONS = {"Test": "tests", "Task": "tasks", "Spec": "specs", "Knowledge": "knowledge"}


@dataclass(frozen=True)
class Profile:
    """How far an impact goes: ``nodes`` a seed, itself included, and ``paths`` a node."""

    direction: str
    depth: int
    nodes: int
    paths: int
    relations: tuple[str, ...]

    def __post_init__(self) -> None:
        if self.direction not in ("in", "out", "both"):
            raise ValueError("direction must be in, out or both")
        if not (0 <= self.depth <= 8 and 1 <= self.nodes <= 2000 and 1 <= self.paths <= 10):
            raise ValueError("depth goes from 0 to 8, nodes from 1 to 2000, paths from 1 to 10")


PROFILES = {
    "fast": Profile("in", 1, 100, 1, tuple(QUICK_RELATIONS)),
    "balanced": Profile("in", 2, 200, 3, tuple(RELATIONS)),
    "deep": Profile("both", 4, 1000, 5, tuple(RELATIONS)),
}


def profile_of(name: str, rels: list[str] | None = None) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"no impact profile {name}: use fast, balanced or deep")
    return replace(PROFILES[name], relations=tuple(rels)) if rels else PROFILES[name]


def edge_rank(rel: Column, resolved_by: Column, declared: Column) -> Column:
    """0 unknown to 3 exact: a declared confidence wins, then how the edge was resolved, then its type; in any case of letters."""
    said = F.coalesce(*(F.when(F.lower(declared) == name, rank) for rank, name in enumerate(RANKS)))
    found = F.when(F.lower(resolved_by).isin(EXACT), 3).when(resolved_by.isNotNull() & (resolved_by != ""), 2).when(rel.isin(STRUCTURAL), 3).otherwise(0)
    return F.coalesce(said, found)


def name_of(rank: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in RANKS)), rank)


def change_impact(g: Graph, changed: DataFrame, rels: list[str], depth: int = 2, nodes: int = 100, seeds: int | None = 50) -> DataFrame:
    """(seed, status, uid, dist, confidence): what depends on each of the changed nodes (uid, status), themselves at 0.

    At most ``seeds`` of them, the first by uid (None: all), and at most ``nodes`` a seed, nearest first, then by uid.
    """
    some = changed.select("uid", "status").orderBy("uid").limit(seeds) if seeds else changed.select("uid", "status")
    some = written(some)
    found = impact(g, some, profile=Profile("in", depth, nodes, 1, tuple(rels)))
    return found.join(some.select(F.col("uid").alias("seed"), "status"), "seed").select("seed", "status", "uid", "dist", "confidence")


def resolve_seeds(nodes: DataFrame, **wanted: str) -> DataFrame:
    """(uid) of the one node with all that is wanted: uid, or name (or title), file (or path) and label.

    None is SEED_NOT_FOUND, several are AMBIGUOUS_SEED, both a ValueError.
    """
    if not wanted:
        raise ValueError("SEED_NOT_FOUND: nothing is asked for")
    other = {"name": "title", "file": "path"}
    found = nodes
    for key, value in wanted.items():
        cols = [c for c in (key, other.get(key)) if c in nodes.columns]
        found = found.where(F.coalesce(*[(F.col(c) == value) for c in cols], F.lit(False)) if len(cols) == 1 else F.coalesce(F.col(cols[0]) == value, F.lit(False)) | F.coalesce(F.col(cols[1]) == value, F.lit(False)))
    held = [r["uid"] for r in found.select("uid").orderBy("uid").limit(2).collect()]
    if len(held) != 1:
        raise ValueError(f"AMBIGUOUS_SEED: {wanted}" if held else f"SEED_NOT_FOUND: {wanted}")
    return nodes.sparkSession.createDataFrame([(held[0],)], "uid string")


def _steps(g: Graph, profile: Profile) -> DataFrame:
    """(src, dst, rel_type, way, rank): steps that an impact may take, the surest of equal ones."""
    steps = None
    for rel in profile.relations:
        if rel not in g.types:
            continue
        e = g.rel(rel)
        text = {c: F.col(c) if c in e.columns else F.lit(None).cast("string") for c in ("resolvedBy", "confidence")}
        e = e.select("src", "dst", F.lit(rel).alias("rel_type"), edge_rank(F.lit(rel), text["resolvedBy"], text["confidence"]).alias("rank"))
        steps = e if steps is None else steps.unionByName(e)
    if steps is None:
        raise ValueError(f"the graph has none of {', '.join(profile.relations)}")
    out = steps.withColumn("way", F.lit("out"))
    back = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type", "rank", F.lit("in").alias("way"))
    steps = {"in": back, "out": out, "both": out.unionByName(back)}[profile.direction]
    return steps.where("src <> dst").groupBy("src", "dst", "rel_type", "way").agg(F.max("rank").alias("rank"))


def explore(g: Graph, seeds: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """Paths (seed, uid, dist, path, rank) to all nodes of each seed's impact, and nodes left out (seed, uid).

    A node's paths all have its least distance; the first ``profile.paths`` by their text are kept. A path is the text
    of its steps, ``from:TYPE:way:to`` joined by ``|``; its rank that of its weakest step. Nodes beyond the budget of a
    seed are left out, nearest ones stay, then those whose first path comes first.
    """
    steps = written(_steps(g, profile))
    seen = seeds.select(F.col("uid").alias("seed"), "uid").distinct()
    front = seen.select("seed", "uid", F.lit("").alias("path"), F.lit(3).alias("rank"))
    paths = front.withColumn("dist", F.lit(0).cast("long"))
    omitted = seen.where(F.lit(False))
    for level in range(1, profile.depth + 1):
        step = F.concat_ws(":", "src", "rel_type", "way", "dst")
        new = front.withColumnsRenamed({"uid": "src", "rank": "before"}).join(steps, "src")
        new = new.select("seed", F.col("dst").alias("uid"), F.when(F.col("path") == "", step).otherwise(F.concat_ws("|", "path", step)).alias("path"), F.least("before", "rank").alias("rank"))
        new = new.join(seen, ["seed", "uid"], "left_anti")
        new = written(first_of(new, ["seed", "uid"], ["path"], profile.paths))
        used = seen.groupBy("seed").agg(F.count(F.lit(1)).alias("used"))
        order = new.groupBy("seed", "uid").agg(F.min("path").alias("first")).withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("first")))
        order = written(order.join(used, "seed").withColumn("fits", F.col("n") + F.col("used") <= profile.nodes))
        omitted = omitted.unionByName(order.where("NOT fits").select("seed", "uid"))
        front = written(new.join(order.where("fits").select("seed", "uid"), ["seed", "uid"], "left_semi"))
        paths = paths.unionByName(front.withColumn("dist", F.lit(level).cast("long")))
        seen = written(seen.unionByName(order.where("fits").select("seed", "uid")))
    return written(paths), written(omitted.distinct())


def impacted(paths: DataFrame, stale: bool = False) -> DataFrame:
    """(seed, uid, dist, confidence, paths): a node's confidence is that of its best path; unknown if the graph is stale."""
    per = paths.groupBy("seed", "uid", "dist").agg(F.max("rank").alias("rank"), F.count(F.when(F.col("path") != "", 1)).alias("paths"))
    return per.select("seed", "uid", "dist", (F.lit("unknown") if stale else name_of(F.col("rank"))).alias("confidence"), "paths")


def impact(g: Graph, seeds: DataFrame, rels: list[str] | None = None, profile: str | Profile = "balanced", stale: bool = False) -> DataFrame:
    """(seed, uid, dist, confidence): nodes that a change of each seed (column uid) reaches.

    A node's distance is its shortest; its confidence is that of its best path, a path's that of its weakest edge. With
    a stale graph all is unknown. At most the profile's number of nodes a seed, nearest first, then by uid.
    """
    p = profile if isinstance(profile, Profile) else profile_of(profile, rels)
    steps = _steps(g, p).groupBy("src", "dst").agg(F.max("rank").alias("rank"))
    seen = seeds.select(F.col("uid").alias("seed"), "uid", F.lit(0).cast("long").alias("dist"), F.lit(3).alias("rank")).distinct()
    front = seen
    for level in range(1, p.depth + 1):
        new = front.select("seed", F.col("uid").alias("src"), F.col("rank").alias("path")).join(steps, "src")
        new = new.groupBy("seed", F.col("dst").alias("uid")).agg(F.max(F.least("path", "rank")).alias("rank"))
        front = new.join(seen.select("seed", "uid"), ["seed", "uid"], "left_anti").select("seed", "uid", F.lit(level).cast("long").alias("dist"), "rank")
        if level % 2 == 0:
            front = written(front)
        seen = seen.unionByName(front)
    kept = first_of(seen, ["seed"], ["dist", "uid"], p.nodes)
    return kept.select("seed", "uid", "dist", (F.lit("unknown") if stale else name_of(F.col("rank"))).alias("confidence"))


def is_test(nodes: DataFrame) -> Column:
    said = F.coalesce(F.col("isTest"), F.lit(False)) if "isTest" in nodes.columns else F.lit(False)
    kind = F.lower(F.coalesce("entryPointKind", F.lit(""))).contains("test") if "entryPointKind" in nodes.columns else F.lit(False)
    place = F.coalesce("file", "path") if "path" in nodes.columns else F.col("file")
    return said | kind | is_test_path(place)


def attachments(g: Graph, found: DataFrame, labels: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """(seed, section, uid, reasons): tests, tasks, specs and knowledge one edge away from impacted nodes (seed, uid),
    not among these themselves, with the edges that attach them, ``TYPE:uid`` in order."""
    nodes = g.nodes(labels)
    section = F.when(is_test(nodes), "tests").when(F.col("label").startswith("Spec"), "specs")
    for label, name in SECTIONS.items():
        section = section.when(F.col("label") == label, name)
    known = nodes.select("uid", section.alias("section")).where("section IS NOT NULL")
    e = g.edges(types)
    ends = e.select(F.col("src").alias("uid"), F.col("dst").alias("near"), "rel_type").unionAll(e.select(F.col("dst").alias("uid"), F.col("src").alias("near"), "rel_type"))
    held = found.select("seed", "uid").distinct()
    out = ends.join(known, "uid").join(held.withColumnRenamed("uid", "near"), "near").join(held, ["seed", "uid"], "left_anti")
    return out.groupBy("seed", "section", "uid").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "rel_type", "near"))), ",").alias("reasons"))


def selected_tests(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Impacted nodes in test files, by seed."""
    return found.join(nodes.where(is_test(nodes)).select("uid", "name", "file"), "uid").select("seed", "uid", "name", "file", "dist")


def quality(g: Graph, profile: Profile, paths: DataFrame, omitted: DataFrame, attached: DataFrame | None = None, tests: DataFrame | None = None, state: str = "current") -> DataFrame:
    """One row a seed: edges used and their confidence, what limits the result, and what it says of tests and knowledge.

    ``state``: current, stale or unknown, of the graph. Seeds that reach nothing have a row too.
    """
    rank = _steps(g, profile).select(F.concat_ws(":", "src", "rel_type", "way", "dst").alias("step"), "rank")
    used = paths.where("path <> ''").select("seed", F.explode(F.split("path", r"\|")).alias("step")).distinct().join(rank, "step")
    counts = [F.count(F.when(F.col("rank") == k, 1)).alias(name) for k, name in enumerate(RANKS)]
    per = used.groupBy("seed").agg(F.count(F.lit(1)).alias("edges"), *counts)
    left = omitted.groupBy("seed").agg(F.count(F.lit(1)).alias("omitted"))
    out = paths.select("seed").distinct().join(per, "seed", "left").join(left, "seed", "left").fillna(0)
    limits = F.array_compact(F.array(F.lit(None if state == "current" else f"graph-{state}").cast("string"), F.when(F.col("omitted") > 0, "node-limit-reached"), F.when(F.col("unknown") > 0, "unknown-edge-evidence"), F.when(F.col("possible") > 0, "multi-target-or-heuristic-evidence")))
    out = out.withColumn("limitations", F.array_join(limits, ",")).withColumn("status", F.when(F.col("limitations") == "", "eligible").otherwise("qualified"))
    incomplete = (F.col("omitted") > 0) | F.lit(state != "current")
    some = [x.select("seed") for x in (attached.where("section = 'tests'") if attached is not None else None, tests) if x is not None]
    for name, yes, no, have in (("test_selection", "selected", "none-found", some), ("knowledge_review", "review-recommended", "none-linked", [attached.where("section = 'knowledge'").select("seed")] if attached is not None else [])):
        found = None
        for x in have:
            found = x if found is None else found.unionAll(x)
        if found is None:
            out = out.withColumn("_any", F.lit(False))
        else:
            out = out.join(found.distinct().withColumn("_any", F.lit(True)), "seed", "left")
        out = out.withColumn(name, F.when(incomplete, "incomplete").when(F.coalesce("_any", F.lit(False)), yes).otherwise(no)).drop("_any")
    return out
