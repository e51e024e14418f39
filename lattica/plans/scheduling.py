"""Work scheduling, quality reports and leases over tasks, files and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.traverse import components

STATUS_ORDER = ["in_progress", "todo", "backlog", "review", "done"]
PRIORITY_ORDER = ["critical", "high", "medium", "low"]


def rank_of(column: str, order: list[str]):
    return F.coalesce(*(F.when(F.col(column) == x, k) for k, x in enumerate(order)), F.lit(len(order)))


def task_board(tasks: DataFrame, affects: DataFrame) -> DataFrame:
    """Tasks with how many nodes they affect. Their place is for whoever shows them: by ``rank_of`` status, priority, uid."""
    per = affects.groupBy(F.col("src").alias("uid")).agg(F.count_distinct("dst").alias("nodes"))
    return tasks.join(per, "uid", "left").select("uid", "status", "priority", F.coalesce("nodes", F.lit(0)).alias("nodes"))


def next_tasks(tasks: DataFrame, needs: DataFrame, k: int = 10) -> DataFrame:
    """Open tasks that can begin, most urgent first: what they need (src needs dst) is done or in review, and what that
    needs is done, so work is one step ahead of approval at most.

    With columns wave and waveStatus, tasks of the backlog whose wave isn't active wait.
    """
    state = tasks.select(F.col("uid").alias("dst"), "status")
    known = needs.select("src", "dst").join(state, "dst", "left")
    open_ = known.where(~F.coalesce(F.col("status").isin("done", "review"), F.lit(False))).select(F.col("src").alias("uid"))
    undone = known.where(~F.coalesce(F.col("status") == "done", F.lit(False))).select(F.col("src").alias("dst")).distinct()
    far = needs.select("src", "dst").join(undone, "dst", "left_semi").select(F.col("src").alias("uid"))
    free = tasks.where(F.col("status").isin("todo", "backlog"))
    if {"wave", "waveStatus"} <= set(tasks.columns):
        free = free.where(~((F.col("status") == "backlog") & F.col("wave").isNotNull() & (F.coalesce("waveStatus", F.lit("")) != "active")))
    free = free.join(open_.unionByName(far).distinct(), "uid", "left_anti")
    return free.withColumn("s", F.when(F.col("status") == "todo", 0).otherwise(1)).withColumn("p", rank_of("priority", PRIORITY_ORDER)).orderBy("s", "p", "uid").limit(k).select("uid", "status", "priority")


def task_dependencies(affects: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): tasks that need another as a node of theirs calls a node of its, in another file."""
    place = files.select("uid", "file")
    far = calls.join(place.select(F.col("uid").alias("src"), F.col("file").alias("a")), "src").join(place.select(F.col("uid").alias("dst"), F.col("file").alias("b")), "dst").where("a <> b")
    t = affects.select(F.col("src").alias("task"), F.col("dst").alias("node"))
    out = far.join(t.select(F.col("task").alias("x"), F.col("node").alias("src")), "src").join(t.select(F.col("task").alias("y"), F.col("node").alias("dst")), "dst")
    return out.where("x <> y").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct()


def shared_file_groups(affects: DataFrame, files: DataFrame) -> DataFrame:
    """(uid, root): tasks that touch the same files, directly or through others."""
    touched = affects.join(files.select(F.col("uid").alias("dst"), "file"), "dst").select(F.col("src"), F.concat(F.lit("~file:"), "file").alias("dst")).distinct()
    return components(touched).where(~F.startswith("uid", F.lit("~file:")))


def epic_progress(members: DataFrame) -> DataFrame:
    """Per epic: its tasks, those done, and a status that follows from theirs (columns epic, status)."""
    s = F.col("status")
    per = members.groupBy("epic").agg(F.count(F.lit(1)).alias("tasks"), F.count(F.when(s == "done", 1)).alias("done"), F.bool_and(s == "done").alias("all_done"), F.bool_and(s.isin("done", "review")).alias("all_review"), F.bool_or(s.isin("in_progress", "review", "done")).alias("begun"))
    status = F.when(F.col("all_done"), "done").when(F.col("all_review"), "review").when(F.col("begun"), "in_progress").otherwise("todo")
    return per.select("epic", "tasks", "done", status.alias("status"))


def quality_report(files: DataFrame) -> DataFrame:
    """By language and in all (language null): files, parse errors, sites, resolved sites and their share in percent."""
    per = files.rollup("language").agg(F.count(F.lit(1)).alias("files"), F.sum("parseErrors").alias("parseErrors"), F.sum("sites").alias("sites"), F.sum("resolved").alias("resolved"))
    return per.withColumn("percent", F.when(F.col("sites") > 0, F.round(F.lit(1000.0) * F.col("resolved") / F.col("sites")) / 10))


def quality_gates(report: DataFrame, least_percent: float = 0.0, most_errors: int = 0) -> DataFrame:
    """(gate, passed) from the report's total row."""
    total = report.where("language IS NULL")
    return total.select(F.explode(F.array(F.struct(F.lit("resolution").alias("gate"), F.coalesce(F.col("percent") >= least_percent, F.lit(False)).alias("passed")), F.struct(F.lit("parse errors").alias("gate"), (F.col("parseErrors") <= most_errors).alias("passed")))).alias("g")).select("g.*")


def quality_baseline(report: DataFrame) -> DataFrame:
    """(language, percent, parseErrors) of the languages that have measured sites: what later reports are held against."""
    return report.where("language IS NOT NULL AND percent IS NOT NULL").select("language", "percent", F.coalesce("parseErrors", F.lit(0)).cast("long").alias("parseErrors"))


def regressions(report: DataFrame, baseline: DataFrame, most: float = 0.0) -> DataFrame:
    """(language, gate, actual, expected) where a report is worse than the baseline: resolution by more than ``most`` points
    or no longer measured, and parse errors. Languages that the baseline doesn't list can't be worse."""
    if not 0 <= most <= 100:
        raise ValueError("a regression is from 0 to 100 points")
    now = report.where("language IS NOT NULL").select("language", F.col("percent").alias("now"), F.coalesce("parseErrors", F.lit(0)).alias("errors"))
    met = baseline.join(now, "language", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    resolution = F.when(F.col("now").isNull() | (F.col("now") < F.col("percent") - most), F.struct(F.lit("resolution").alias("gate"), F.col("now").cast("double").alias("actual"), F.col("percent").cast("double").alias("expected")))
    errors = F.when(F.col("errors") > F.col("parseErrors"), F.struct(F.lit("parse errors").alias("gate"), F.col("errors").cast("double").alias("actual"), F.col("parseErrors").cast("double").alias("expected")))
    return met.select("language", F.explode(F.array_compact(F.array(resolution, errors))).alias("g")).select("language", "g.*")


def freshness(disk: DataFrame, graph: DataFrame) -> DataFrame:
    """(path, reason) of files where disk and graph (path, hash, mtime, parse_error) differ."""
    a, b = disk.alias("a"), graph.alias("b")
    reason = F.when(F.col("b.path").isNull(), "missing in graph").when(F.col("a.path").isNull(), "missing on disk").when(F.coalesce("b.parse_error", F.lit(False)), "parse error").when(~F.col("a.hash").eqNullSafe(F.col("b.hash")), "content").when(F.col("a.mtime") > F.col("b.mtime"), "newer")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full").select(F.coalesce("a.path", "b.path").alias("path"), reason.alias("reason")).where("reason IS NOT NULL")


def expired(leases: DataFrame, now: int) -> DataFrame:
    return leases.where(F.col("lockExpires") <= now)


def conflicts(leases: DataFrame, scope: DataFrame, owner: str, now: int) -> DataFrame:
    """Live leases of others on what ``scope`` (file, node) asks for."""
    live = leases.where((F.col("lockExpires") > now) & (F.col("owner") != owner))
    return live.join(scope.select("file").distinct(), "file", "left_semi").unionByName(live.join(scope.select("node").where("node IS NOT NULL").distinct(), "node", "left_semi")).distinct()
