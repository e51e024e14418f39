"""Rebuilding a part of the graph: which files are read again, what old nodes have become, and edges that come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import skew
from lattica.scratch import written


def affected(changed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, reason): files to read again: those ``changed`` (file), and those with a node that leads into one of these.

    ``nodes``: uid, file; ``edges``: src, dst. ``reason`` is changed or dependent; one step, as a file's own contents don't
    change by what it calls.
    """
    changed = changed.select("file").where("file IS NOT NULL").distinct()
    own = nodes.select("uid", "file").where("file IS NOT NULL")
    inside = written(own.join(changed, "file", "left_semi").select("uid"))
    into = edges.join(inside, F.col("dst") == F.col("uid"), "left_semi").select(F.col("src").alias("uid")).distinct()
    more = own.join(into, "uid", "left_semi").select("file").distinct().join(changed, "file", "left_anti")
    return changed.withColumn("reason", F.lit("changed")).unionByName(more.withColumn("reason", F.lit("dependent")))


def _one(new: DataFrame, keys: dict[str, Column], found: str) -> DataFrame:
    """For each key of the new nodes, its node if it is the only one: counted, so a common key makes no pairs."""
    per = new.groupBy(*(c.alias(k) for k, c in keys.items())).agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias(found))
    return per.where("n = 1").drop("n")


def identities(old: DataFrame, new: DataFrame) -> DataFrame:
    """(uid, now, how): what each old node is now: uid, name or body tells, or nothing does (now and how null).

    Both: uid, label, name, file, path, owner, params, body. First the same uid and label; then the only node of the same
    label, name, file and owner (of a file: its path; a missing owner is none); then, for functions with a body, the only one
    of the same body and parameters in the same file, else in all files. What fits several is left without: no guess.
    """
    old, new = (written(df.select("uid", "label", "name", "file", "path", F.coalesce("owner", F.lit("")).alias("owner"), "params", "body")) for df in (old, new))
    is_file = F.col("label") == "File"
    home = F.struct("label", F.when(is_file, F.lit(None)).otherwise(F.col("name")).alias("name"), F.when(is_file, F.col("path")).otherwise(F.col("file")).alias("file"), F.when(~is_file, F.col("owner")).alias("owner"))
    whole = F.when(F.when(is_file, F.col("path").isNotNull()).otherwise(F.col("name").isNotNull() & F.col("file").isNotNull()), F.to_json(home))
    text = (F.col("label") == "Function") & F.col("body").isNotNull() & F.col("params").isNotNull()
    print_ = F.when(text & (F.col("body") != ""), F.sha2(F.to_json(F.struct("body", "params")), 256))
    here = F.when(F.col("file").isNotNull(), F.concat_ws("\u0000", print_, "file"))
    keys = {"k_uid": F.to_json(F.struct("uid", "label")), "k_name": whole, "k_here": F.when(print_.isNotNull(), here), "k_body": print_}
    left, out = old.select("uid", *(c.alias(k) for k, c in keys.items())), None
    marked = new.select("uid", *(c.alias(k) for k, c in keys.items()))
    for key, how in zip(keys, ("uid", "name", "body", "body"), strict=True):
        left = written(left)
        one = _one(marked.where(F.col(key).isNotNull()), {key: F.col(key)}, "now")
        hit = written(skew.lookup(left.where(F.col(key).isNotNull()), one, key).select("uid", "now", F.lit(how).alias("how")))
        out = hit if out is None else out.unionByName(hit)
        left = left.join(hit.select("uid"), "uid", "left_anti")
    lost = left.select("uid", F.lit(None).cast("string").alias("now"), F.lit(None).cast("string").alias("how"))
    return out.unionByName(lost)


def reattached(edges: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (rel_type, src, dst, ...) that led to or from old nodes, on what these are now, and those that can't come back.

    ``known``: uid, now, as of ``identities``; ends that it doesn't list stay as they are. Edges are a set: of several that
    become one, one stays. Lost edges come with ``missing``, the old ends that are nothing now.
    """
    more = [c for c in edges.columns if c not in ("src", "dst")]
    now = known.select("uid", "now", F.lit(True).alias("was"))
    rows = edges
    for end in ("src", "dst"):
        moved = now.select(F.col("uid").alias(end), F.col("now").alias(f"{end}_now"), F.col("was").alias(f"{end}_was"))
        rows = written(skew.lookup(rows, moved, end, "left"))
    gone = {end: F.coalesce(F.col(f"{end}_was"), F.lit(False)) & F.col(f"{end}_now").isNull() for end in ("src", "dst")}
    back = rows.where(~gone["src"] & ~gone["dst"]).select(*more, *(F.coalesce(f"{end}_now", end).alias(end) for end in ("src", "dst"))).distinct()
    missing = F.concat_ws(",", *(F.when(gone[end], F.col(end)) for end in ("src", "dst")))
    return back.select(edges.columns), rows.where(gone["src"] | gone["dst"]).select(*edges.columns, missing.alias("missing"))


def replaced(nodes: DataFrame, edges: DataFrame, files: DataFrame, fresh: DataFrame, fresh_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after the ``files`` (file) were read again: nodes, and edges.

    ``fresh`` are the nodes of these files now and ``fresh_edges`` the edges that reading them gave. Old nodes there go, with the
    edges that begin in them; edges from elsewhere into them come back on what their ends are now, if that can be told.
    """
    here = files.select("file").distinct()
    old = written(nodes.join(here, "file", "left_semi"))
    stay = nodes.join(old.select("uid"), "uid", "left_anti")
    incoming = edges.join(old.select(F.col("uid").alias("src")), "src", "left_anti")
    back, _ = reattached(incoming, identities(old, fresh))
    return stay.unionByName(fresh, allowMissingColumns=True).select(nodes.columns), back.unionByName(fresh_edges, allowMissingColumns=True).select(edges.columns).distinct()
