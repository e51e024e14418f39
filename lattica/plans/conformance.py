"""Diagrams against code: what conforms, what is missing, what the code has besides, and what isn't bound yet.

All inputs are tables; many diagrams are compared at once where a table has the diagram's (or process's) name as a key.
Rows without a name, null or empty, are skipped with a reason, never dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.identity import plain_name
from lattica.scratch import written


def _text(value: Column | None = None) -> Column:
    return F.lit(None).cast("string") if value is None else value


def sequence(messages: DataFrame, bindings: DataFrame, members: DataFrame, calls: DataFrame, text: Callable[[Column], Column] = lambda uid: uid) -> DataFrame:
    """(region, reason, message, from_alias, to_alias, method, caller, callees) of a sequence diagram.

    ``messages`` (message, from_alias, to_alias, method, dashed), ``bindings`` (alias), ``members`` (alias, uid, name),
    ``calls`` (src, dst). A message conforms if any member of its sender calls any of the receiver's members of that
    name, of which ``callees`` lists those called. Replies (dashed), unbound ends and free text are skipped. Extra are calls
    between two participants that no message names; calls within one participant are none. An alias with an unbound
    end is listed once. Aliases and uids may be numbers; ``text`` then makes a uid the text that ``callees`` lists, and
    aliases and ``caller`` stay numbers. Messages and the calls between participants are written, as both are read several times.
    """
    bound = bindings.select("alias").where("alias IS NOT NULL").distinct()
    ends = [bound.select(F.col("alias").alias(f"{end}_alias"), F.lit(True).alias(f"{end}_bound")) for end in ("from", "to")]
    m = messages.select("message", "from_alias", "to_alias", "method", F.coalesce("dashed", F.lit(False)).alias("dashed")).join(ends[0], "from_alias", "left").join(ends[1], "to_alias", "left")
    skip = F.when(F.col("dashed"), "return").when(F.col("from_bound").isNull() | F.col("to_bound").isNull(), "unbound_endpoint").when(F.coalesce("method", F.lit("")) == "", "free_text")
    m = written(m.withColumn("skip", skip))
    member = members.select("alias", "uid", "name").distinct()
    asked = m.where("skip IS NULL").select("from_alias", "to_alias", "method").distinct()
    calling = member.select(F.col("alias").alias("from_alias"), F.col("uid").alias("src"))
    called = member.select(F.col("alias").alias("to_alias"), F.col("uid").alias("dst"), F.col("name").alias("method"))
    between = calls.select("src", "dst").repartition("src").distinct().join(calling, "src").join(called, "dst")
    between = written(between.join(asked.withColumn("asked", F.lit(True)), ["from_alias", "to_alias", "method"], "left").where("asked OR from_alias <> to_alias"))
    listed = F.array_join(F.array_sort(F.transform(F.collect_set("dst"), text)), ",")
    hit = between.where("asked").groupBy("from_alias", "to_alias", "method").agg(listed.alias("hits"))
    known = called.groupBy("to_alias", "method").agg(listed.alias("candidates"))
    judged = m.join(known, ["to_alias", "method"], "left").join(hit, ["from_alias", "to_alias", "method"], "left")
    checked = F.col("skip").isNull()
    region = F.when(~checked, "skipped").when(F.col("hits").isNotNull(), "conforms").otherwise("missing")
    reason = F.when(~checked, F.col("skip")).when(F.col("hits").isNotNull(), _text()).when(F.col("candidates").isNull(), "no_method").otherwise("not_called")
    alias, uid = (F.lit(None).cast(dict(members.dtypes)[c]) for c in ("alias", "uid"))
    walked = judged.select(region.alias("region"), reason.alias("reason"), "message", "from_alias", "to_alias", "method", uid.alias("caller"), F.when(checked, F.coalesce("hits", "candidates")).alias("callees"))
    besides = between.where("asked IS NULL")
    none = F.lit(None).cast(dict(messages.dtypes)["message"])
    extra = besides.select(F.lit("extra").alias("region"), _text().alias("reason"), none.alias("message"), "from_alias", "to_alias", "method", F.col("src").alias("caller"), text(F.col("dst")).alias("callees"))
    named = m.where("NOT dashed")
    loose = named.where("from_bound IS NULL").select(F.col("from_alias").alias("alias")).unionByName(named.where("to_bound IS NULL").select(F.col("to_alias").alias("alias"))).where("alias IS NOT NULL").distinct()
    unbound = loose.select(F.lit("unbound").alias("region"), _text().alias("reason"), none.alias("message"), F.col("alias").alias("from_alias"), alias.alias("to_alias"), _text().alias("method"), uid.alias("caller"), _text().alias("callees"))
    return walked.unionByName(extra).unionByName(unbound)


def classes(diagram: DataFrame, bindings: DataFrame, code: DataFrame, relations: DataFrame, inherits: DataFrame) -> DataFrame:
    """(kind, region, class, member) of a class diagram.

    ``diagram`` and ``code`` (class, method), ``bindings`` (class, uid), ``relations`` (src, dst, type) between diagram
    classes, ``inherits`` (src, dst) between uids. Methods of bound classes conform, are missing or extra; inheritance
    of bound classes conforms or is missing. A class drawn without methods has a row with a null method.
    """
    bound = bindings.where("class IS NOT NULL AND uid IS NOT NULL").dropDuplicates(["class"])
    drawn = diagram.select("class").where("class IS NOT NULL").distinct()
    inside = drawn.join(bound, "class", "left_semi")
    a = diagram.where("method IS NOT NULL").select("class", "method").distinct().join(inside, "class", "left_semi").withColumn("drawn", F.lit(True))
    b = code.where("method IS NOT NULL").select("class", "method").distinct().join(inside, "class", "left_semi").withColumn("coded", F.lit(True))
    region = F.when(F.col("drawn") & F.col("coded"), "conforms").when(F.col("drawn"), "missing").otherwise("extra")
    methods = a.join(b, ["class", "method"], "full").select(F.lit("method").alias("kind"), region.alias("region"), "class", F.col("method").alias("member"))
    r = relations.where("type = 'inherits'").select("src", "dst").distinct()
    to_uid = [bound.select(F.col("class").alias(end), F.col("uid").alias(f"{end}_uid")) for end in ("src", "dst")]
    r = r.join(to_uid[0], "src", "left").join(to_uid[1], "dst", "left")
    true = inherits.select(F.col("src").alias("src_uid"), F.col("dst").alias("dst_uid")).distinct().withColumn("true", F.lit(True))
    bonds = r.where("src_uid IS NOT NULL AND dst_uid IS NOT NULL").join(true, ["src_uid", "dst_uid"], "left")
    bonds = bonds.select(F.lit("inherits").alias("kind"), F.when(F.col("true"), "conforms").otherwise("missing").alias("region"), F.col("src").alias("class"), F.col("dst").alias("member"))
    loose = drawn.join(bound, "class", "left_anti").unionByName(r.where("src_uid IS NULL").select(F.col("src").alias("class"))).unionByName(r.where("dst_uid IS NULL").select(F.col("dst").alias("class"))).where("class IS NOT NULL").distinct()
    return methods.unionByName(bonds).unionByName(loose.select(F.lit("class").alias("kind"), F.lit("unbound").alias("region"), "class", _text().alias("member")))


def activity(actions: DataFrame, bound: DataFrame, callees: DataFrame) -> DataFrame:
    """(process, region, action, method, callee) of activity diagrams.

    ``actions`` (process, action, method), ``bound`` (process), ``callees`` (process, name). Names are compared in lower
    case without punctuation; the exact name wins among several that then agree, else the action is ambiguous and none
    of them counts as extra. Unbound processes have one row.
    """
    inside = bound.select("process").distinct()
    names = callees.select("process", F.col("name").alias("callee"), plain_name(F.col("name")).alias("norm")).where("norm <> ''").distinct().join(inside, "process", "left_semi")
    many = names.groupBy("process", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("callee").alias("only"))
    a = actions.join(inside, "process", "left_semi").withColumn("norm", plain_name(F.col("method")))
    exact = names.select("process", F.col("callee").alias("method"), F.lit(True).alias("exact"))
    a = a.join(many, ["process", "norm"], "left").join(exact, ["process", "method"], "left")
    region = F.when(F.coalesce("method", F.lit("")) == "", "skipped").when(F.col("n").isNull(), "missing").when(F.col("exact") | (F.col("n") == 1), "conforms").otherwise("ambiguous")
    a = a.select("process", region.alias("region"), "action", "method", "norm", F.when(F.col("exact"), F.col("method")).when(F.col("n") == 1, F.col("only")).alias("callee"))
    covered = a.where("region = 'conforms'").select("process", "callee")
    unclear = a.where("region = 'ambiguous'").select("process", "norm")
    extra = names.join(covered, ["process", "callee"], "left_anti").join(unclear, ["process", "norm"], "left_anti")
    none = F.lit(None).cast(dict(actions.dtypes)["action"])
    extra = extra.select("process", F.lit("extra").alias("region"), none.alias("action"), _text().alias("method"), "callee")
    loose = actions.select("process").distinct().join(inside, "process", "left_anti").select("process", F.lit("unbound").alias("region"), none.alias("action"), _text().alias("method"), _text().alias("callee"))
    return a.drop("norm").unionByName(extra).unionByName(loose)


def use_cases(cases: DataFrame, bindings: DataFrame, relations: DataFrame, calls: DataFrame) -> DataFrame:
    """(kind, region, id, other): use cases by whether code implements them, and relations between implemented ones by
    whether it calls accordingly. ``cases`` (id), ``bindings`` (id, uid), ``relations`` (src, dst, type), ``calls`` (src, dst)."""
    uid = bindings.where("uid IS NOT NULL").dropDuplicates(["id"]).select("id", "uid")
    done = cases.select("id").join(uid, "id", "left").select(F.lit("use case").alias("kind"), F.when(F.col("uid").isNotNull(), "implemented").otherwise("unimplemented").alias("region"), "id", F.col("uid").alias("other"))
    pair = relations.join(uid.select(F.col("id").alias("src"), F.col("uid").alias("a")), "src").join(uid.select(F.col("id").alias("dst"), F.col("uid").alias("b")), "dst")
    pair = pair.join(calls.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("called")).distinct(), ["a", "b"], "left")
    return done.unionByName(pair.select("type", F.when(F.col("called"), "conforms").otherwise("missing").alias("region"), F.col("src").alias("id"), F.col("dst").alias("other")).withColumnRenamed("type", "kind"))


def bind(specs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, uid, state): specs (id, name, display, text) bound to the one node (uid, name) that has their name, or else
    their display name or text; several such nodes are ambiguous, none is unbound."""
    tries = specs.select("id", F.posexplode(F.array("name", "display", "text")).alias("nth", "name")).where("name IS NOT NULL AND name <> ''")
    found = tries.join(nodes.select("uid", "name").distinct(), "name").groupBy("id", "nth").agg(F.count_distinct("uid").alias("n"), F.min("uid").alias("uid"))
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.col("n") > 1, "nth"))).where("k = 1")
    out = specs.select("id").distinct().join(best, "id", "left")
    return out.select("id", F.when(F.col("n") == 1, F.col("uid")).alias("uid"), F.when(F.col("n") == 1, "bound").when(F.col("n") > 1, "ambiguous").otherwise("unbound").alias("state"))


def gaps(specs: DataFrame, code: DataFrame, realized: DataFrame) -> DataFrame:
    """(kind, uid): specs (uid) that no code realizes and code (uid) that no spec asks for; ``realized`` (src spec, dst code)."""
    a = specs.select("uid").join(realized.select(F.col("src").alias("uid")), "uid", "left_anti").select(F.lit("unrealized spec").alias("kind"), "uid")
    b = code.select("uid").join(realized.select(F.col("dst").alias("uid")), "uid", "left_anti").select(F.lit("unspecified code").alias("kind"), "uid")
    return a.unionByName(b)
