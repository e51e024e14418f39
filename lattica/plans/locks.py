"""Locks on nodes by hierarchical address: which lock covers a node, who is in the way, and how a task's locks change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators import skew, traverse
from lattica.scratch import written

#: Lengths of prefixes in bits: a file, a declaration, a member.
MASKS = (48, 64, 80)
# Statuses whose tasks hold their locks, those whose tasks plan them, and labels that are never locked.
ACTIVE, WAITING = ("in_progress", "review", "blocked", "needs_info"), ("backlog", "todo", "open")
UNLOCKED = ("Knowledge", "Task", "Epic")


def subnet(ipv6: Column, mask: int) -> Column:
    """The first ``mask`` bits of an address written in eight groups."""
    return F.array_join(F.slice(F.split(ipv6, ":"), 1, mask // 16), ":")


def covering(nodes: DataFrame, locks: DataFrame, now: int, masks: tuple[int, ...] = MASKS) -> DataFrame:
    """``nodes`` (uid, ipv6) that a live lock covers: (uid, mask, owner, lockGroup), the lock of the longest prefix.

    ``locks``: ipv6, mask, owner, lockGroup, expires (null: never). Of locks on one prefix the one that ends last counts, then
    the first by owner and group. A join a mask: prefixes are equal, and each has one lock by then.
    """
    nodes = written(nodes.select("uid", "ipv6").where("ipv6 IS NOT NULL"))
    live = locks.where(F.col("ipv6").isNotNull() & (F.col("expires").isNull() | (F.col("expires") > now)))
    found = None
    for mask in masks:
        last = F.coalesce("expires", F.lit((1 << 63) - 1))
        here = live.where(F.col("mask") == mask).select(subnet(F.col("ipv6"), mask).alias("net"), (-last).alias("less"), "owner", "lockGroup")
        one = here.groupBy("net").agg(F.min(F.struct("less", "owner", "lockGroup")).alias("lock"))
        met = skew.lookup(nodes.withColumn("net", subnet(F.col("ipv6"), mask)), one, "net")
        met = met.select("uid", F.lit(mask).alias("mask"), "lock.owner", "lock.lockGroup")
        found = met if found is None else found.unionByName(met)
    return found.groupBy("uid").agg(F.max_by(F.struct("mask", "owner", "lockGroup"), "mask").alias("lock")).select("uid", "lock.*")


def crossing(requests: DataFrame, nodes: DataFrame, now: int, masks: tuple[int, ...] = MASKS) -> DataFrame:
    """``requests`` (request, agent, ipv6, mask) that others' live locks are in the way of: (request, agent, conflicts, node,
    lockedBy, lockGroup), how many nodes in the subnet, and the first of them by name and uid.

    ``nodes``: uid, name, ipv6, lockedBy, lockGroup, expires (null: never); a null lockedBy is no lock. What an agent's own
    locks add is taken off a subnet's sum, and of its nodes the first of two owners suffice: a request meets one row of its
    subnet and one of its own there, however many owners the subnet has.
    """
    live = nodes.where(F.col("lockedBy").isNotNull() & F.col("ipv6").isNotNull() & (F.col("expires").isNull() | (F.col("expires") > now)))
    first = F.min(F.struct("name", "uid", "lockedBy", "lockGroup")).alias("first")
    held = None
    for mask in masks:
        per = live.groupBy(F.concat_ws("/", F.lit(mask), subnet(F.col("ipv6"), mask)).alias("net"), F.col("lockedBy").alias("by")).agg(F.count(F.lit(1)).alias("n"), first)
        held = per if held is None else held.unionByName(per)
    held = written(held)
    best = held.groupBy("net").agg(F.sum("n").alias("total"), F.min("first").alias("first"))
    second = skew.lookup(held.select("net", "by", F.col("first").alias("next")), best.select("net", F.col("first.lockedBy").alias("best")), "net")
    second = second.where("by <> best").groupBy("net").agg(F.min("next").alias("second"))
    best = written(best.join(second, "net", "left"))
    net = F.when(F.lit(False), None)
    for mask in masks:
        net = net.when(F.col("mask") == mask, F.concat_ws("/", F.lit(mask), subnet(F.col("ipv6"), mask)))
    asked = written(requests.where("agent IS NOT NULL AND ipv6 IS NOT NULL").select("request", "agent", net.alias("net")))
    own = held.select("net", F.col("by").alias("agent"), "n")
    met = skew.lookup(asked, best, "net").join(own, ["net", "agent"], "left").withColumn("n", F.col("total") - F.coalesce("n", F.lit(0))).where("n > 0")
    met = met.withColumn("first", F.when(F.col("first.lockedBy") == F.col("agent"), F.col("second")).otherwise(F.col("first")))
    return met.groupBy("request", "agent").agg(F.sum("n").alias("conflicts"), F.min("first").alias("f")).select("request", "agent", "conflicts", F.col("f.name").alias("node"), "f.lockedBy", "f.lockGroup")


def scope(g: Graph, origins: DataFrame, rels: list[str], depth: int) -> DataFrame:
    """(origin, uid): what a lock on each origin (column uid) takes with it: nodes within ``depth`` steps either way."""
    near = traverse.reach(g, origins, rels, depth, "both").select("origin", F.col("node").alias("uid"))
    if not (never := [x for x in UNLOCKED if x in g.labels]):
        return near
    return near.join(g.nodes(never).select("uid"), "uid", "left_anti").select("origin", "uid")


def barred(tasks: DataFrame, waves: DataFrame) -> DataFrame:
    """(uid, wave): tasks (uid, status, wave) that wait and belong to a wave that isn't active (waves: wave, status).

    Tasks without a wave can start; a wave that isn't listed isn't active.
    """
    active = waves.where("status = 'active'").select("wave")
    waiting = tasks.where(F.col("status").isin(*WAITING) & F.col("wave").isNotNull())
    return waiting.join(F.broadcast(active), "wave", "left_anti").select("uid", "wave")


def transitions(requests: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What becomes of tasks' locks when their statuses change, all at once: the requests' results, and the nodes after.

    ``requests``: task, agent, old, new, at; one a task. ``nodes``: uid, name, ipv6, lockGroup, lockStatus, lockedBy (null: not
    locked). Results: (task, result, nodes, conflict): OK, NOOP or LOCK_CONFLICT, how many nodes changed, and the address in
    the way. A task that is done releases its nodes; one that goes back plans them (lockStatus ``planned``); one that begins
    locks its planned nodes, all or none: none if another agent holds a node of the same address, already or by a request
    of the same batch that comes before, by ``at`` and task. Releases come before all others.
    """
    r = requests.select("task", "agent", "old", "new", "at")
    kind = F.when(F.col("new") == "done", "release").when(F.col("new").isin(*WAITING), "plan").when(F.col("new").isin(*ACTIVE) & ~F.col("old").isin(*ACTIVE), "begin").otherwise("none")
    r = written(r.withColumn("kind", kind))
    n = written(nodes.select("uid", "name", "ipv6", "lockGroup", "lockStatus", "lockedBy"))
    mine = n.join(r.select(F.col("task").alias("lockGroup"), "kind", "agent"), "lockGroup", "left")
    free = F.col("kind") == "release"
    back = (F.col("kind") == "plan") & F.col("lockedBy").isNotNull()
    changed = F.when(free, "release").when(back, "plan")
    now = mine.select("uid", "name", "ipv6", F.when(~F.coalesce(free, F.lit(False)), F.col("lockGroup")).alias("lockGroup"), F.when(back, "planned").when(~F.coalesce(free, F.lit(False)), F.col("lockStatus")).alias("lockStatus"), F.when(~F.coalesce(free | back, F.lit(False)), F.col("lockedBy")).alias("lockedBy"), changed.alias("done"), F.col("lockGroup").alias("task"))
    now = written(now)
    begin = r.where("kind = 'begin'")
    planned = now.where("lockStatus = 'planned'").select("ipv6", F.col("lockGroup").alias("task"))
    asks = written(begin.select("task", "agent", "at").join(planned, "task").where("ipv6 IS NOT NULL").select("task", "agent", "at", "ipv6").distinct())
    held = now.where("lockedBy IS NOT NULL").select("ipv6", F.col("lockedBy").alias("agent")).distinct()
    open_, lost = asks, r.select("task", F.col("task").alias("conflict")).limit(0)
    while not open_.isEmpty():
        # held by another: an address has two holders at most that matter, the least and the greatest
        by = held.groupBy("ipv6").agg(F.min("agent").alias("a"), F.max("agent").alias("b"))
        hit = open_.join(by, "ipv6").where("a <> agent OR b <> agent").groupBy("task").agg(F.min("ipv6").alias("conflict"))
        hit = written(hit)
        left = open_.join(hit, "task", "left_anti")
        # a request that no other agent's undecided one comes before, on any of its addresses, wins
        along = Window.partitionBy("ipv6").orderBy("at", "task").rowsBetween(Window.unboundedPreceding, -1)
        ahead = left.withColumns({"a": F.min("agent").over(along), "b": F.max("agent").over(along)}).where("a <> agent OR b <> agent").select("task").distinct()
        wins = written(left.join(ahead, "task", "left_anti"))
        lost = lost.unionByName(hit)
        held = written(held.unionByName(wins.select("ipv6", "agent")).distinct())
        open_ = written(left.join(wins.select("task").distinct(), "task", "left_anti"))
    # planned nodes without an address have nobody in their way
    winners = written(begin.join(lost, "task", "left_anti").select(F.col("task").alias("lockGroup"), "agent"))
    after = now.join(winners, "lockGroup", "left")
    taken = F.col("agent").isNotNull() & (F.col("lockStatus") == "planned")
    taken = F.coalesce(taken, F.lit(False))
    after = written(after.select("uid", "name", "ipv6", "lockGroup", F.when(~taken, F.col("lockStatus")).alias("lockStatus"), F.when(taken, F.col("agent")).otherwise(F.col("lockedBy")).alias("lockedBy"), F.when(taken, "begin").otherwise(F.col("done")).alias("done"), "task"))
    counts = after.where("done IS NOT NULL").groupBy("task").agg(F.count(F.lit(1)).alias("nodes"))
    result = F.when(F.col("kind") == "none", "NOOP").when(F.col("conflict").isNotNull(), "LOCK_CONFLICT").otherwise("OK")
    results = r.join(lost, "task", "left").join(counts, "task", "left").select("task", result.alias("result"), F.coalesce("nodes", F.lit(0)).cast("long").alias("nodes"), "conflict")
    return results, after.select("uid", "name", "ipv6", "lockGroup", "lockStatus", "lockedBy")
