"""Cycles: strongly connected components, the nodes on short cycles, and for each such node one cycle as a witness.

Files of ids are small, but what they hold grows with the graph, so no join here lets Spark send a side to all tasks whole
(``apart``).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import weak, wedges
from lattica.scratch import written

#: Rounds in which nodes without edges in or out are taken away before labels spread.
TRIMS = 2
#: Edges of a connected part that one task takes at most, 16 bytes each: a part that is no larger is searched in one task.
TASK_EDGES = 1 << 20
#: Nodes of such a part at most for its short cycles to be searched by rows of bits, which take its nodes squared.
BIT_NODES = 1 << 16
#: Words of 64 origins in a row, and words in all rows of a table, at most.
BIT_WORDS, BIT_TABLE = 32, 1 << 22
#: Targets that are left when their edges are no longer taken one of each target at a time.
BIT_FEW = 32


def apart(side: DataFrame) -> DataFrame:
    """``side`` of a join that is shuffled and merged: it passes through no driver, however small its files are."""
    return side.hint("merge")


def numbers(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (uid, id) and edges (a, b: long) of ``edges`` (src, dst): distinct, without self-loops and nulls.

    Joins and shuffles of walks then carry 8 bytes a node instead of its uid. Ids are in order of uids.
    """
    pairs = written(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = pairs.select(F.col("src").alias("uid")).unionAll(pairs.select(F.col("dst").alias("uid"))).distinct()
    ids = written(nodes.repartitionByRange("uid").sortWithinPartitions("uid").withColumn("id", F.monotonically_increasing_id()))
    a, b = (ids.select(F.col("uid").alias(end), F.col("id").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    return ids, written(pairs.join(apart(a), "src").join(apart(b), "dst").select("a", "b"))


def _within(edges: DataFrame, label: DataFrame, *names: str) -> DataFrame:
    """Edges (a, b) whose ends have equal labels."""
    x = label.select(F.col("id").alias("a"), *(F.col(n).alias(f"x_{n}") for n in names))
    y = label.select(F.col("id").alias("b"), *(F.col(n).alias(f"y_{n}") for n in names))
    out = edges.join(apart(x), "a").join(apart(y), "b")
    for n in names:
        out = out.where(F.col(f"x_{n}") == F.col(f"y_{n}"))
    return out.select("a", "b")


def _spread(edges: DataFrame) -> DataFrame:
    """(id, least, met): for each node the smallest id that reaches it, and the smallest that it reaches.

    Labels spread along edges and against them until none changes; a label's messages are reduced before their shuffle.
    """
    nodes = edges.select(F.col("a").alias("id")).unionAll(edges.select(F.col("b").alias("id"))).distinct()
    label = written(nodes.select("id", F.col("id").alias("least"), F.col("id").alias("met"), F.lit(True).alias("new")))
    while not label.where("new").isEmpty():
        fresh = label.where("new")
        forth = edges.join(apart(fresh), F.col("a") == F.col("id")).groupBy(F.col("b").alias("id")).agg(F.min("least").alias("l"), F.lit(None).cast("long").alias("m"))
        back = edges.join(apart(fresh), F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.lit(None).cast("long").alias("l"), F.min("met").alias("m"))
        told = forth.unionByName(back).groupBy("id").agg(F.min("l").alias("l"), F.min("m").alias("m"))
        less = (F.coalesce(F.col("l") < F.col("least"), F.lit(False))) | (F.coalesce(F.col("m") < F.col("met"), F.lit(False)))
        label = written(label.join(apart(told), "id", "left").select("id", F.least("least", "l").alias("least"), F.least("met", "m").alias("met"), less.alias("new")))
    return label.drop("new")


def _search(batches):
    """Components of a few edges by one depth-first search: a node that reaches none older than itself ends its own."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    a, b = (np.concatenate([np.asarray(batch.column(k)) for batch in held]) for k in ("a", "b"))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    order = np.argsort(at[: len(a)], kind="stable")
    ahead = at[len(a) :][order].tolist()
    first = np.searchsorted(at[: len(a)][order], np.arange(len(nodes) + 1)).tolist()
    age, oldest, component = [0] * len(nodes), [0] * len(nodes), [-1] * len(nodes)
    clock, open_ = 0, []
    for root in range(len(nodes)):
        if age[root]:
            continue
        walk = [(root, first[root])]
        clock += 1
        age[root] = oldest[root] = clock
        open_.append(root)
        while walk:
            x, k = walk.pop()
            if k < first[x + 1]:
                walk.append((x, k + 1))
                y = ahead[k]
                if not age[y]:
                    clock += 1
                    age[y] = oldest[y] = clock
                    open_.append(y)
                    walk.append((y, first[y]))
                elif component[y] < 0:
                    oldest[x] = min(oldest[x], age[y])
                continue
            if walk:
                up = walk[-1][0]
                oldest[up] = min(oldest[up], oldest[x])
            if oldest[x] == age[x]:
                cut = len(open_) - 1
                while open_[cut] != x:
                    cut -= 1
                least = min(open_[cut:])
                for y in open_[cut:]:
                    component[y] = least
                del open_[cut:]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[np.array(component)])], names=["id", "component"])


def _split(edges: DataFrame, rest: int, nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, root) of the connected parts of at most ``TASK_EDGES`` edges, a part whole in a task, and those (a, b) of
    the others. With ``nodes``, parts of more nodes are among the others."""
    root = written(weak.components(edges))
    placed = written(edges.join(apart(root.withColumnRenamed("node", "a")), "a").select("a", "b", "root"))
    count = F.count(F.lit(1)).alias("n")
    large = placed.groupBy("root").agg(count).where(F.col("n") > TASK_EDGES).select("root")
    if nodes is not None:
        large = large.unionByName(root.groupBy("root").agg(count).where(F.col("n") > nodes).select("root")).distinct()
    large = written(large)
    few = placed.join(apart(large), "root", "left_anti").repartition(-(-4 * rest // max(1, TASK_EDGES)), "root")
    return few, placed.join(apart(large), "root", "left_semi").select("a", "b")


def _parts(edges: DataFrame, rest: int) -> tuple[DataFrame, DataFrame]:
    """(id, component) of the connected parts of at most ``TASK_EDGES`` edges, searched side by side; edges of the others."""
    few, many = _split(edges, rest)
    return written(few.select("a", "b").mapInArrow(_search, "id long, component long")), many


def strong(edges: DataFrame) -> DataFrame:
    """(id, component): nodes of ``edges`` (a, b: long) that lie on a cycle, with the smallest id of their strongly
    connected component; nodes on none are left out.

    Connected parts of at most ``TASK_EDGES`` edges are searched in one task each, many parts in a task. Of larger ones nodes
    without an edge in or out are trimmed. Then each round spreads the smallest id along edges and against them: a
    node for which both are equal is in the component of that id, and edges between nodes that differ in either label are
    on no cycle. Each round settles at least the component of every smallest id; within a round labels take as many steps
    as shortest paths are long. Parts that have come apart by then are searched.
    """
    left, done, first = edges, None, True
    while True:
        rest = left.count()
        if rest <= TASK_EDGES:
            settled = left.coalesce(1).mapInArrow(_search, "id long, component long")
            done = settled if done is None else done.unionByName(settled)
            break
        settled, left = _parts(left, rest)
        done = settled if done is None else done.unionByName(settled)
        for _ in range(TRIMS if first else 1):
            left = left.join(apart(left.select(F.col("b").alias("a"))), "a", "left_semi").join(apart(left.select(F.col("a").alias("b"))), "b", "left_semi").select("a", "b")
        left, first = written(left), False
        if left.isEmpty():
            break
        label = written(_spread(left))
        done = done.unionByName(label.where("least = met").select("id", F.col("least").alias("component")))
        left = written(_within(left, label.where("least <> met"), "least", "met"))
    done = written(done)
    many = done.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return written(done.join(apart(many), "component", "left_semi").select("id", "component"))


def inside(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``edges`` (src, dst): nodes (uid, id), components (id, component), and the edges (a, b) within components."""
    ids, pairs = numbers(edges)
    component = strong(pairs)
    return ids, component, written(_within(pairs, component, "component"))


def components(edges: DataFrame) -> DataFrame:
    """(uid, component, size): nodes on cycles of ``edges`` (src, dst) of two nodes or more, by the smallest uid there."""
    ids, component, _ = inside(edges)
    named = written(component.join(apart(ids), "id"))
    per = named.groupBy("component").agg(F.min("uid").alias("least"), F.count(F.lit(1)).alias("size"))
    return named.join(apart(per), "component").select("uid", F.col("least").alias("component"), "size")


def _onward(walk: DataFrame, steps: DataFrame) -> DataFrame:
    return walk.join(apart(steps), F.col("node") == F.col("a")).select("origin", F.col("b").alias("node")).distinct()


def _nearby(steps: DataFrame, max_hops: int) -> DataFrame:
    """(origin): nodes of ``steps`` (a, b) on a cycle of 2 to ``max_hops`` edges, 4 at most.

    Two nodes are on such a cycle together if an edge or two lead from one to the other, and an edge or two back. A node
    has lists of the nodes of larger id that lie so before and behind it, so each two nodes are looked at once, where the
    smaller is; what was found there tells of both.
    """
    back = steps.select(F.col("b").alias("a"), F.col("a").alias("b"))
    outs, ins = wedges.lists(steps, "a", "b"), wedges.lists(back, "a", "b")
    rows = [held.select(F.col("at").alias("a"), "ends", F.lit(kind).alias("kind")) for held, kind in ((outs, 1), (ins, 2))]
    if max_hops > 2:
        rows += [wedges.across(edges, "b", held).select("a", "ends", F.lit(kind).alias("kind")) for edges, held, kind in ((steps, outs, 4), (back, ins, 8))]
    every = reduce(DataFrame.unionByName, [wedges.above(x, "a") for x in rows])
    each = every.repartition(wedges.tasks(steps, "b", "a"), "a").select("a", F.explode("ends").alias("end"), "kind")
    met = [1 | 2] + [4 | 2, 8 | 1] * (max_hops > 2) + [4 | 8] * (max_hops > 3)
    ways = reduce(Column.__or__, [F.col("ways").bitwiseAND(m) == m for m in met])
    hits = each.groupBy("a", "end").agg(F.bit_or("kind").alias("ways")).where(ways)
    return written(hits.select(F.explode(F.array("a", "end")).alias("origin")).distinct())


def _behind(a: np.ndarray, b: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each node's row is the union of the ``rows`` of nodes with an edge to it; edges (a, b) are in order of b."""
    out = np.zeros_like(rows)
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    many = np.diff(np.r_[first, len(b)])
    order = np.argsort(-many, kind="stable")
    first, many = first[order], many[order]
    found = np.zeros((len(first), rows.shape[1]), rows.dtype)
    open_ = np.searchsorted(-many, -np.arange(int(many[0]) + 1), side="left")  # targets with more edges than so many
    for k in range(int(many[0])):
        if open_[k] <= BIT_FEW:
            for t in range(open_[k]):
                for at in range(k, int(many[t]), BIT_TABLE // 64):
                    some = a[first[t] + at : first[t] + min(at + BIT_TABLE // 64, int(many[t]))]
                    found[t] |= np.bitwise_or.reduce(rows[some], axis=0)
            break
        found[: open_[k]] |= rows[a[first[: open_[k]] + k]]
    out[b[first]] = found
    return out


def _round(a: np.ndarray, b: np.ndarray, rank: np.ndarray, max_hops: int) -> np.ndarray:
    """Whether each node lies on a closed walk of 2 to ``max_hops`` edges (a, b: node numbers, in order of b).

    A row has a bit for each origin whose walk gets there. Nodes of many parts share a bit, but one of each part only, by ``rank``.
    """
    on = np.zeros(len(rank), bool)
    words = min(BIT_WORDS, int(rank.max()) // 64 + 1)
    for low in range(0, int(rank.max()) + 1, 64 * words):
        origin = np.flatnonzero((rank >= low) & (rank < low + 64 * words))
        word, bit = (rank[origin] - low) // 64, np.uint64(1) << ((rank[origin] - low) % 64).astype(np.uint64)
        rows = np.zeros((len(rank), words), np.uint64)
        rows[origin, word] = bit
        for hops in range(1, max_hops + 1):
            rows = _behind(a, b, rows)
            if hops > 1:
                on[origin] |= rows[origin, word] & bit != 0
                if on[origin].all():
                    break
    return on


def _closed(max_hops: int):
    """Of whole connected parts (a, b, root) the nodes (origin) on a cycle of 2 to ``max_hops`` edges; parts of about a size
    are searched together."""

    def search(batches):
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        a, b, root = (np.concatenate([np.asarray(batch.column(k)) for batch in held]) for k in ("a", "b", "root"))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        a, b = at[: len(a)], at[len(a) :]
        part = np.zeros(len(nodes), np.int64)
        part[a] = part[b] = np.unique(root, return_inverse=True)[1]
        size = np.bincount(part)
        place = np.lexsort((part, -size[part]))  # parts one after another, the largest first
        number = np.empty(len(nodes), np.int64)
        number[place] = np.arange(len(nodes))
        a, b, part = number[a], number[b], part[place]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends, rank = np.r_[starts[1:], len(part)], np.arange(len(part)) - np.repeat(starts, np.diff(np.r_[starts, len(part)]))
        first = 0
        while first < len(starts):
            largest = int(ends[first] - starts[first])
            fit = max(largest, BIT_TABLE // min(BIT_WORDS, largest // 64 + 1))
            last = min(int(np.searchsorted(ends, starts[first] + fit, side="right")), int(np.searchsorted(starts - ends, -largest // 2, side="right")))
            x, y = int(starts[first]), int(ends[max(last, first + 1) - 1])
            low, high = np.searchsorted(b, [x, y])
            on = _round(a[low:high] - x, b[low:high] - x, rank[x:y], max_hops)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[place[x:y][on]])], names=["origin"])
            first = max(last, first + 1)

    return search


def on_short(edges: DataFrame, max_hops: int) -> DataFrame:
    """(uid): nodes of ``edges`` (src, dst) on a cycle of 2 to ``max_hops`` edges; self-loops don't count.

    Connected parts of at most ``TASK_EDGES`` edges and ``BIT_NODES`` nodes are searched in one task each, many parts in a
    task, so no pairs of nodes are shuffled. Of the others only edges within strongly connected components are walked.
    Cycles of up to four edges are found from lists of ends; for longer ones walks from and to the nodes that are left
    meet half way, so a level has two sets of half the length.
    """
    ids, pairs = numbers(edges)
    few, many = _split(pairs, pairs.count(), BIT_NODES)
    out = written(few.mapInArrow(_closed(max_hops), "origin long"))
    if not many.isEmpty():
        out = out.unionByName(_walked(written(_within(many, strong(many), "component")), max_hops))
    return ids.join(apart(out.select(F.col("origin").alias("id"))), "id", "left_semi").select("uid")


def _walked(steps: DataFrame, max_hops: int) -> DataFrame:
    """(origin): nodes of ``steps`` (a, b) on a cycle of 2 to ``max_hops`` edges, by shuffled lists and walks."""
    back = steps.select(F.col("b").alias("a"), F.col("a").alias("b"))
    out = _nearby(steps, min(max_hops, 4))
    ahead, behind = (e.select(F.col("a").alias("origin"), F.col("b").alias("node")).join(apart(out), "origin", "left_anti") for e in (steps, back))
    for level in range(3, max_hops + 1) if max_hops > 4 else ():
        if level % 2:
            ahead = written(_onward(ahead, steps))
            if ahead.isEmpty():
                break
        else:
            behind = written(_onward(behind, back))
        if level > 4:
            hits = written(ahead.join(apart(behind), ["origin", "node"], "left_semi").select("origin").distinct())
            out = out.unionByName(hits)
            ahead, behind = (w.join(apart(hits), "origin", "left_anti") for w in (ahead, behind))
    return out


def _first(walk: DataFrame, *path: Column | str) -> DataFrame:
    """Of the walks of each origin to a node the first by the ids along it; lists of one length compare as the walks do."""
    return walk.groupBy("origin", "node").agg(F.min(F.concat(*path)).alias("path"))


def witnesses(edges: DataFrame, max_hops: int) -> DataFrame:
    """(uid, hops, cycle): for each node of ``edges`` (src, dst) on a cycle of 2 to ``max_hops`` edges, the first of the
    shortest such cycles by the uids along it; the uid stands at both ends. Self-loops don't count.

    Ids follow the order of uids, so walks within components are compared and carried as lists of ids. A cycle is cut in
    half: walks from each origin and walks back to it meet, each side with its first walk to a node alone, and the first
    number of edges with a meeting ends an origin's search. A level has at most as many rows as a component has pairs of
    nodes, and walks are half as long as cycles.
    """
    ids, _, steps = inside(edges)
    back = apart(steps.select(F.col("a").alias("_to"), F.col("b").alias("_from")))
    start = written(steps.select(F.col("a").alias("origin"), F.col("a").alias("node")).distinct())
    ahead = start.select("origin", "node", F.array().cast("array<bigint>").alias("path"))
    behind, found = ahead, None
    for hops in range(1, max_hops + 1):
        if hops % 2:
            on = ahead.join(apart(steps), F.col("node") == F.col("a")).select("origin", F.col("b").alias("node"), "path")
            ahead = written(_first(on, "path", F.array("node")))
        else:
            on = behind.join(back, F.col("node") == F.col("_from")).select("origin", F.col("_to").alias("node"), F.col("node").alias("by"), "path")
            behind = written(_first(on, F.array("by"), "path"))
        if hops == 1:
            continue
        rest = behind.select("origin", "node", F.col("path").alias("rest"))
        met = ahead.join(apart(rest), ["origin", "node"]).groupBy("origin").agg(F.min(F.concat("path", "rest")).alias("path"))
        hits = written(met)
        found = hits if found is None else found.unionByName(hits)
        done = apart(hits.select("origin"))
        ahead, behind = (side.join(done, "origin", "left_anti") for side in (ahead, behind))
        if ahead.isEmpty():
            break
    if found is None:
        found = start.limit(0).select("origin", F.array("node").alias("path"))
    each = found.select("origin", F.posexplode(F.concat(F.array("origin"), "path")).alias("k", "id"))
    named = each.join(apart(ids), "id").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("k", "uid"))).alias("at"))
    return named.select(F.col("at")[0]["uid"].alias("uid"), (F.size("at") - 1).cast("long").alias("hops"), F.transform("at", lambda x: x["uid"]).alias("cycle"))


def component_cycles(edges: DataFrame) -> DataFrame:
    """(component, size, cycle): for each component the first shortest cycle through its smallest uid.

    Distances spread from that node alone, each node keeping its parent of the smallest uid; the cycle is then rebuilt
    from parent to parent, for all components at once, in as many joins as the longest such cycle has edges.
    """
    ids, component, steps = inside(edges)
    named = component.join(apart(ids), "id")
    names = ids.select(F.col("id").alias("a"), F.col("uid").alias("from"))
    per = written(named.groupBy("component").agg(F.min_by("id", "uid").alias("root"), F.min("uid").alias("uid"), F.count(F.lit(1)).alias("size")))
    names = ids.select(F.col("id").alias("a"), F.col("uid").alias("from"))
    front = per.select(F.col("root").alias("node"), "root")
    seen, parents, hops = front.limit(0), None, 0
    while not front.isEmpty():
        hops += 1
        new = front.join(steps, F.col("node") == F.col("a")).join(names, "a")
        new = new.groupBy("root", F.col("b").alias("node")).agg(F.min_by("a", "from").alias("parent"))
        new = written(new.join(seen, ["root", "node"], "left_anti").withColumn("level", F.lit(hops).cast("long")))
        parents = new if parents is None else parents.unionByName(new)
        back = new.where("root = node").select("root")
        seen = written(seen.unionByName(new.select("node", "root")).join(back, "root", "left_anti"))
        front = new.join(back, "root", "left_anti").select("node", "root")
    none = per.select(F.col("uid").alias("component"), "size", F.array("uid").alias("cycle")).limit(0)
    if parents is None:
        return none
    up = written(parents.select(F.col("root").alias("r"), F.col("node").alias("n"), F.col("parent").alias("next")))
    walk = per.join(up, (F.col("root") == F.col("r")) & (F.col("root") == F.col("n"))).select("uid", "size", "root", F.col("next").alias("at"), F.array("uid").alias("cycle"))
    done = none
    while not walk.isEmpty():
        named = walk.join(ids.withColumnRenamed("uid", "name"), F.col("at") == F.col("id"))
        walk = written(named.select("uid", "size", "root", "at", F.concat(F.array("name"), "cycle").alias("cycle")))
        done = done.unionByName(walk.where("at = root").select(F.col("uid").alias("component"), "size", "cycle"))
        on = walk.where("at <> root").join(up, (F.col("root") == F.col("r")) & (F.col("at") == F.col("n")))
        walk = on.select("uid", "size", "root", F.col("next").alias("at"), "cycle")
    return done
