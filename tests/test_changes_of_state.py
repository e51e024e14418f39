"""Locks, rebuilds and batches of new edges against brute force."""

import itertools
import random

import pytest

from lattica.graph import Graph
from lattica.operators import insertion, skew
from lattica.plans import locks, rebuild


def address(*groups):
    return ":".join([*groups, *["0000"] * (8 - len(groups))])


@pytest.mark.parametrize("seed", range(1))
def test_longest_prefix_and_crossing_locks(spark, seed):
    rng = random.Random(seed)
    pick = lambda: address("fd00", "0001", rng.choice("ab"), rng.choice("cd"), rng.choice("ef"), rng.choice("gh"))
    nodes = [(f"n{k}", f"name{k % 7}", pick() if k else None, rng.choice([None, "x", "y"]), f"g{k % 3}", rng.choice([None, 5, 50])) for k in range(60)]
    held = [(pick() if k else None, rng.choice([48, 64, 80]), rng.choice("xyz"), f"g{k}", rng.choice([None, 5, 50, 90])) for k in range(9)]
    df = spark.createDataFrame(nodes, "uid string, name string, ipv6 string, lockedBy string, lockGroup string, expires long")
    got = {r.uid: (r.mask, r.owner, r.lockGroup) for r in locks.covering(df, spark.createDataFrame(held, "ipv6 string, mask int, owner string, lockGroup string, expires long"), 10).collect()}
    cut = lambda ip, mask: ip.split(":")[: mask // 16]
    want = {}
    for uid, _, ip, *_ in nodes:
        live = [(-mask, -(expires or 1 << 62), owner, group) for lock, mask, owner, group, expires in held if ip and lock and cut(lock, mask) == cut(ip, mask) and (expires is None or expires > 10)]
        if live:
            best = min(live)
            want[uid] = (-best[0], best[2], best[3])
    assert got == want
    asked = [(k, rng.choice("xyz"), pick(), rng.choice([48, 64, 80])) for k in range(20)]
    found = locks.crossing(spark.createDataFrame(asked, "request long, agent string, ipv6 string, mask int"), df, 10)
    want = set()
    for k, agent, ip, mask in asked:
        over = sorted((name, uid, by, group) for uid, name, other, by, group, expires in nodes if other and by not in (None, agent) and cut(other, mask) == cut(ip, mask) and (expires is None or expires > 10))
        if over:
            want.add((k, agent, len(over), over[0][0], over[0][2], over[0][3]))
    assert {tuple(r) for r in found.collect()} == want


def one_by_one(requests, nodes):
    """Requests in order, releases and returns first: the rules for one at a time."""
    nodes, out = {n["uid"]: dict(n) for n in nodes}, {}
    of = lambda task: [n for n in nodes.values() if n["lockGroup"] == task]
    for r in requests:
        if r["new"] in locks.ACTIVE:
            continue
        changed = 0
        for n in of(r["task"]):
            if r["new"] == "done":
                n |= {"lockGroup": None, "lockStatus": None, "lockedBy": None}
                changed += 1
            elif n["lockedBy"] is not None:
                n |= {"lockStatus": "planned", "lockedBy": None}
                changed += 1
        out[r["task"]] = ("OK", changed)
    for r in sorted(requests, key=lambda r: (r["at"], r["task"])):
        if r["new"] not in locks.ACTIVE:
            continue
        if r["old"] in locks.ACTIVE:
            out[r["task"]] = ("NOOP", 0)
            continue
        mine = [n for n in of(r["task"]) if n["lockStatus"] == "planned"]
        if any(o["lockedBy"] not in (None, r["agent"]) and o["ipv6"] == n["ipv6"] for n in mine if n["ipv6"] for o in nodes.values()):
            out[r["task"]] = ("LOCK_CONFLICT", 0)
            continue
        for n in mine:
            n |= {"lockStatus": None, "lockedBy": r["agent"]}
        out[r["task"]] = ("OK", len(mine))
    return out, nodes


@pytest.mark.parametrize("seed", range(2))
def test_transitions(spark, seed):
    rng = random.Random(seed)
    tasks = [f"t{k}" for k in range(9)]
    nodes = []
    for k in range(40):
        group, state = rng.choice([None, *tasks]), rng.random()
        locked = group and state < 0.3
        nodes.append({"uid": f"n{k}", "name": f"m{k}", "ipv6": rng.choice([None, *"abcdefgh"]), "lockGroup": group, "lockStatus": "planned" if group and not locked and state < 0.95 else None, "lockedBy": rng.choice("xyz") if locked else None})
    requests = [{"task": t, "agent": rng.choice("xyz"), "old": rng.choice(["todo", "todo", "in_progress"]), "new": rng.choice(["done", "todo", "in_progress", "in_progress", "in_progress"]), "at": rng.randrange(4)} for t in tasks]
    df = spark.createDataFrame([tuple(n.values()) for n in nodes], "uid string, name string, ipv6 string, lockGroup string, lockStatus string, lockedBy string")
    results, after = locks.transitions(spark.createDataFrame([tuple(r.values()) for r in requests], "task string, agent string, old string, new string, at long"), df)
    out, state = one_by_one(requests, nodes)
    assert {r.task: (r.result, r.nodes) for r in results.collect()} == out
    assert {r.uid: r.asDict() for r in after.collect()} == state
    assert all((r.conflict is not None) == (r.result == "LOCK_CONFLICT") for r in results.collect())


def test_scope_and_waves(spark):
    n = spark.createDataFrame([("Function", x) for x in "abcd"] + [("Task", "t")], "label string, uid string")
    e = spark.createDataFrame([("CALLS", "a", "b"), ("CALLS", "c", "b"), ("CALLS", "c", "d"), ("CALLS", "t", "a")], "rel_type string, src string, dst string")
    origins = spark.createDataFrame([("a",), ("d",)], "uid string")
    got = {(r.origin, r.uid) for r in locks.scope(Graph.of(n, e), origins, ["CALLS"], 2).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("d", "c"), ("d", "b")}
    tasks = spark.createDataFrame([("p", "todo", 1), ("q", "todo", 2), ("r", "done", 2), ("s", "backlog", None), ("u", "open", 3)], "uid string, status string, wave long")
    waves = spark.createDataFrame([(1, "active"), (2, "waiting")], "wave long, status string")
    assert {tuple(r) for r in locks.barred(tasks, waves).collect()} == {("q", 2), ("u", 3)}


def test_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY", 3)
    left = spark.createDataFrame([("hot", k) for k in range(50)] + [(x, 0) for x in "abc"] + [(None, 1)], "k string, n long")
    right = spark.createDataFrame([("hot", "H"), ("a", "A"), ("z", "Z")], "k string, v string")
    assert skew.lookup(left, right, "k").groupBy("v").count().collect() and skew.lookup(left, right, "k").count() == 51
    assert {(r.k, r.v) for r in skew.lookup(left, right, "k", "left").collect()} == {("hot", "H"), ("a", "A"), ("b", None), ("c", None), (None, None)}


NODE = "uid string, label string, name string, file string, path string, owner string, params string, body string"


def test_identities_and_edges_that_come_back(spark):
    old = [
        ("same", "Function", "f", "a.py", None, None, "()", "1"),
        ("label", "Class", "L", "a.py", None, None, None, None),
        ("k1", "Function", "kept", "a.py", None, "", "()", "2"),
        ("k2", "Function", "owned", "a.py", None, "C", "()", "3"),
        ("renamed", "Function", "old name", "a.py", None, None, "(x)", "body r"),
        ("moved", "Function", "m", "a.py", None, None, "(y)", "body m"),
        ("split", "Function", "s", "a.py", None, None, "(z)", "body s"),
        ("near", "Function", "n", "a.py", None, None, "(w)", "body n"),
        ("gone", "Function", "g", "a.py", None, None, "()", "none has it"),
        ("bare", "Function", "b", "a.py", None, None, "()", None),
        ("twice", "Function", "t", "b.py", None, None, "()", None),
        ("file", "File", "a", None, "a.py", None, None, None),
        ("class", "Class", "gone class", "a.py", None, None, "(x)", "body r"),
    ]
    new = [
        ("same", "Function", "other", "z.py", None, None, "()", "9"),
        ("label", "Function", "L", "z.py", None, None, None, None),
        ("l2", "Class", "L", "a.py", None, None, None, None),
        ("n1", "Function", "kept", "a.py", None, None, "()", "changed"),
        ("n2", "Function", "owned", "a.py", None, "D", "()", "3"),
        ("n3", "Function", "owned", "a.py", None, "C", "()", "8"),
        ("r2", "Function", "new name", "a.py", None, None, "(x)", "body r"),
        ("m2", "Function", "m", "c.py", None, None, "(y)", "body m"),
        ("s1", "Function", "s1", "c.py", None, None, "(z)", "body s"),
        ("s2", "Function", "s2", "d.py", None, None, "(z)", "body s"),
        ("o1", "Function", "o", "a.py", None, None, "(w)", "body n"),
        ("o2", "Function", "o", "c.py", None, None, "(w)", "body n"),
        ("b2", "Function", "bb", "a.py", None, None, "()", None),
        ("t1", "Function", "t", "b.py", None, None, "()", "1"),
        ("t2", "Function", "t", "b.py", None, None, "()", "2"),
        ("f2", "File", "A", None, "a.py", None, None, None),
    ]
    a, b = spark.createDataFrame(old, NODE), spark.createDataFrame(new, NODE)
    known = rebuild.identities(a, b)
    want = {"same": ("same", "uid"), "label": ("l2", "name"), "k1": ("n1", "name"), "k2": ("n3", "name"), "renamed": ("r2", "body"), "moved": ("m2", "body"), "near": ("o1", "body"), "file": ("f2", "name")}
    got = {r.uid: (r.now, r.how) for r in known.collect()}
    assert got == want | dict.fromkeys(["split", "gone", "bare", "twice", "class"], (None, None))
    edges = spark.createDataFrame([("CALLS", "x", "renamed"), ("CALLS", "x", "r2"), ("CALLS", "moved", "x"), ("CALLS", "x", "split"), ("CALLS", "gone", "twice"), ("IMPORTS", "x", "y")], "rel_type string, src string, dst string")
    back, lost = rebuild.reattached(edges, known)
    assert {tuple(r) for r in back.collect()} == {("CALLS", "x", "r2"), ("CALLS", "m2", "x"), ("IMPORTS", "x", "y")} and back.count() == 3
    assert {tuple(r) for r in lost.collect()} == {("CALLS", "x", "split", "split"), ("CALLS", "gone", "twice", "gone,twice")}


def test_files_that_are_read_again(spark):
    nodes = [(f"{f}{k}", "Function", f"{f}{k}", f"{f}.py", None, None, f"({k})", f"body {f}{k}") for f in "abcd" for k in range(2)]
    edges = [("CALLS", "b0", "a0"), ("CALLS", "c0", "b0"), ("CALLS", "a0", "a1"), ("CALLS", "a1", "d0"), ("CALLS", "c1", "a1")]
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "rel_type string, src string, dst string")
    changed = spark.createDataFrame([("a.py",), (None,)], "file string")
    files = rebuild.affected(changed, n, e)
    assert {tuple(r) for r in files.collect()} == {("a.py", "changed"), ("b.py", "dependent"), ("c.py", "dependent")}
    fresh = spark.createDataFrame([("z", "Function", "a0 renamed", "a.py", None, None, "(0)", "body a0")], NODE)
    again = spark.createDataFrame([("CALLS", "z", "d1")], "rel_type string, src string, dst string")
    nodes_now, edges_now = rebuild.replaced(n, e, changed, fresh, again)
    assert {r.uid for r in nodes_now.collect()} == {"z", "b0", "b1", "c0", "c1", "d0", "d1"}
    assert {tuple(r) for r in edges_now.collect()} == {("CALLS", "b0", "z"), ("CALLS", "c0", "b0"), ("CALLS", "z", "d1")}


def accepted(edges, candidates):
    edges, out = set(edges), {}
    for a, b, place in sorted(candidates, key=lambda c: c[2]):
        seen, todo = set(), [b]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [d for s, d in edges if s == x]
        out[place] = a not in seen
        if out[place]:
            edges.add((a, b))
    return out


@pytest.mark.parametrize(("seed", "small"), [(0, 0), (1, 4096)])
def test_batches_of_edges_stay_without_cycles(spark, monkeypatch, seed, small):
    monkeypatch.setattr(insertion, "SMALL", small)
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(12)]
    base = [e for e in itertools.combinations(names, 2) if rng.random() < 0.08]
    candidates = [(rng.choice(names), rng.choice(names), place) for place in rng.sample(range(100), 22)]
    df = spark.createDataFrame(base, "src string, dst string") if base else spark.createDataFrame([], "src string, dst string")
    got = insertion.insertable(df, spark.createDataFrame(candidates, "src string, dst string, place long")).collect()
    assert {r.place: r.accepted for r in got} == accepted(base, candidates) and len(got) == len(candidates)
