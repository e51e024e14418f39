"""The call-graph queries over all calls, against brute force on small star-schema tables."""

import itertools
import random

import pytest

import __spark_entry__

PARTS, SUPPLIERS, NATIONS = 24, 5, 3


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    rng, at = random.Random(5), str(tmp_path_factory.mktemp("star"))
    part = [(k, f"part {k % 9}", f"Brand#{k % 5}", "T", k % 7) for k in range(PARTS)]
    # lines climb, so there are functions without callers; the last orders close cycles
    line = [(o, p, rng.randrange(SUPPLIERS), n) for o in range(12) for n, p in enumerate(sorted(rng.sample(range(PARTS), 3)))]
    line += [(o, p, s, n) for o, (a, b) in enumerate([(9, 4), (15, 11)], 12) for n, (p, s) in enumerate([(a, 0), (b, 1), (a, 2)])]
    line += [(14, p, 0, n) for n, p in enumerate([6, 6, 8, 8])]  # two functions call themselves: the seeds of reach and impact
    tables = {
        "part": (part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "events": ([], "event_id long, ts timestamp, user_id long, event_type string, value double"),
        "supplier": ([(k, f"S{k}", k % NATIONS) for k in range(SUPPLIERS)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(k, f"N{k}") for k in range(NATIONS)], "n_nationkey int, n_name string"),
        "orders": ([(o, o % 4, "F", "1") for o in range(15)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "lineitem": ([(*r, 1.0) for r in line], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    calls = {(a[1], b[1]) for a, b in itertools.pairwise(sorted(line, key=lambda r: (r[0], r[3]))) if a[0] == b[0]}
    return at, part, line, calls


def fn(k):
    return f"Function:{k}"


def distances(edges, start, most):
    seen = {start: 0}
    for d in range(1, most + 1):
        for b in {b for a, b in edges if seen.get(a) == d - 1}:
            seen.setdefault(b, d)
    return seen


def on_cycle(edges, most):
    """Nodes on a closed walk of at most ``most`` edges."""
    return {s for s, t in edges if s == t or distances(edges, t, most - 1).get(s) is not None}


def simple_paths(edges, start, most):
    out, front = [], [(start,)]
    for _ in range(most):
        front = [(*p, b) for p in front for a, b in edges if a == p[-1] and b not in p]
        out += front
    return out


def test_queries_take_all_calls(spark, star):
    at, part, line, calls = star
    run = lambda name: __spark_entry__.queries()[name](spark, at).collect()
    src, dst = {a for a, _ in calls}, {b for _, b in calls}
    assert {r.uid for r in run("dead_code")} == {fn(k) for k in range(PARTS) if k not in dst}
    assert {r.uid for r in run("entry_points")} == {fn(k) for k in src - dst}
    assert {r.uid for r in run("recursion")} == {fn(k) for k in on_cycle(calls, 5)}
    files = {(f"File:{part[a][2]}", f"File:{part[b][2]}") for a, b in calls if part[a][2] != part[b][2]}
    assert {r.uid for r in run("circular_imports")} == on_cycle(files, 6)
    assert {(r.uid, r.callee) for r in run("callers_of_function")} == {(fn(a), fn(b)) for a, b in calls if part[b][1] == "part 0"}
    steps = {(a, b) for a, b in calls if a != b}
    seeds = {a for a, b in calls if a == b}
    want = {(fn(o), fn(n), d) for o in seeds for n, d in distances(steps, o, 3).items()}
    assert {tuple(r) for r in run("reach")} == want
    back = {(b, a) for a, b in steps}
    assert {(r.seed, r.uid, r.dist) for r in run("impact")} == {(fn(o), fn(n), d) for o in seeds for n, d in distances(back, o, 2).items()}
    hub = min(src, key=lambda k: (-sum(a == k for a, _ in steps), fn(k)))
    chains = simple_paths(steps, hub, 8)
    assert [(r.hops, r.callChain) for r in run("call_chain")] == sorted((len(p) - 1, ",".join(map(fn, p))) for p in chains)[:30]
    target = max((p[-1] for p in chains if len(p) == 3), key=fn)
    least = min(len(p) for p in chains if p[-1] == target)
    routes = sorted([fn(k) for k in p] for p in chains if p[-1] == target and len(p) == least)[:5]
    assert [r.path for r in run("shortest_routes")] == [",".join(p) for p in routes]
    near = distances(steps | back, hub, 2)
    assert {tuple(r) for r in run("induced_subgraph")} == {("CALLS", fn(a), fn(b)) for a, b in calls if a in near and b in near}
    pairs = [(a, b) for a, b in itertools.product(range(PARTS), repeat=2) if part[a][1] < part[b][1]]
    callers, callees = ({k: {x for x in range(PARTS) if pick(k, x) in calls} for k in range(PARTS)} for pick in (lambda k, x: (x, k), lambda k, x: (k, x)))
    named = lambda s: ",".join(sorted({part[k][1] for k in s}))
    want = {(fn(a), fn(b), named(callers[a] & callers[b]), named(callees[a] & callees[b])) for a, b in pairs if callers[a] & callers[b] and callees[a] & callees[b]}
    assert {(r.uid, r.uidB, r.sharedCallers, r.sharedCallees) for r in run("duplicate_functions_by_callers_and_callees")} == want
    hits = [(part[a][2], b) for a, b in calls if part[a][4] % 2 == 0 and b not in src]
    want = sorted(((f, sum(x == f for x, _ in hits), len({b for x, b in hits if x == f})) for f in {f for f, _ in hits}), key=lambda r: (-r[1], r[0]))
    assert [tuple(r) for r in run("pattern_query")] == want[:10]
    owner = {p: min(f"Class:{s}" for _, q, s, _ in line if q == p) for _, p, _, _ in line}
    uses = [(owner[a], owner[b]) for a, b in calls if owner[a] != owner[b]]
    first = {k: f"Class:{k % NATIONS}" for k in range(SUPPLIERS)}
    strong = {(f"Class:{k}", c) for k, c in first.items() if f"Class:{k}" != c} | {(owner[p], f"Class:{s}") for _, p, s, _ in line if owner[p] != f"Class:{s}"}
    want = {(*u, uses.count(u)) for u in uses if uses.count(u) >= 2 and u not in strong}
    assert {(r.src, r.dst, r.calls) for r in run("class_relations") if r.kind == "uses"} == want


@pytest.mark.parametrize("most", [2, 3, 4, 5, 6])
def test_cyclic_meets_half_way(spark, most):
    from lattica.graph import Graph
    from lattica.operators import traverse

    rings = [(f"r{n}.{k}", f"r{n}.{(k + 1) % n}") for n in range(1, 8) for k in range(n)] + [("in", "r3.0"), ("r5.2", "out")]
    e = spark.createDataFrame([("CALLS", *r) for r in rings], "rel_type string, src string, dst string")
    n = spark.createDataFrame([("Function", x) for x in sorted({x for r in rings for x in r})], "label string, uid string")
    got = [r.uid for r in traverse.cyclic(Graph.of(n, e), ["CALLS"], most).collect()]
    assert sorted(got) == sorted(f"r{n}.{k}" for n in range(2, most + 1) for k in range(n))
