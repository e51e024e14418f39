"""Walks, cycles, components and shortest paths against brute force, on small graphs with loops, returns and parallel edges."""

import collections
import itertools
import random

import pytest

from lattica import cypher
from lattica.cypher.lexer import QueryError
from lattica.graph import Graph
from lattica.operators import cycles, shortest, walks

SHAPES = {
    "loop": [("a", "a"), ("a", "b")],
    "two-cycle and loop": [("a", "b"), ("b", "a"), ("b", "b")],
    "figure of eight": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("x", "a")],
    "two triangles": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f")],
    "line": [("a", "b"), ("b", "c"), ("c", "d")],
    "none": [],
}


def graph(spark, edges, label="Function", rel="CALLS", extra=()):
    nodes = sorted({x for e in edges for x in e} | {x for e in extra for x in e[1:3]} | {"z"})
    n = spark.createDataFrame([(label, x, f"name {x}", f"{x}.py") for x in nodes], "label string, uid string, name string, path string")
    e = spark.createDataFrame([(rel, *x, None) for x in edges] + list(extra), "rel_type string, src string, dst string, resolvedBy string")
    g = Graph.of(n.withColumn("file", n.path).withColumn("params", n.uid.substr(1, 1)), e)
    if rel not in g.types:
        g._edges[rel] = lambda: e
    return g


def trails(edges, low, high, start=None, both=False):
    """All walks of low to high edges, no edge twice."""
    steps = [(a, b, k) for k, (a, b) in enumerate(edges)]
    if both:
        steps += [(b, a, k) for a, b, k in steps if a != b]
    front = [((x,), ()) for x in sorted({x for e in edges for x in e}) if start in (None, x)]
    out = [p for p, _ in front if low == 0]
    for level in itertools.count(1):
        front = [((*p, b), (*u, k)) for p, u in front for a, b, k in steps if a == p[-1] and k not in u]
        if not front or high is not None and level > high:
            return out
        if level >= low:
            out += [p for p, _ in front]


def random_edges(seed, nodes=7, n=12):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(n)})


def apart(*seeds):
    """All shapes and random graphs side by side, each with nodes of its own."""
    graphs = [*SHAPES.values(), *(random_edges(seed, 5, 8) for seed in seeds)]
    return [(f"{k}{a}", f"{k}{b}") for k, edges in enumerate(graphs) for a, b in edges]


def test_walks_and_closed_walks(spark):
    edges = apart(1, 2)
    g = graph(spark, edges)
    seeds = g.label("Function").select("uid").join(g.rel("CALLS").selectExpr("src AS uid").union(g.rel("CALLS").selectExpr("dst")), "uid", "left_semi")
    for low, high, ways in ((0, 2, ("in", "both")), (2, None, ("out",)), (3, 3, ("out",))):
        for way in ways:
            e = [(b, a) for a, b in edges] if way == "in" else edges
            got = collections.Counter(tuple(r.path) for r in walks.walks(g, seeds, ["CALLS"], low, high, way).collect())
            assert got == collections.Counter(trails(e, low, high, both=way == "both")), (low, high, way)
    for low, high, ways in ((2, 6, ("out",)), (0, 4, ("both",))):
        for way in ways:
            got = collections.Counter(tuple(r.path) for r in walks.closed(g, ["CALLS"], low, high, way).collect())
            begins = {a for a, _ in edges} | ({b for _, b in edges} if way == "both" else set())
            want = [p for p in trails(edges, low, high, both=way == "both") if p[0] == p[-1] and p[0] in begins]
            assert got == collections.Counter(want), (low, high, way)


def test_patterns_of_several_hops(spark):
    edges = apart(3)
    g, files = graph(spark, edges), graph(spark, edges, "File", "IMPORTS")
    run = lambda text, g=g, **p: cypher.run(g, text, p or None).collect()
    loops = trails(edges, 1, 5)
    got = run("MATCH (f:Function)-[:CALLS*1..5]->(f) RETURN DISTINCT elementId(f) AS uid, f.ipv6 AS ipv6, f.name AS recursiveFunction, f.file AS file LIMIT 20")
    assert sorted(r.uid for r in got) == sorted({p[0] for p in loops if p[0] == p[-1]})
    assert all(r.recursiveFunction == f"name {r.uid}" and r.ipv6 is None for r in got)
    text = "MATCH path = (a:File)-[:IMPORTS*2..6]->(a) RETURN elementId(a) AS uid, a.ipv6 AS ipv6, [n IN nodes(path) | n.path] AS importCycle"
    want = collections.Counter(tuple(f"{x}.py" for x in p) for p in trails(edges, 2, 6) if p[0] == p[-1])
    assert collections.Counter(tuple(r.importCycle) for r in run(text, files)) == want
    some = collections.Counter(tuple(r.importCycle) for r in run(text + " LIMIT 2", files))
    assert some.total() == min(2, want.total()) and some <= want
    assert collections.Counter((r.a, r.b) for r in run("MATCH (a)-[:CALLS*1..3]->(b) RETURN a.uid AS a, b.uid AS b")) == collections.Counter((p[0], p[-1]) for p in trails(edges, 1, 3))
    for hops, low, high in (("*", 1, None), ("*0..2", 0, 2), ("*2", 2, 2)):
        begins = trails(edges, low, high) + ([("z",)] if low == 0 else [])
        got = run(f"MATCH (a)-[:CALLS{hops}]->(b) RETURN DISTINCT a.uid AS a, b.uid AS b")
        assert sorted((r.a, r.b) for r in got) == sorted({(p[0], p[-1]) for p in begins}), hops
    got = run("MATCH (a) WHERE EXISTS { (a)-[:CALLS*1..4]->(a) } RETURN a.uid AS a")
    assert sorted(r.a for r in got) == sorted({p[0] for p in trails(edges, 1, 4) if p[0] == p[-1]})
    longest = max((len(p) - 1 for p in trails(edges, 1, None)), default=0)
    if longest > 1:
        with pytest.raises(QueryError, match="hops exist"):
            cypher.run(g, "MATCH (a)-[:CALLS*]->(b) RETURN count(*) AS n", most_hops=longest - 1)
    assert cypher.run(g, "MATCH (a)-[:CALLS*]->(b) RETURN count(*) AS n", most_hops=max(longest, 1)).collect()[0].n == len(trails(edges, 1, None))


def test_parallel_edges_and_clauses(spark):
    g = graph(spark, [("a", "b"), ("b", "a"), ("c", "c")], extra=[("CALLS", "a", "b", "global"), ("CALLS", "d", "d", "x"), ("CALLS", "d", "d", "y")])
    run = lambda text: sorted(map(tuple, cypher.run(g, text).collect()), key=str)
    assert run("MATCH (a)-[:CALLS*2..3]->(a) RETURN DISTINCT a.uid AS a") == [("a",), ("b",), ("d",)]
    assert run("MATCH (a)-[:CALLS*2]->(a) RETURN a.uid AS a, count(*) AS n") == [("a", 2), ("b", 2), ("d", 2)]
    assert run("MATCH (x), (y) WHERE x.params = y.params AND x.uid <= y.uid RETURN x.name + y.name AS both, x.uid + 1 AS one") == [(f"name {u}name {u}", f"{u}1") for u in "abcdz"]
    with pytest.raises(QueryError, match="every pair"):
        run("MATCH (x), (y) WHERE x.uid < y.uid RETURN x.uid AS x")
    got = run("MATCH (f) OPTIONAL MATCH (f)-[:CALLS]->(c), (c)-[:CALLS]->(d) WHERE d.uid <> 'c' RETURN f.uid AS f, d.uid AS d, count(*) AS n")
    assert got == [("a", "a", 2), ("b", "b", 2), ("c", None, 1), ("d", "d", 4), ("z", None, 1)]
    assert run("MATCH (f {uid: 'a'}) OPTIONAL MATCH (f)-[:CALLS*2..3]->(e) RETURN f.uid AS f, e.uid AS e, count(*) AS n") == [("a", "a", 2), ("a", "b", 2)]
    assert run("MATCH (f {uid: 'a'}) RETURN [1, 2] + [3] AS l, 1 + 2 AS n, f.uid + 'x' AS t") == [([1, 2, 3], 3, "ax")]


@pytest.mark.parametrize("task_edges", [0, 1 << 20])
def test_components_and_witnesses(spark, monkeypatch, task_edges):
    monkeypatch.setattr(cycles, "TASK_EDGES", task_edges)
    edges = random_edges(0, 14, 18) + [(f"p{a}", f"p{b}") for a, b in random_edges(1, 14, 20)] + [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x3", "y"), ("y", "y"), ("t1", "t2"), ("t2", "t3")]
    df = spark.createDataFrame(edges, "src string, dst string")
    reach = collections.defaultdict(set)
    for a, b in edges:
        reach[a].add(b)
    for k, i in itertools.product(sorted({x for e in edges for x in e}), repeat=2):
        if k in reach[i]:
            reach[i] |= reach[k]
    strong = {x: sorted(y for y in reach[x] if x in reach[y]) for x in list(reach) if x in reach[x]}
    want = {(x, y[0], len(y)) for x, y in strong.items() if len(y) > 1}
    assert {tuple(r) for r in cycles.components(df).collect()} == want
    plain = [e for e in edges if e[0] != e[1]]
    if not task_edges:
        return
    simple = [p for p in trails(plain, 2, 6) if p[0] == p[-1] and len(set(p)) == len(p) - 1]
    first = {}
    for p in sorted(simple, key=lambda p: (len(p), p)):
        first.setdefault(p[0], p)
    for most in (3, 6):
        assert {(r.uid, r.hops, tuple(r.cycle)) for r in cycles.witnesses(df, most).collect()} == {(x, len(p) - 1, p) for x, p in first.items() if len(p) - 1 <= most}
        assert {r.uid for r in cycles.on_short(df, most).collect()} == {x for x, p in first.items() if len(p) - 1 <= most}
    got = {r.component: (r["size"], tuple(r.cycle)) for r in cycles.component_cycles(df).collect()}
    assert set(got) == {c for _, c, _ in want}
    for root, (size, cycle) in got.items():
        assert size == len(strong[root]) and cycle[0] == cycle[-1] == root and set(itertools.pairwise(cycle)) <= set(plain)
        ring = next(p for n in range(2, 15) for p in trails(plain, n, n, root) if p[-1] == root)
        assert len(cycle) == len(ring)


def test_no_cycles(spark):
    for edges in ([("a", "b"), ("b", "c"), ("c", "c")],):
        df = spark.createDataFrame(edges, "src string, dst string")
        assert [f(df).count() for f in (cycles.components, cycles.component_cycles, lambda d: cycles.witnesses(d, 4), lambda d: cycles.on_short(d, 4))] == [0] * 4


def test_shortest_paths(spark):
    edges = random_edges(1, 12, 24)
    nodes = sorted({x for e in edges for x in e})
    pairs = [*itertools.product(nodes, repeat=2), ("n0", "nowhere"), ("nowhere", "nowhere")]
    plain, want = [e for e in edges if e[0] != e[1]], {}
    for a, b in pairs:
        front, hops = [(a,)], 0
        while front and hops <= 12:
            if hit := sorted(p for p in front if p[-1] == b):
                want[a, b] = hit
                break
            front, hops = [(*p, y) for p in front for x, y in plain if x == p[-1] and y not in p], hops + 1
    df, asked = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs + pairs[:3], "start string, target string")
    for most in (None, 3):
        fit = {k: p for k, p in want.items() if most is None or len(p[0]) - 1 <= most}
        assert {(r.start, r.target): (r.hops, r.paths) for r in shortest.shortest(df, asked, most).collect()} == {k: (len(p[0]) - 1, len(p)) for k, p in fit.items()}
        if most is None:
            continue
        got = collections.defaultdict(list)
        for r in shortest.shortest(df, asked, most, listed=True).collect():
            got[r.start, r.target].append(tuple(r.path))
        assert {k: sorted(p) for k, p in got.items()} == fit
    g = graph(spark, edges)
    run = lambda text: sorted(tuple(r.p) for r in cypher.run(g, text).collect())
    text = "MATCH p = {}((a:Function {{uid: 'n0'}})-[:CALLS*..4]->(b:Function)) WHERE b.uid <> 'n0' RETURN nodes(p) AS p"
    every = {b: p for (a, b), p in want.items() if a == "n0" != b and len(p[0]) <= 5}
    if not all(len(p) == 1 for p in every.values()):
        assert run(text.format("allShortestPaths")) == sorted(x for p in every.values() for x in p)
    assert run(text.format("shortestPath")) == sorted(p[0] for p in every.values())
    two = "MATCH (a)-[:CALLS]->(b) MATCH p = shortestPath((b)-[:CALLS*]->(a)) WHERE a.uid <> b.uid RETURN nodes(p) AS p"
    assert run(two) == sorted(want[b, a][0] for a, b in plain if (b, a) in want)
    with pytest.raises(QueryError, match="both ends"):
        run("MATCH p = shortestPath((a)-[:CALLS*]->(b)) RETURN nodes(p) AS p")
