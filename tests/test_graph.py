"""The graph engine on small literal graphs."""

import pytest
from pyspark.sql import functions as F

from lattica import cypher
from lattica.graph import Graph
from lattica.operators import traverse, walks
from lattica.plans import analyses as A
from lattica.plans import diff, impact, scheduling

NODE = "label string, uid string, name string, file string, path string, startLine long, endLine long, visibility string, params string, value string, acceptsProps array<string>, isComponent boolean"


def node(label, uid, name=None, file=None, path=None, start=None, end=None, visibility=None, params=None, value=None, props=None, component=None):
    return (label, uid, name or uid, file, path, start, end, visibility, params, value, props, component)


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [
        node("Function", "alpha", file="a.py", start=1, end=80, visibility="public", params="(x)", component=True),
        node("Function", "beta", file="b.py", start=1, end=9, visibility="private", params="(x)", props=["p", "q"]),
        node("Function", "leaf", file="b.py", start=10, end=12, params="()"),
        node("Function", "lone", file="c.py", visibility="private"),
        node("Function", "open", file="c.py", visibility="public"),
        node("Task", "task:1"),
        *(node("ASTNode", f"l{k}", value=v, file=f) for k, (v, f) in enumerate([("0.05", "a.py"), ("0.05", "b.py"), ("0.05", "c.py"), ("2000", "a.py"), ("2000", "b.py"), ("404", "a.py"), ("404", "b.py"), ("3", "a.py"), ("3", "b.py"), ("7777", "x/test/a.py"), ("7777", "x/test/b.py"), ("8443", "a.py")])),
    ]
    edges = [("CALLS", "alpha", "beta"), ("CALLS", "beta", "alpha"), ("CALLS", "alpha", "leaf"), ("AFFECTS", "task:1", "lone"), ("PASSES_PROP", "alpha", "beta")]
    e = spark.createDataFrame(edges, "rel_type string, src string, dst string").withColumn("props", F.when(F.col("rel_type") == "PASSES_PROP", F.array(F.lit("p")))).withColumn("hasSpread", F.lit(None).cast("boolean"))
    return Graph.of(spark.createDataFrame(nodes, NODE), e)


def test_recursion_and_dead_code(graph):
    assert {r.uid for r in A.recursion(graph).collect()} == {"alpha", "beta"}
    got = {r.uid: (r.category, r.analysisConfidence) for r in A.dead_code(graph).collect()}
    assert got == {"lone": ("planned_stub", "none"), "open": ("public_no_static_caller", "low")}
    assert [r.uid for r in A.entry_points(graph).collect()] == []


def test_magic_numbers(graph):
    rows = A.magic_numbers(graph).collect()
    assert [(r.number, r.numberKind, r.analysisConfidence) for r in rows] == [("0.05", "precise_decimal", "high"), ("2000", "large_integer", "medium"), ("404", "standard_code", "low")]
    sites = A.magic_number_sites(graph).collect()
    assert "8443" in {r.number for r in sites} and {r.function for r in sites} == {"(module level)"}


def test_props_and_lookups(graph):
    assert [r.missingProps for r in A.missing_props(graph).collect()] == [["q"]]
    assert {r.term: r.hits for r in A.verify_terms(graph, ["leaf", "none"]).collect()} == {"leaf": 1, "none": 0}
    assert graph.validate().count() == 0
    assert {r.uid for r in graph.label("Component").collect()} == {"alpha"}
    with pytest.raises(ValueError):
        graph.label("Nothing")


def test_routes(spark):
    edges = [("CALLS", a, b) for a, b in [("a", "b"), ("a", "c"), ("a", "slow"), ("b", "z"), ("slow", "later"), ("later", "z")]] + [("RENDERS", "c", "z")]
    names = sorted({x for _, *p in edges for x in p})
    g = Graph.of(spark.createDataFrame([node("Function", n) for n in names], NODE), spark.createDataFrame(edges, "rel_type string, src string, dst string"))
    assert [r.path for r in traverse.routes(g, "a", "z", ["CALLS", "RENDERS"], 8, 5).collect()] == [["a", "b", "z"], ["a", "c", "z"]]
    assert traverse.routes(g, "z", "a", ["CALLS"], 8, 5).count() == 0
    assert {(r.uid, r.dist) for r in impact.impact(g, spark.createDataFrame([("z",)], "uid string"), ["CALLS", "RENDERS"], "balanced").collect()} == {("z", 0), ("b", 1), ("c", 1), ("later", 1), ("a", 2), ("slow", 2)}


def test_waves_and_groups(spark):
    tasks = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t4",)], "uid string")
    needs = spark.createDataFrame([("t2", "t1"), ("t3", "t2"), ("t4", "t1")], "src string, dst string")
    assert {r.uid: r.wave for r in traverse.waves(tasks, needs).collect()} == {"t1": 1, "t2": 2, "t4": 2, "t3": 3}
    with pytest.raises(ValueError, match="CYCLE"):
        traverse.waves(tasks, needs.union(spark.createDataFrame([("t1", "t3")], "src string, dst string"))).collect()
    affects = spark.createDataFrame([("t1", "f"), ("t2", "g"), ("t3", "h")], "src string, dst string")
    files = spark.createDataFrame([("f", "x.py"), ("g", "x.py"), ("h", "y.py")], "uid string, file string")
    got = {r.uid: r.root for r in scheduling.shared_file_groups(affects, files).collect()}
    assert got["t1"] == got["t2"] != got["t3"]


def test_diff(spark):
    cols = "label string, name string, file string, startLine long, endLine long, signature string, bodySnippet string"
    base = spark.createDataFrame([("Function", "f", "a", 1, 5, "()", "x"), ("Function", "g", "a", 6, 9, "()", "y"), ("Function", "h", "a", 10, 12, "()", None)], cols)
    head = spark.createDataFrame([("Function", "f", "a", 3, 7, "()", "x"), ("Function", "g", "a", 8, 12, "(z)", "y"), ("Function", "n", "a", 20, 22, "()", None)], cols)
    got = {r.name: (r.status, r.reasons) for r in diff.node_diff(diff.snapshot_nodes(base), diff.snapshot_nodes(head)).collect()}
    assert got == {"g": ("changed", "signature,span"), "h": ("removed", ""), "n": ("added", "")}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (f:Function)-[:CALLS]->(c:Function) RETURN f.name AS f, c.name AS c ORDER BY f, c", [("alpha", "beta"), ("alpha", "leaf"), ("beta", "alpha")]),
        ("MATCH (f:Function) WHERE NOT ()-[:CALLS]->(f) RETURN f.name AS f ORDER BY f", [("lone",), ("open",)]),
        ("MATCH (f:Function) OPTIONAL MATCH (f)-[:CALLS]->(c) RETURN f.name AS f, count(c) AS n ORDER BY n DESC, f LIMIT 2", [("alpha", 2), ("beta", 1)]),
        ("MATCH (f:Function {name: 'alpha'})-[:CALLS*1..2]->(c) RETURN DISTINCT c.uid AS c ORDER BY c", [("alpha",), ("beta",), ("leaf",)]),
        ("MATCH (f:Function) WHERE f.name STARTS WITH 'l' AND NOT f:Component RETURN f.name AS f, CASE WHEN f.file = 'c.py' THEN 1 ELSE 0 END AS k ORDER BY f", [("leaf", 0), ("lone", 1)]),
        ("UNWIND [1, 2, 3] AS x WITH x WHERE x > 1 RETURN x, [y IN [1, 5] WHERE y > x | y * 2] AS ys ORDER BY x", [(2, [10]), (3, [10])]),
        ("MATCH (f:Function) WHERE f.name = $n RETURN f.file AS file UNION MATCH (f:Function) WHERE f.name = 'beta' RETURN f.file AS file", [("b.py",)]),
        ("MATCH (f:Function) WHERE EXISTS { MATCH (f)-[:CALLS]->(c) WHERE c.name = 'leaf' } RETURN f.name AS f", [("alpha",)]),
        ("MATCH (f:Function) WHERE NOT EXISTS { (f)-[:CALLS]->() } AND f.file <> 'c.py' RETURN f.name AS f", [("leaf",)]),
        ("MATCH (f:Function) WHERE (f)-[:CALLS]->(:Function {name: 'leaf'}) OR NOT ()-[:CALLS]->(f) RETURN f.name AS f ORDER BY f", [("alpha",), ("lone",), ("open",)]),
        ("MATCH (f:Function) WHERE f.file = 'b.py' AND (f.name = 'leaf' OR EXISTS { MATCH (f)-[:CALLS]->() }) RETURN f.name AS f ORDER BY f", [("beta",), ("leaf",)]),
        ("MATCH (f:Function) WHERE f.file = 'b.py' RETURN f.name AS f, EXISTS { (f)-[:CALLS]->() } AS calls ORDER BY f", [("beta", True), ("leaf", False)]),
        ("MATCH p = (f:Function)-[:CALLS*1..3]->(c) WHERE f.name = 'beta' AND c.name <> 'beta' RETURN nodes(p) AS n, rels(p) AS r, length(p) AS k ORDER BY k", [(["beta", "alpha"], [("beta", "alpha")], 1), (["beta", "alpha", "leaf"], [("beta", "alpha"), ("alpha", "leaf")], 2)]),
        ("MATCH p = (f:Function)-[:CALLS]->(c) WHERE c.name = 'leaf' RETURN nodes(p) AS n", [(["alpha", "leaf"],)]),
        ("MATCH (f:Function {name: 'leaf'})<-[:CALLS*1..2]-(c) RETURN c.name AS c ORDER BY c", [("alpha",), ("beta",)]),
        ("MATCH (f:Function) WHERE f.name =~ ('l' + '.+') RETURN f.name + '!' AS f ORDER BY f", [("leaf!",), ("lone!",)]),
        ("MATCH (f:Function) WHERE f.name =~ 'lea.' RETURN {name: f.name, at: f.startLine} AS m", [(("leaf", 10),)]),
        ("MATCH (f:Function) WHERE f.file = 'b.py' RETURN [x IN collect({n: f.name}) WHERE x.n = 'leaf' | x.n] AS ns", [(["leaf"],)]),
        (r"RETURN '\u0416\u00e9\n' AS s, timestamp() > 0 AS t", [("Жé\n", True)]),
    ],
)
def test_cypher(graph, text, want):
    assert [tuple(r) for r in cypher.run(graph, text, {"n": "leaf"}).collect()] == want


@pytest.mark.parametrize("text", ["CREATE (n)", "MATCH (n) DELETE n", "/*x*/DELETE n", "MATCH (n) RETURN n; MATCH (m) RETURN m", "MATCH (n) SET n.x = 1 RETURN n", ""])
def test_guard_rejects(text):
    with pytest.raises(cypher.QueryError):
        cypher.check_read_only(text)


@pytest.mark.parametrize("text", ["MATCH (f:Function) WHERE EXISTS { (g)-[:CALLS]->() } RETURN f.name", "MATCH (f:Function) RETURN g.name", "MATCH (f:Function) RETURN nodes(p)"])
def test_cypher_names_what_is_missing(graph, text):
    with pytest.raises(cypher.QueryError):
        cypher.run(graph, text)


def test_cypher_starts_walks_at_named_nodes(graph, monkeypatch):
    seen = []
    walk = walks.walks
    monkeypatch.setattr(walks, "walks", lambda g, seeds, *a, **k: seen.append(seeds.count()) or walk(g, seeds, *a, **k))
    rows = cypher.run(graph, "MATCH (f:Function)-[:CALLS*]->(c) WHERE f.name = 'beta' AND c.name = 'leaf' RETURN c.uid AS c").collect()
    assert [r.c for r in rows] == ["leaf"] and seen == [1]


def test_guard_accepts():
    assert cypher.check_read_only("MATCH (n) WHERE n.name = 'DELETE' RETURN n.set AS x // SET")


def test_stream_counts_hold_on_replay(spark, tmp_path):
    from lattica.streaming import events

    src = spark.createDataFrame([(1, "2024-01-01 00:00:00", 7, "click"), (2, "2024-01-01 00:01:00", 7, "view"), (2, "2024-01-01 00:01:00", 7, "view")], "event_id long, ts string, user_id long, event_type string")
    src.select("event_id", F.to_timestamp("ts").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("{}").alias("props")).coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = events.count_types(events.event_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ckpt")
        q.awaitTermination()
    assert {r.event_type: r.n for r in events.totals(spark, f"{tmp_path}/out").collect()} == {"click": 1, "view": 1}
