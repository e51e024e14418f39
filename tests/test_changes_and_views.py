"""Changes, addresses, impact paths and views on small graphs."""

import pytest
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators import mutate, traverse
from lattica.plans import addresses, impact, messaging, views


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(
        [("Function", f"f{k}", f"n{k}", "tests/a.py" if k == 5 else "a.py") for k in range(8)] + [("Task", "t1", "Task one", None), ("Knowledge", "k1", "Notes", None)],
        "label string, uid string, name string, file string",
    )
    calls = [("f0", "f1"), ("f0", "f2"), ("f1", "f3"), ("f2", "f3"), ("f3", "f4"), ("f4", "f0"), ("f5", "f4"), ("f6", "f6")]
    edges = spark.createDataFrame([("CALLS", a, b, "same-file" if b == "f3" else None) for a, b in calls] + [("AFFECTS", "t1", "f1", None), ("DESCRIBES", "k1", "f3", None)], "rel_type string, src string, dst string, resolvedBy string")
    return Graph.of(nodes, edges)


def seeds(spark, *uids):
    return spark.createDataFrame([(u,) for u in uids], "uid string")


def test_routes_keep_the_first(spark, graph):
    assert [tuple(r) for r in traverse.routes(graph, "f0", "f4", ["CALLS"], 8, 5).collect()] == [(3, ["f0", "f1", "f3", "f4"]), (3, ["f0", "f2", "f3", "f4"])]
    assert traverse.routes(graph, "f0", "f4", ["CALLS"], 2, 5).count() == 0
    assert [r.path for r in traverse.routes(graph, "f0", "f4", ["CALLS"], 8, 1).collect()] == [["f0", "f1", "f3", "f4"]]


def test_long_chains_have_waves_and_one_component(spark):
    needs = spark.createDataFrame([(f"t{k + 1}", f"t{k}") for k in range(60)], "src string, dst string")
    tasks = spark.createDataFrame([(f"t{k}",) for k in range(61)], "uid string")
    assert {(r.uid, r.wave) for r in traverse.waves(tasks, needs).collect()} == {(f"t{k}", k + 1) for k in range(61)}
    with pytest.raises(ValueError, match="CYCLE"):
        traverse.waves(tasks, needs.unionAll(spark.createDataFrame([("t0", "t5")], "src string, dst string"))).count()
    assert {r.root for r in traverse.components(needs).collect()} == {"t0"}


def test_impact_paths_budget_and_quality(spark, graph):
    p = impact.profile_of("deep", ["CALLS"])
    p = impact.Profile("in", 3, 200, 5, p.relations)
    paths, omitted = impact.explore(graph, seeds(spark, "f4"), p)
    got = {(r.uid, r.dist, r.path, r.rank) for r in paths.collect()}
    assert got == {
        ("f4", 0, "", 3), ("f3", 1, "f4:CALLS:in:f3", 0), ("f5", 1, "f4:CALLS:in:f5", 0),
        ("f1", 2, "f4:CALLS:in:f3|f3:CALLS:in:f1", 0), ("f2", 2, "f4:CALLS:in:f3|f3:CALLS:in:f2", 0),
        ("f0", 3, "f4:CALLS:in:f3|f3:CALLS:in:f1|f1:CALLS:in:f0", 0), ("f0", 3, "f4:CALLS:in:f3|f3:CALLS:in:f2|f2:CALLS:in:f0", 0),
    }
    assert omitted.count() == 0
    attached = impact.attachments(graph, paths, types=["AFFECTS", "DESCRIBES"])
    assert {tuple(r) for r in attached.select("section", "uid", "reasons").collect()} == {("tasks", "t1", "AFFECTS:f1"), ("knowledge", "k1", "DESCRIBES:f3")}
    tests = impact.selected_tests(impact.impacted(paths), graph.label("Function"))
    assert [r.uid for r in tests.collect()] == ["f5"]
    q = impact.quality(graph, p, paths, omitted, attached, tests).collect()[0]
    assert (q.edges, q.exact, q.unknown, q.omitted, q.status, q.test_selection, q.knowledge_review) == (6, 2, 4, 0, "qualified", "selected", "review-recommended")
    small = impact.Profile("in", 3, 3, 1, p.relations)
    paths, omitted = impact.explore(graph, seeds(spark, "f4"), small)
    assert {r.uid for r in paths.collect()} == {"f4", "f3", "f5"} and {r.uid for r in omitted.collect()} == {"f1", "f2"}
    assert impact.quality(graph, small, paths, omitted).collect()[0].test_selection == "incomplete"
    assert {r.confidence for r in impact.impacted(paths, stale=True).collect()} == {"unknown"}


def test_impact_seeds_and_ranks(spark, graph):
    assert impact.resolve_seeds(graph.nodes(), name="n3", label="Function").collect()[0].uid == "f3"
    with pytest.raises(ValueError, match="SEED_NOT_FOUND"):
        impact.resolve_seeds(graph.nodes(), name="none")
    with pytest.raises(ValueError, match="AMBIGUOUS_SEED"):
        impact.resolve_seeds(graph.nodes(), label="Function")
    rows = spark.createDataFrame([("CALLS", "Same-File", None), ("CALLS", "x", None), ("CONTAINS", None, None), ("INHERITS", "", None), ("CALLS", "exact", "Possible")], "rel string, by string, said string")
    assert [r[0] for r in rows.select(impact.edge_rank(F.col("rel"), F.col("by"), F.col("said"))).collect()] == [3, 2, 3, 0, 1]
    with pytest.raises(ValueError):
        impact.Profile("in", 9, 10, 1, ("CALLS",))


def test_addresses(spark):
    files = spark.createDataFrame([("F:a", "a")], "uid string, path string")
    nodes = spark.createDataFrame([("c", "a", 1, 50), ("m", "a", 2, 10), ("i", "a", 3, 4), ("d", "a", 40, 60), ("e", "a", 45, 50), ("t", "a", 1, 50), ("x", "a", None, None)], "uid string, file string, startLine long, endLine long")
    assert {r.uid: r.owner for r in addresses.containment(nodes).collect()} == {"c": None, "t": None, "m": "c", "i": "c", "d": None, "e": "d"}
    got = {r.uid: (r.ipv6, r["mask"]) for r in addresses.addresses(files, nodes).collect()}
    assert {u: m for u, (_, m) in got.items()} == {"F:a": 48, "c": 64, "t": 64, "d": 64, "m": 80, "i": 80, "e": 80}
    assert all(len(a) == 39 for a, _ in got.values()) and got["m"][0][:19] == got["c"][0][:19] and got["F:a"][0][:14] == got["c"][0][:14]
    assert addresses.subnet_members(addresses.addresses(files, nodes).selectExpr("uid name", "'x' label", "uid", "ipv6", "mask", "0 line"), got["c"][0][:19]).count() == 3


def test_changes(spark):
    nodes = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "uid string, n int, s string")
    rows = spark.createDataFrame([("b", "y"), ("c", None), ("c", "z")], "uid string, s string")
    assert {tuple(r) for r in mutate.merge_nodes(nodes, rows, {"n": F.lit(9)}).select("uid", "n", "s").collect()} == {("a", 1, "x"), ("b", 2, "y"), ("c", 9, "z")}
    assert {tuple(r) for r in mutate.set_properties(nodes, F.col("uid") == "a", {"n": F.col("n") + 1, "s": F.lit(None).cast("string")}).collect()} == {("a", 2, None), ("b", 2, None)}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c")], "src string, dst string")
    kept, left = mutate.detach_delete(nodes, edges, spark.createDataFrame([("a",)], "uid string"))
    assert [r.uid for r in kept.collect()] == ["b"] and {tuple(r) for r in left.collect()} == {("b", "c"), ("c", "c")}
    assert [r.uid for r in mutate.orphans(nodes, edges.where("src = 'c'")).orderBy("uid").collect()] == ["a", "b"]
    counters = spark.createDataFrame([("a", "b", 2, 5)], "src string, dst string, count long, lastSeen long")
    assert {tuple(r) for r in mutate.merge_counters(counters, counters.unionAll(counters.withColumn("dst", F.lit("z")))).collect()} == {("a", "b", 4, 5), ("a", "z", 2, 5)}
    assert mutate.create(nodes, rows).count() == 5


def test_views(spark, graph):
    assert {(r.direction, r.uid) for r in views.expand(graph, "f3").collect()} == {("child", "f4"), ("parent", "f1"), ("parent", "f2")}
    assert {tuple(r) for r in views.call_tree(graph, "f1", 2).collect()} == {("f1", 0, "f3"), ("f3", 1, "f4"), ("f4", 2, None)}
    assert [tuple(r) for r in views.relation_summary(graph, "f1", ["CALLS", "AFFECTS"]).collect()] == [("CALLS", 1, 1), ("AFFECTS", 1, 0)]
    assert [tuple(r) for r in views.call_context(graph, seeds(spark, "f3")).collect()] == [("f3", "n1,n2", "n4")]


def test_messaging_names(spark):
    rows = [('"cmd"', True), ("'/a/b'", True), ('"~/x"', True), ('"~"', True), ('"~n"', True), ('"1bad"', True), ("  self.f +  1", False), ("", False)]
    df = spark.createDataFrame(rows, "raw string, literal boolean")
    names = df.select(messaging.interface_name(F.col("raw"), F.col("literal")).alias("n"), (~F.col("literal")).alias("d"))
    got = [tuple(r) for r in names.select("n", messaging.resolved_name(F.col("n"), F.lit("me"), F.col("d"))).collect()]
    assert got == [("cmd", "/cmd"), ("/a/b", "/a/b"), ("~/x", "/me/x"), (None, None), ("~n", "/~n"), (None, None), ("self.f + 1", "self.f + 1"), (None, None)]
    types = ["const std_msgs::msg::String::SharedPtr &", "<std_srvs.srv.Empty>", "a/action/B*", "Foo<a, b>", "", None, "Twist"]
    df = spark.createDataFrame([(t,) for t in types], "t string").select(messaging.interface_type(F.col("t")).alias("t"))
    got = [tuple(r) for r in df.select("t", messaging.refined_kind(F.lit("topic"), F.col("t"))).collect()]
    assert got == [("std_msgs/msg/String", "topic"), ("std_srvs/srv/Empty", "service"), ("a/action/B", "action"), (None, "topic"), (None, "topic"), (None, "topic"), ("Twist", "topic")]
