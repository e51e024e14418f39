"""Plans that hold at size: no pairs where sums do, nothing large sent whole."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica.llm import vocab
from lattica import catalogue
from lattica.cypher import run
from lattica.graph import Graph
from lattica.operators import budget, cycles, intervals, skew, weak
from lattica.plans import analyses, conformance, locks, scope
from lattica.sources import dom
from lattica.sources.star import star_graph


def executed(spark: SparkSession, run: Callable[[], object]) -> list[tuple[str, int]]:
    """The operators of all queries that ``run`` executes, with the rows that each gives (0 if it doesn't count them)."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60000)
    out, found = [], store.executionsList()
    for k in range(before, found.size()):
        number = found.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for i in range(nodes.size()):
            metrics = nodes.apply(i).metrics()
            rows = [metrics.apply(j).accumulatorId() for j in range(metrics.size()) if metrics.apply(j).name() == "number of output rows"]
            counts = [values.get(x).get() for x in rows if values.contains(x)]
            out.append((nodes.apply(i).name(), int(counts[0].replace(",", "")) if counts else 0))
    return out


def test_crossing_locks_of_one_subnet_make_no_pairs_of_owners(spark):
    n = 1500
    ip = "fd00:0001:0001:0002:0003:0000:0000:0000"
    nodes = spark.createDataFrame([(f"n{k}", f"name{k:05}", ip, f"o{k}", f"g{k}", None) for k in range(n)], "uid string, name string, ipv6 string, lockedBy string, lockGroup string, expires long")
    asked = spark.createDataFrame([(k, f"o{k}", ip, 48) for k in range(n)], "request long, agent string, ipv6 string, mask int")
    got = []
    steps = executed(spark, lambda: got.extend(locks.crossing(asked, nodes, 10).collect()))
    assert sorted(tuple(r) for r in got) == [(k, f"o{k}", n - 1, "name00001" if k == 0 else "name00000", "o1" if k == 0 else "o0", "g1" if k == 0 else "g0") for k in range(n)]
    joins = [rows for name, rows in steps if "Join" in name]
    assert joins and max(joins) <= 4 * n


def test_element_trees_are_not_sent_whole(spark):
    pages = spark.createDataFrame([(k, f"u{k}", "<div><ul>" + "<li><b>x</b></li>" * 5 + "</ul></div>") for k in range(20)], "page_id long, url string, html string")

    def run():
        tree = dom.tree(pages)
        assert tree.count() == 20 * 12
        again = tree.selectExpr("page_id AS p", "n AS m")
        assert tree.join(again, (tree.page_id == again.p) & (tree.parent == again.m)).count() == 20 * 11

    assert not [name for name, _ in executed(spark, run) if "Broadcast" in name]


def test_components_are_not_sent_whole(spark, monkeypatch):
    monkeypatch.setattr(cycles, "TASK_EDGES", 4)  # labels spread, then the rest is searched
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e")], "src string, dst string")
    got = []
    steps = executed(spark, lambda: got.extend(cycles.components(edges).collect()))
    assert sorted(tuple(r) for r in got) == [("a", "a", 2), ("b", "a", 2), ("c", "c", 2), ("d", "c", 2)]
    assert not [name for name, _ in steps if "Broadcast" in name]


def test_pieces_join_in_order_and_in_less_memory():
    pieces = lambda keys, sizes: vocab._Pieces(np.array(keys, np.uint64), np.cumsum(sizes) - sizes, np.array(sizes), np.repeat(np.array(keys, np.uint32), sizes))
    both = pieces([2, 5, 9], [1, 3, 2]).joined(pieces([1, 5 + 2, 11], [2, 1, 4]))
    assert both.keys.tolist() == [1, 2, 5, 7, 9, 11]
    assert [both.ids[a : a + n].tolist() for a, n in zip(both.at.tolist(), both.size.tolist(), strict=True)] == [[1] * 2, [2], [5] * 3, [7], [9] * 2, [11] * 4]
    assert both.at.dtype == both.size.dtype == np.uint32


def test_pairs_of_one_signature_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "PAIRS", 200)
    rows = [(f"f{k}", f"name{k % 40:02}", f"file{k}", None if k % 20 == 0 else "()" if k % 20 == 1 else "(int)" if k % 20 < 18 else f"({k % 3})") for k in range(120)]
    nodes = spark.createDataFrame(rows, "uid string, name string, file string, params string")
    g = Graph(spark, {"Function": lambda: nodes}, {})
    want = sorted((a[0], b[0], a[3]) for a in rows for b in rows if a[3] == b[3] not in (None, "()") and a[1] < b[1])
    out = analyses.duplicate_functions_by_signature(g)
    assert sorted((r.fileA.replace("file", "f"), r.fileB.replace("file", "f"), r.sharedSignature) for r in out.collect()) == want
    pattern = run(g, "MATCH (a:Function), (b:Function) WHERE a.params = b.params AND a.params <> '()' AND a.name < b.name RETURN elementId(a) AS a, elementId(b) AS b, a.params AS params")
    assert sorted(tuple(r) for r in pattern.collect()) == want
    for df in (out, pattern):
        sizes = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(sizes) > 8 and max(sizes) < len(want) / 4


def test_short_cycles_through_a_hub_are_found_without_all_its_walks(spark):
    n = 300
    edges = spark.createDataFrame([(f"x{k}", "h") for k in range(n)] + [("h", f"y{k}") for k in range(n)] + [(f"y{k}", "z") for k in range(n)] + [("z", f"x{k}") for k in range(n)], "src string, dst string")
    got = []
    steps = executed(spark, lambda: got.extend(cycles.on_short(edges, 5).collect()))
    assert sorted(r.uid for r in got) == sorted([f"{x}{k}" for x in "xy" for k in range(n)] + ["h", "z"])
    assert max(rows for name, rows in steps if "Join" in name) <= 8 * n


def test_short_cycles_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (100, 2))} | {(100 + k, 100 + (k + 1) % 5) for k in range(5)} | {(200 + k, 200 + (k + 1) % 6) for k in range(6)} | {(300, 301), (301, 302), (302, 300)}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    step = np.zeros((400, 400), bool)
    for a, b in pairs:
        step[a, b] = a != b
    walk, on = step.copy(), np.zeros(400, bool)
    for hops in range(2, 7):
        walk = walk @ step
        on |= walk.diagonal()
        assert sorted(r.uid for r in cycles.on_short(edges, hops).collect()) == sorted(f"n{k}" for k in np.flatnonzero(on))


def test_functions_that_share_one_callee_make_no_rows_of_pairs_in_joins(spark):
    n = 200
    fn = [(f"f{k:03}", f"name{k % 150:03}", f"file{k % 7}") for k in range(n)] + [("h", "hub", "x"), ("i", None, "x"), ("j", "sub", "x")]
    calls = [(f"f{k:03}", "h") for k in range(n)] + [("f003", "i"), ("f004", "i"), ("f155", "j"), ("f007", "j"), ("i", "f003"), ("i", "f004"), ("j", "f009"), ("j", "f004")]
    g = Graph(spark, {"Function": lambda: spark.createDataFrame(fn, "uid string, name string, file string")}, {"CALLS": lambda: spark.createDataFrame(calls, "src string, dst string")})
    got = []
    steps = executed(spark, lambda: got.extend(analyses.duplicate_functions_by_callees(g).collect()))
    assert sorted((r.uid, r.funcA, r.fileA, r.funcB, r.sharedCallees, r.overlap) for r in got) == [("f003", "name003", "file3", "name004", "hub", 2), ("f155", "name005", "file1", "name007", "hub,sub", 2)]
    assert max(rows for name, rows in steps if "Join" in name) <= 4 * n
    got.clear()
    steps = executed(spark, lambda: got.extend(analyses.duplicate_functions_by_callers_and_callees(g).collect()))
    assert sorted((r.uid, r.uidB, r.sharedCallers, r.sharedCallees) for r in got) == [("f003", "f004", "", "hub"), ("f004", "f009", "sub", "hub")]
    assert max(rows for name, rows in steps if "Join" in name) <= 4 * n


def test_edges_are_told_apart_by_numbers(spark):
    for name in ("CALLS", "CALLS_FINISHED", "HAS_METHOD", "AFFECTS", "WRITES_STATE"):
        edges = star_graph(spark, "/root/testdata/sf0.001").rel(name)
        assert edges.schema.simpleString() == "struct<src:string,dst:string>"
        assert "hashpartitioning(src" not in edges._jdf.queryExecution().executedPlan().toString()
        assert name == "CALLS_FINISHED" or "ReadSchema: struct<src:string" not in edges._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_a_budget_walk_make_no_joins(spark):
    n = 60
    nodes = spark.createDataFrame([(f"n{k:02}", "A") for k in range(n)], "uid string, label string")
    edges = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in range(n - 1)], "src string, dst string")
    got = []
    steps = executed(spark, lambda: got.extend(budget.connected(nodes, edges, 20).collect()))
    assert len(got) == 20
    assert sum("Join" in name for name, _ in steps) <= 8


def test_a_level_report_meets_the_labels_once(spark):
    nodes = {"Function": [("f1",), ("f2",), ("f3",)], "File": [("a",), ("b",)]}
    g = Graph(spark, {x: lambda x=x: spark.createDataFrame(nodes[x], "uid string") for x in nodes}, {"CALLS": lambda: spark.createDataFrame([("f1", "f2"), ("f3", "f3"), ("f1", "gone")], "src string, dst string"), "CONTAINS": lambda: spark.createDataFrame([("a", "f1")], "src string, dst string")})
    got = []
    steps = executed(spark, lambda: got.extend(scope.report(g, 1).collect()))
    assert sorted(tuple(r) for r in got) == [("File", 2, 1, "Function"), ("Function", 3, 2, "File")]
    assert sum("Join" in name for name, _ in steps) <= 4


def test_first_cycles_come_from_walks_of_half_their_length(spark):
    wide = 100
    edges = [(f"n{k}_{i}", f"n{(k + 1) % 6}_{(i * 7 + j * j * 31 + k) % wide}") for k in range(6) for i in range(wide) for j in range(3)]
    got = []
    ran = executed(spark, lambda: got.extend(cycles.witnesses(spark.createDataFrame(edges, "src string, dst string"), 6).collect()))
    assert got and all(r.hops == 6 and r.cycle[0] == r.cycle[6] == r.uid and set(zip(r.cycle, r.cycle[1:])) <= set(edges) for r in got)
    # walks of three edges, 27 from each node; five edges lead to nearly all nodes of a layer
    assert max(n for _, n in ran) <= 6 * wide * 27


def test_small_parts_of_a_large_graph_are_searched_without_rounds(spark, monkeypatch):
    monkeypatch.setattr(cycles, "TASK_EDGES", 8)
    monkeypatch.setattr(cycles, "_spread", None)
    edges = [(3 * k + i, 3 * k + (i + 1) % 3) for k in range(20) for i in range(3)] + [(100 + k, 101 + k) for k in range(5)]
    got = {tuple(r) for r in cycles.strong(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, x - x % 3) for x in range(60)}


def test_tasks_of_innermost_spans_grow_in_number_only(spark, monkeypatch):
    monkeypatch.setattr(intervals, "ROWS", 100)
    points = spark.range(1000).select(F.lit("f").alias("file"), F.col("id").alias("line"))
    spans = spark.range(100).select(F.lit("f").alias("file"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 8).alias("end"), F.col("id").cast("string").alias("uid"))
    found = intervals.innermost(points, spans, "file")
    assert {(r.line, r.inner) for r in found.collect()} == {(x, None if x % 10 == 9 else str(x // 10)) for x in range(1000)}
    plan = intervals.innermost(points, spans, "file")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") >= 3 and ", 10" in plan


def test_short_cycles_of_small_parts_are_found_without_lists(spark, monkeypatch):
    monkeypatch.setattr(cycles, "_nearby", None)
    n = 150
    edges = [(f"x{k}", "h") for k in range(n)] + [("h", f"y{k}") for k in range(n)] + [(f"y{k}", f"x{k}") for k in range(3)] + [("p", "q"), ("q", "p"), ("p", "s")] + [(f"r{k}", f"r{(k + 1) % 6}") for k in range(6)]
    found = cycles.on_short(spark.createDataFrame(edges, "src string, dst string"), 5)
    assert sorted(r.uid for r in found.collect()) == sorted(["h", "p", "q"] + [f"{x}{k}" for x in "xy" for k in range(3)])


def _cyclic_by_brute_force(pairs, hops: int) -> list[int]:
    step = np.zeros((400, 400), bool)
    for a, b in pairs:
        step[a, b] = a != b
    walk, on = step.copy(), np.zeros(400, bool)
    for _ in range(2, hops + 1):
        walk = walk @ step
        on |= walk.diagonal()
    return np.flatnonzero(on).tolist()


def _parts_of_all_sizes() -> set[tuple[int, int]]:
    rng = np.random.default_rng(7)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 200, (330, 2))} | {(250 + k, 250 + (k + 1) % 5) for k in range(5)} | {(260 + k, 260 + (k + 1) % 6) for k in range(6)} | {(270, 271), (271, 270), (271, 272)}
    return {(a, b) for a, b in pairs | {(int(a), int(b)) for a, b in rng.integers(300, 330, (40, 2))} if a != b}


@pytest.mark.parametrize("nodes", [1 << 16, 20, 0])
def test_short_cycles_of_parts_of_all_sizes_are_those_of_brute_force(spark, monkeypatch, nodes):
    monkeypatch.setattr(cycles, "BIT_NODES", nodes)
    pairs = _parts_of_all_sizes()
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    for hops in (2, 5):
        assert sorted(r.uid for r in cycles.on_short(edges, hops).collect()) == sorted(f"n{k}" for k in _cyclic_by_brute_force(pairs, hops))


@pytest.mark.parametrize(("words", "table", "few"), [(1, 1, 0), (1, 1 << 22, 1000), (2, 128, 2), (32, 1 << 22, 32)])
def test_rows_of_bits_of_any_width_find_the_same_cycles(monkeypatch, words, table, few):
    for name, value in (("BIT_WORDS", words), ("BIT_TABLE", max(table, 64)), ("BIT_FEW", few)):
        monkeypatch.setattr(cycles, name, value)
    pairs = sorted(_parts_of_all_sizes())
    a, b = np.array(pairs).T
    nodes, roots = weak.local_labels(a, b)
    root = roots[np.searchsorted(nodes, a)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x[k::2]) for x in (a, b, root)], names=["a", "b", "root"]) for k in (0, 1)]
    for hops in range(2, 7):
        assert sorted(x for batch in cycles._closed(hops)(iter(batches)) for x in batch.column("origin").to_pylist()) == _cyclic_by_brute_force(pairs, hops)


def _alike(spark):
    rows = [(f"f{k:03}", f"n{k % 4}" if k % 9 else None, f"file{k % 2}", f"({k % 2})", k) for k in range(200)]
    g = Graph(spark, {"Function": lambda: spark.createDataFrame(rows, "uid string, name string, file string, params string, k long")}, {})
    return g, [(a, b) for a in rows for b in rows if a[3] == b[3] and a[1] and b[1] and a[1] < b[1]]


def test_functions_of_one_signature_that_look_alike_are_paired_once(spark, monkeypatch):
    monkeypatch.setattr(skew, "EQUAL", 16)
    (g, want), got = _alike(spark), []
    steps = executed(spark, lambda: got.extend(analyses.duplicate_functions_by_signature(g).collect()))
    assert sorted(tuple(r) for r in got) == sorted((*a[1:3], *b[1:4]) for a, b in want)
    assert 0 < max(n for name, n in steps if "Join" in name) <= len(want) / 5


def test_nodes_of_a_pattern_that_look_alike_are_paired_once(spark, monkeypatch):
    monkeypatch.setattr(skew, "EQUAL", 16)
    (g, want), got = _alike(spark), []
    text = "MATCH (a:Function), (b:Function) WHERE a.params = b.params AND a.name < b.name "
    steps = executed(spark, lambda: got.extend(run(g, text + "RETURN elementId(a) AS a, a.name + b.name AS names").collect()))
    assert sorted(tuple(r) for r in got) == sorted((a[0], a[1] + b[1]) for a, b in want)
    assert 0 < max(n for name, n in steps if "Join" in name) <= len(want) / 5
    others = {
        "RETURN a.name AS x, b.k AS y": [(a[1], b[4]) for a, b in want],
        "RETURN a.name AS x, b AS y": [(a[1], b[0]) for a, b in want],
        "AND b.k > 150 RETURN a.file AS x, b.name AS y": [(a[2], b[1]) for a, b in want if b[4] > 150],
        "RETURN DISTINCT a.name AS x, b.name AS y": list({(a[1], b[1]) for a, b in want}),
        "RETURN a.name AS x, count(*) AS y": [(x, sum(a[1] == x for a, _ in want)) for x in {a[1] for a, _ in want}],
        "WITH a.name AS x, b.file AS y RETURN x, y": [(a[1], b[2]) for a, b in want],
        "RETURN a.name AS x, b.file AS y ORDER BY x, y LIMIT 70": sorted((a[1], b[2]) for a, b in want)[:70],
    }
    for end, rows_ in others.items():
        assert sorted(tuple(r) for r in run(g, text + end).collect()) == sorted(rows_), end


def test_sequences_are_joined_by_numbers(spark):
    text = catalogue.QUERIES["spec_sequence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "from_alias" in text  # messages are written once, not ordered for each reader
    messages = spark.createDataFrame([(1, 7, 8, "go", False), (2, 7, 8, "stay", False), (3, 7, 9, "go", None), (4, 8, 7, "", False)], "message long, from_alias long, to_alias long, method string, dashed boolean")
    members = spark.createDataFrame([(7, 70, "a"), (8, 80, "go"), (8, 9, "go"), (8, 81, "stay"), (8, 82, "more")], "alias long, uid long, name string")
    calls = spark.createDataFrame([(70, 80), (70, 9), (70, 9), (70, 82), (70, 82), (80, 81)], "src long, dst long")
    found = conformance.sequence(messages, members, members, calls, lambda uid: F.concat(F.lit("f"), uid.cast("string")))
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, [
        ("conforms", None, 1, 7, 8, "go", None, "f80,f9"),
        ("missing", "not_called", 2, 7, 8, "stay", None, "f81"),
        ("skipped", "unbound_endpoint", 3, 7, 9, "go", None, None),
        ("skipped", "free_text", 4, 8, 7, "", None, None),
        ("extra", None, None, 7, 8, "more", 70, "f82"),
        ("unbound", None, None, 9, None, None, None, None),
    ]))
