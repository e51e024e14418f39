"""Stored graphs that are changed by batches, catalogue procedures, levels, paths of tests and baselines."""

import pytest
from pyspark.sql import functions as F

from lattica import cypher
from lattica.cypher.lexer import QueryError
from lattica.functions.paths import is_test_path
from lattica.graph import Graph
from lattica.plans import scheduling, scope, views
from lattica.sources.store import Store


def test_batches_are_whole_and_applied_once(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "graph"))
    assert store.graph().labels == []
    nodes = lambda *rows: spark.createDataFrame(rows, "uid string, name string, n long")
    edges = lambda *rows: spark.createDataFrame(rows, "src string, dst string, count long")
    assert store.upsert("r1", {"F": nodes(("a", "A", 1), ("b", "B", None), (None, "x", 1))}, {"CALLS": edges(("a", "b", 1), ("a", "b", 2))})
    before = store.graph()
    assert store.upsert("r2", {"F": nodes(("a", None, 5), ("c", "C", 3)), "G": nodes(("g", "G", 1))}, {"CALLS": edges(("b", "a", 1))})
    rows = lambda g, x: sorted(map(tuple, g.label(x).collect()))
    want = [("a", "A", 5), ("b", "B", None), ("c", "C", 3)]
    assert rows(store.graph(), "F") == want and rows(store.graph(), "G") == [("g", "G", 1)]
    assert sorted(map(tuple, store.graph().rel("CALLS").collect())) == [("a", "b", 2), ("b", "a", 1)]
    assert rows(before, "F") == [("a", "A", 1), ("b", "B", None)]
    assert not store.upsert("r2", {"F": nodes(("a", "again", 9))}) and rows(store.graph(), "F") == want

    def dies(self, manifest):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(Store, "_swap", dies)
        with pytest.raises(OSError, match="killed"):
            store.upsert("r3", {"F": nodes(("a", "late", 9))})
    assert rows(store.graph(), "F") == want
    assert store.upsert("r3", {"F": nodes(("a", "late", 9)).withColumn("more", F.lit("m"))})
    assert store.graph().label("F").where("uid = 'a'").select("name", "n", "more").collect()[0] == ("late", 9, "m")
    assert store.vacuum() == 4 and store.vacuum() == 0
    assert store.graph().label("F").count() == 3 and store.manifest()["requests"] == ["r1", "r2", "r3"]


@pytest.fixture(scope="module")
def small(spark):
    n = spark.createDataFrame([("Function", "f", "F"), ("Function", "alone", "A"), ("State", "s", "S"), ("Variable", "v", "V"), ("ASTNode", "x", "X")], "label string, uid string, name string")
    e = spark.createDataFrame([("WRITES_STATE", "f", "s"), ("DECLARES", "f", "v"), ("CONTAINS_AST", "f", "x"), ("CALLS", "f", "f")], "rel_type string, src string, dst string")
    return Graph.of(n, e)


def test_procedures_and_guard(small):
    run = lambda text: [tuple(r) for r in cypher.run(small, text).collect()]
    assert run("CALL db.labels()") == [(x,) for x in small.labels]
    assert run("CALL db.relationshipTypes() YIELD relationshipType AS t WHERE t CONTAINS 'A' RETURN t ORDER BY t") == [("CALLS",), ("CONTAINS_AST",), ("DECLARES",), ("WRITES_STATE",)]
    assert ("name",) in run("CALL db.propertyKeys()") and ("coalesce",) in run("CALL show_functions()")
    assert run("CALL table_info('State') YIELD name RETURN name") == [("uid",), ("name",)]
    assert len(run("CALL show_tables() RETURN name, type")) == 8 and len(run("CALL show_connection('CALLS')")) == 1
    assert run("CALL current_setting('spark.sql.shuffle.partitions') YIELD value AS v RETURN v")[0][0]
    (plan,) = run("EXPLAIN MATCH (f:Function) RETURN f.name AS name")[0]
    assert "Physical Plan" in plan and run("PROFILE MATCH (f:Function) RETURN f.name AS name")[0][0]
    for bad in ("CALL db.drop()", "MATCH (f) CALL other.thing() RETURN f", "CALL", "EXPLAIN CREATE (n)"):
        with pytest.raises(QueryError):
            run(bad)


def test_levels(small):
    assert "ASTNode" not in scope.labels(2) and "ASTNode" in scope.labels(3) and "Variable" not in scope.labels(1)
    got = {r.label: (r.n, r.connected, r.near) for r in scope.report(small, 1).collect()}
    assert got == {"Function": (2, 1, "State"), "State": (1, 1, "Function")}
    assert {r.label for r in scope.report(small, 3, ("State",)).collect()} == {"Function", "Variable", "ASTNode"}
    with pytest.raises(ValueError, match="levels"):
        scope.labels(4)


def test_paths_of_tests(spark):
    yes = "tests/a.py a/Test/b.py __tests__/x.js a.test.ts b.SPEC.x test_a.py a/test-utils.js go_test.go x.d.ts w\\tests\\a.py".split()
    no = ["contest/a.py", "a/latest.py", "testing.py", "a_test.js", "src/test_dir/a.py", "", None]
    df = spark.createDataFrame([(x,) for x in yes + no], "p string")
    assert {r.p for r in df.where(is_test_path(F.col("p"))).collect()} == set(yes)
    assert {r.p for r in df.where(is_test_path(F.col("p"), names=False)).collect()} == set(yes) - {"test_a.py", "a/test-utils.js", "go_test.go", "x.d.ts"}


def test_baselines_tasks_and_locked_nodes(spark, small):
    report = lambda *rows: spark.createDataFrame(rows, "language string, percent double, parseErrors long")
    base = scheduling.quality_baseline(report(("py", 90.0, 1), ("js", 80.0, None), ("c", None, 3), (None, 85.0, 4)))
    assert {tuple(r) for r in base.collect()} == {("py", 90.0, 1), ("js", 80.0, 0)}
    worse = scheduling.regressions(report(("py", 88.5, 2), ("c", 1.0, 9), (None, 1.0, 9)), base, 1.0)
    assert {tuple(r) for r in worse.collect()} == {("py", "resolution", 88.5, 90.0), ("py", "parse errors", 2.0, 1.0), ("js", "resolution", None, 80.0)}
    tasks = spark.createDataFrame([("a", "done", "low", None, None), ("b", "review", "low", None, None), ("c", "todo", "low", None, None), ("d", "todo", "high", None, None), ("e", "backlog", "critical", 2, "waiting"), ("f", "backlog", "low", 1, "active"), ("g", "todo", "critical", 2, "waiting"), ("h", "todo", "low", None, None)], "uid string, status string, priority string, wave long, waveStatus string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("h", "x")], "src string, dst string")
    assert [r.uid for r in scheduling.next_tasks(tasks, needs).collect()] == ["g", "c", "f"]
    needs = spark.createDataFrame([("c", "b"), ("b", "z")], "src string, dst string")
    assert "c" not in [r.uid for r in scheduling.next_tasks(tasks, needs).collect()]
    got = views.locked_nodes(small, small.label("Function").select("uid")).where("uid = 'f'").collect()[0]
    assert (got.callers, got.callees, got.writes, got.reads, got.returns) == ("F", "F", "S", "", "")
