"""Diagrams against code, and workflow traces, on small literal tables."""

import pytest

from lattica.plans import conformance as C
from lattica.plans import workflow as W


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def test_sequence_regions(make):
    messages = make([(1, "a", "b", "go", False), (2, "a", "b", "stop", False), (3, "a", "b", "fly", False), (4, "b", "a", "go", True), (5, "a", "x", "go", False), (6, "a", "b", None, None), (7, "a", None, "go", False)], "message long, from_alias string, to_alias string, method string, dashed boolean")
    members = make([("a", "a1", "run"), ("b", "b1", "go"), ("b", "b2", "go"), ("b", "b3", "stop"), ("b", "b4", "hide")], "alias string, uid string, name string")
    calls = make([("a1", "b2"), ("a1", "b4"), ("b1", "b3"), ("a1", "zz")], "src string, dst string")
    rows = C.sequence(messages, make([("a",), ("b",)], "alias string"), members, calls).collect()
    assert {r.message: (r.region, r.reason, r.callees) for r in rows if r.message} == {
        1: ("conforms", None, "b2"), 2: ("missing", "not_called", "b3"), 3: ("missing", "no_method", None), 4: ("skipped", "return", None),
        5: ("skipped", "unbound_endpoint", None), 6: ("skipped", "free_text", None), 7: ("skipped", "unbound_endpoint", None),
    }
    assert [(r.caller, r.callees) for r in rows if r.region == "extra"] == [("a1", "b4")]
    assert [r.from_alias for r in rows if r.region == "unbound"] == ["x"]


def test_class_regions(make):
    diagram = make([("A", "f"), ("A", "g"), ("B", None), ("C", "f")], "class string, method string")
    bindings = make([("A", "a"), ("B", "b")], "class string, uid string")
    code = make([("A", "f"), ("A", "h"), ("C", "z")], "class string, method string")
    relations = make([("A", "B", "inherits"), ("B", "A", "inherits"), ("A", "C", "inherits"), ("A", "B", "uses")], "src string, dst string, type string")
    got = {tuple(r) for r in C.classes(diagram, bindings, code, relations, make([("a", "b")], "src string, dst string")).collect()}
    assert got == {("method", "conforms", "A", "f"), ("method", "missing", "A", "g"), ("method", "extra", "A", "h"), ("inherits", "conforms", "A", "B"), ("inherits", "missing", "B", "A"), ("class", "unbound", "C", None)}


def test_activity_regions(make):
    actions = make([("p", "1", "do_it"), ("p", "2", "DoIt"), ("p", "3", "doit"), ("p", "4", "none"), ("p", "5", ""), ("q", "6", "x"), ("p", "7", "Other")], "process string, action string, method string")
    callees = make([("p", "doIt"), ("p", "do_it"), ("p", "other"), ("p", "rest"), ("q", "x")], "process string, name string")
    rows = C.activity(actions, make([("p",)], "process string"), callees).collect()
    assert {r.action: (r.region, r.callee) for r in rows if r.action} == {"1": ("conforms", "do_it"), "2": ("ambiguous", None), "3": ("ambiguous", None), "4": ("missing", None), "5": ("skipped", None), "7": ("conforms", "other")}
    assert {(r.process, r.region, r.callee) for r in rows if not r.action} == {("p", "extra", "rest"), ("q", "unbound", None)}


def test_use_cases_binding_and_gaps(make):
    pair = "src string, dst string"
    rows = C.use_cases(make([("u",), ("v",), ("w",)], "id string"), make([("u", "f"), ("v", "g")], "id string, uid string"), make([("u", "v", "include"), ("v", "u", "extend"), ("u", "w", "include")], pair + ", type string"), make([("f", "g")], pair)).collect()
    assert {tuple(r) for r in rows} == {("use case", "implemented", "u", "f"), ("use case", "implemented", "v", "g"), ("use case", "unimplemented", "w", None), ("include", "conforms", "u", "v"), ("extend", "missing", "v", "u")}
    specs = make([("1", "one", None, None), ("2", "two", None, None), ("3", "x", "one", None), ("4", "x", None, None)], "id string, name string, display string, text string")
    bound = C.bind(specs, make([("a", "one"), ("b", "two"), ("c", "two")], "uid string, name string"))
    assert {tuple(r) for r in bound.collect()} == {("1", "a", "bound"), ("2", None, "ambiguous"), ("3", "a", "bound"), ("4", None, "unbound")}
    found = C.gaps(make([("s",), ("t",)], "uid string"), make([("a",), ("b",)], "uid string"), make([("s", "a")], pair))
    assert {tuple(r) for r in found.collect()} == {("unrealized spec", "t"), ("unspecified code", "b")}


def test_trace_and_findings(make):
    nodes = make([("r", "Requirement"), ("c", "AcceptanceCriterion"), ("t", "TestCase"), ("k", "Task"), ("p", "Phase"), ("f", "Flow"), ("r2", "Requirement"), ("k2", "Task")], "uid string, label string")
    links = make([("HAS_CRITERION", "r", "c"), ("VALIDATED_BY", "c", "t"), ("IMPLEMENTS", "k", "r"), ("HAS_REQUIREMENT", "p", "r"), ("HAS_PHASE", "f", "p"), ("HAS_REQUIREMENT", "p", "r2"), ("AFFECTS", "k", "gone")], "rel_type string, src string, dst string")
    got = W.trace(nodes, links, make([("c",), ("nobody",)], "uid string"))
    assert {(r.seed, r.uid) for r in got.collect()} == {("c", x) for x in "crtkpf"}
    assert {tuple(r) for r in W.findings(nodes, links).collect()} == {("r2", "missing-test-intent"), ("t", "missing-test-implementation"), ("k2", "missing-task-obligation")}
