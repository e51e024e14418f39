"""Class diagrams and messaging interfaces on small graphs."""

from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.plans import class_model, messaging


def _graph(spark):
    def table(rows, schema):
        return lambda: spark.createDataFrame(rows, schema)

    nodes = {
        "Class": table([("A", "Base", "src/a.py", 1), ("B", "Child", "src/b.py", 1), ("C", "Other", "src/c.py", 1), ("T", "TestBase", "tests/t.py", 1), ("N", None, "src/n.py", 1)], "uid string, name string, file string, startLine long"),
        "ExternalBase": table([("x", "Base")], "uid string, name string"),
        "Function": table(
            [
                ("f1", "run", "run(self)", 5, None, None, True),
                ("f2", "run", "run(self, x)", 9, None, None, True),
                ("f3", "_help", None, 2, None, None, False),
                ("f4", "label", None, 3, ["functools.cached_property"], "str", False),
                ("f5", "__init__", None, 1, None, None, False),
                ("f6", "go", None, None, None, None, False),
            ],
            "uid string, name string, signature string, startLine long, decorators array<string>, return_type string, isAbstract boolean",
        ),
        "Variable": table([("v1", "size", "field", None, 2), ("v2", "size", "field", "int", 7), ("v3", "local", "local", None, 1)], "uid string, name string, scope string, declaredType string, startLine long"),
    }
    edges = {
        "CONTAINS": table([("A", "f1"), ("A", "f2"), ("B", "f3"), ("B", "f4"), ("B", "f5"), ("C", "f6"), ("C", "f6")], "src string, dst string"),
        "DECLARES": table([("B", "v1"), ("B", "v2"), ("B", "v3")], "src string, dst string"),
        "INHERITS": table([("B", "A"), ("A", "x"), ("C", "C")], "src string, dst string"),
        "INSTANTIATES": table([("f6", "A"), ("f6", "C"), ("f6", "T")], "src string, dst string"),
        "USES_TYPE": table([("B", "A", "field"), ("B", "C", "field"), ("C", "B", "param")], "src string, dst string, role string"),
        "CALLS": table([("f3", "f1"), ("f6", "f1"), ("f6", "f4"), ("f6", "f5"), ("f1", "f6")], "src string, dst string"),
    }
    return Graph(spark, nodes, edges)


def test_class_diagram(spark):
    g = _graph(spark)
    box = class_model.boxes(g)
    assert {r.uid for r in box.collect()} == {"A", "B", "C"}
    assert {r.uid for r in class_model.boxes(g, "tests/", True).collect()} == {"T"}
    found = {tuple(r) for r in class_model.relations(g, box).collect()}
    strong = {("B", "A", "inherits", None), ("A", "External:Base", "inherits", None), ("C", "A", "creates", None), ("B", "C", "association", None)}
    assert found == strong | {("C", "B", "uses", 2), ("A", "C", "uses", 1)}
    assert {tuple(r) for r in class_model.relations(g, box, least_calls=2).collect()} == strong | {("C", "B", "uses", 2)}
    assert {tuple(r) for r in class_model.relations(g, box, cap=1).collect()} == strong | {("C", "B", "uses", 2)}
    assert {tuple(r) for r in class_model.relations(g, box, uses=False).collect()} == strong
    every = class_model.relations(g, box, uses=True, least_calls=1)
    left = class_model.omitted(g, box, class_model.relations(g, box, uses=False)).collect()[0]
    assert left.uses == every.where("kind = 'uses'").count() > 0 and class_model.omitted(g, box, every).collect()[0].uses == 0
    assert {r.uid for r in class_model.connected(box, class_model.relations(g, box)).collect()} == {"A", "B", "C"}


def test_class_members(spark):
    g = _graph(spark)
    rows = class_model.members(g, class_model.boxes(g))
    assert {(r.cls, r.section, r.name): (r.text, r.line, r.shown, r.total) for r in rows.collect()} == {
        ("A", "method", "run"): ("run(self)", 5, True, 2),
        ("B", "method", "_help"): ("_help()", 2, False, 1),
        ("B", "method", "__init__"): ("__init__()", 1, True, 1),
        ("B", "attribute", "label"): ("str", 3, True, 0),
        ("B", "attribute", "size"): ("int", 7, True, 0),
        ("C", "method", "go"): ("go()", None, True, 1),
    }
    capped = class_model.members(g, class_model.boxes(g), public_only=False, cap=1).where("cls = 'B' AND section = 'method'")
    assert {(r.name, r.shown) for r in capped.collect()} == {("__init__", True), ("_help", False)}
    assert {tuple(r) for r in class_model.stereotypes(class_model.boxes(g), rows).collect()} == {("A", "interface"), ("B", None), ("C", None)}


def test_interfaces(spark):
    rows = [
        ("talker", "'chat'", True, "std_msgs::msg::String", "topic", "provides"),
        ("talker", "'chat'", True, "std_msgs::msg::String", "topic", "provides"),
        ("ear", '"/chat"', True, "<const std_msgs.msg.String::SharedPtr &>", "topic", "uses"),
        ("ear", '"~/set"', True, "std_srvs/srv/Empty", "topic", "provides"),
        ("ear", '"~"', True, None, "topic", "uses"),
        ("ear", "'http://x y'", True, None, "topic", "uses"),
        ("ear", "prefix  +\n name", False, "make type()", "topic", "uses"),
        (None, "'chat'", True, None, "topic", "uses"),
        ("ear", None, True, None, "topic", "uses"),
        ("ear", " ", False, None, "topic", "uses"),
    ]
    found = messaging.interfaces(spark.createDataFrame(rows, "node string, raw_name string, literal boolean, raw_type string, kind string, side string"))
    assert {tuple(r) for r in found.collect()} == {
        ("topic", "/chat", False, "talker", "provides", "std_msgs/msg/String"),
        ("topic", "/chat", False, "ear", "uses", "std_msgs/msg/String"),
        ("service", "/ear/set", False, "ear", "provides", "std_srvs/srv/Empty"),
        ("topic", "prefix + name", True, "ear", "uses", None),
    }
    both = messaging.overview(found, only_connected=True)
    assert [tuple(r) for r in both.collect()] == [("topic", "/chat", False, 1, 1, 1)]
    assert messaging.overview(found.where(F.lit(False))).count() == 0
