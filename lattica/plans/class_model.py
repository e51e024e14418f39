"""Class diagrams of code: boxes with their members, and the relations between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.paths import is_test_path
from lattica.graph import Graph
from lattica.plans.analyses import _column, _edges

#: From so many classes on, a diagram is simplified unless told otherwise.
LARGE = 40
# Names that make a member a field or part of the surface.
FIELD_MARKS = ["property", "cached_property", "abstractproperty"]
CONSTRUCTORS = ["__init__", "constructor"]
HIDDEN_VISIBILITY = ["private", "protected"]


def is_public(name: Column, visibility: Column) -> Column:
    """Whether a member belongs to its class's surface: constructors do, other private, underscored and dunder names don't."""
    return ~F.coalesce(visibility.isin(HIDDEN_VISIBILITY), F.lit(False)) & (name.isin(CONSTRUCTORS) | ~name.rlike("^[_#]"))


def boxes(g: Graph, scope: str = "", include_tests: bool = False) -> DataFrame:
    """(uid, name, file, startLine, kind) of named classes in files that begin with ``scope``; test files only if asked for."""
    c = g.label("Class")
    file = F.translate(F.coalesce("file", F.lit("")), "\\", "/")
    keep = (F.coalesce("name", F.lit("")) != "") & file.startswith(scope)
    if not include_tests:
        keep &= ~is_test_path(file, names=False)
    return c.where(keep).select("uid", "name", "file", _column(c, "startLine").cast("long").alias("startLine"), _column(c, "kind").cast("string").alias("kind"))


def members(g: Graph, box: DataFrame, owns: str = "CONTAINS", public_only: bool = True, cap: int | None = None) -> DataFrame:
    """(cls, section, name, text, line, shown, abstract, total) for each differently named field and method of the classes ``box``.

    Accessors marked as properties are fields. Of several of one name the first by line counts; of fields, the first with
    a type. ``text`` is a method's signature or a field's type. Not shown are those outside the surface (if
    ``public_only``) and, by line, those beyond ``cap``; none goes missing. A null line sorts as 0. ``total`` counts a
    method's definitions, ``abstract`` those without a body; fields have 0.
    """
    f = g.label("Function")
    marks = F.transform(_column(f, "decorators").cast("array<string>"), lambda d: F.trim(F.regexp_replace(d, r"(?s)[(].*$", "")))
    bound = F.array(F.concat("name", F.lit(".setter")), F.concat("name", F.lit(".deleter")))
    accessor = F.exists(marks, lambda d: F.element_at(F.split(d, "[.]"), -1).isin(FIELD_MARKS) | F.array_contains(bound, d))
    rows = f.where("name <> ''").select(
        F.col("uid").alias("dst"), "name", F.when(F.coalesce(accessor, F.lit(False)), "attribute").otherwise("method").alias("section"),
        F.coalesce(_column(f, "signature").cast("string"), F.concat("name", F.lit("()"))).alias("signature"), _column(f, "return_type").cast("string").alias("type"),
        _column(f, "startLine").cast("long").alias("line"), _column(f, "visibility").cast("string").alias("visibility"), F.coalesce(_column(f, "isAbstract").cast("boolean"), F.lit(False)).alias("open"),
    )
    held = _edges(g, owns).select("src", "dst").distinct().join(box.select(F.col("uid").alias("src")), "src", "left_semi").join(rows, "dst")
    held = held.withColumn("text", F.when(F.col("section") == "method", F.col("signature")).otherwise(F.col("type")))
    columns = [F.col("src").alias("cls"), "section", "name", "text", "line", "visibility", "open", F.col("dst").alias("uid")]
    both = held.select(*columns)
    if "Variable" in g.labels:
        v = g.label("Variable")
        fields = v.where("scope = 'field' AND name <> ''").select(F.col("uid").alias("dst"), F.lit("attribute").alias("section"), "name", _column(v, "declaredType").cast("string").alias("text"), _column(v, "startLine").cast("long").alias("line"), F.lit(None).cast("string").alias("visibility"), F.lit(False).alias("open"))
        both = both.unionByName(_edges(g, "DECLARES").select("src", "dst").join(box.select(F.col("uid").alias("src")), "src", "left_semi").join(fields, "dst").select(*columns))
    line, method = F.coalesce("line", F.lit(0)), F.col("section") == "method"
    untyped = F.when(method, F.lit(0)).otherwise(F.col("text").isNull().cast("int"))
    first = F.min(F.struct(untyped.alias("untyped"), line.alias("at"), "uid", "text", "line", "visibility")).alias("m")
    one = both.groupBy("cls", "section", "name").agg(first, F.sum((method & F.col("open")).cast("long")).alias("abstract"), F.sum(method.cast("long")).alias("total"))
    one = one.select("cls", "section", "name", "m.text", "m.line", "m.at", (is_public(F.col("name"), F.col("m.visibility")) if public_only else F.lit(True)).alias("visible"), "abstract", "total")
    nth = F.row_number().over(Window.partitionBy("cls", "section", "visible").orderBy("at", "name"))
    shown = F.col("visible") if cap is None else F.col("visible") & (nth <= max(0, cap))
    return one.withColumn("shown", shown).select("cls", "section", "name", "text", "line", "shown", "abstract", "total")


def stereotypes(box: DataFrame, member: DataFrame) -> DataFrame:
    """(uid, stereotype): a class with methods, all without a body, and no field is an interface; with some, abstract."""
    n = member.groupBy(F.col("cls").alias("uid")).agg(F.sum("abstract").alias("open"), F.sum("total").alias("methods"), F.sum((F.col("section") == "attribute").cast("long")).alias("fields"))
    kind = F.when(F.coalesce("kind", F.lit("")) == "enumeration", F.lit(None)).when((F.col("methods") > 0) & (F.col("open") == F.col("methods")) & (F.col("fields") == 0), "interface").when(F.col("open") > 0, "abstract")
    return box.join(n, "uid", "left").select("uid", kind.cast("string").alias("stereotype"))


def relations(g: Graph, box: DataFrame, owns: str = "CONTAINS", calls: str = "CALLS", uses: bool | str = "auto", least_calls: int | str = "auto", cap: int | None = None) -> DataFrame:
    """(src, dst, kind, calls): inherits, creates, association and uses between the classes ``box``, none with itself.

    Bases outside the code are ``External:name``, apart from all classes. A function belongs to the class of smallest uid
    that owns it. A field's type is no association where there is inheritance; calls are a use only where nothing
    stronger joins the pair, from ``least_calls`` on, and with ``cap`` only the most frequent (ties by uids).

    ``auto`` is for pictures: beyond ``LARGE`` boxes uses are left out, or counted from two calls on. ``omitted`` tells how
    many; ``uses=True, least_calls=1`` leaves none out, whatever the number of boxes.
    """
    large = "auto" in (uses, least_calls) and box.limit(LARGE + 1).count() > LARGE
    least = (2 if large else 1) if least_calls == "auto" else max(1, int(least_calls))
    known = box.select("uid")
    src, dst = known.select(F.col("uid").alias("src")), known.select(F.col("uid").alias("dst"))

    def kind(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.where("src <> dst").select("src", "dst").distinct().withColumn("kind", F.lit(name))

    bases = _edges(g, "INHERITS").select("src", "dst").join(src, "src", "left_semi")
    inherits = bases.join(dst, "dst", "left_semi")
    if "ExternalBase" in g.labels:
        outer = g.label("ExternalBase").where("name <> ''").select(F.col("uid").alias("dst"), F.concat(F.lit("External:"), "name").alias("outer"))
        inherits = inherits.unionByName(bases.join(outer, "dst").select("src", F.col("outer").alias("dst")))
    inherits = kind(inherits, "inherits")
    owner = _edges(g, owns).join(src, "src", "left_semi").groupBy("dst").agg(F.min("src").alias("cls"))
    creates = kind(_edges(g, "INSTANTIATES").select(F.col("src").alias("f"), "dst").join(dst, "dst", "left_semi").join(owner.select(F.col("dst").alias("f"), F.col("cls").alias("src")), "f"), "creates")
    typed = _edges(g, "USES_TYPE")
    fields = typed.where(_column(typed, "role").cast("string") == "field").select("src", "dst").join(src, "src", "left_semi").join(dst, "dst", "left_semi")
    has = kind(fields.join(inherits, ["src", "dst"], "left_anti"), "association")
    strong = inherits.unionByName(creates).unionByName(has)
    out = strong.withColumn("calls", F.lit(None).cast("long"))
    if uses is False or uses == "auto" and large:
        return out
    ends = [owner.select(F.col("dst").alias(a), F.col("cls").alias(b)) for a, b in (("f", "src"), ("t", "dst"))]
    pairs = _edges(g, calls).select(F.col("src").alias("f"), F.col("dst").alias("t")).join(ends[0], "f").join(ends[1], "t").where("src <> dst")
    counted = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("calls")).where(F.col("calls") >= least).join(strong.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    if cap is not None:
        counted = counted.orderBy(F.desc("calls"), "src", "dst").limit(max(0, cap))
    return out.unionByName(counted.select("src", "dst", F.lit("uses").alias("kind"), "calls"))


def omitted(g: Graph, box: DataFrame, shown: DataFrame, owns: str = "CONTAINS", calls: str = "CALLS") -> DataFrame:
    """One row (uses, calls): how many uses between the classes ``box`` are not among the relations ``shown``, and their calls."""
    every = relations(g, box, owns, calls, uses=True, least_calls=1).where("kind = 'uses'")
    left = every.join(shown.where("kind = 'uses'").select("src", "dst"), ["src", "dst"], "left_anti")
    return left.agg(F.count(F.lit(1)).alias("uses"), F.coalesce(F.sum("calls"), F.lit(0)).cast("long").alias("calls"))


def connected(box: DataFrame, relation: DataFrame) -> DataFrame:
    """The classes of ``box`` that have a relation."""
    ends = relation.select(F.col("src").alias("uid")).unionByName(relation.select(F.col("dst").alias("uid"))).distinct()
    return box.join(ends, "uid", "left_semi")
