"""Named analyses of a code graph; each takes a graph and parameters and returns a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators import cycles, traverse, wedges
from lattica.operators.pattern import absent, counted, hop, prefixed, present
from lattica.operators.skew import counted as counted_rows
from lattica.operators.skew import crossed, repeated
from lattica.scratch import written

CALLS = "CALLS"


def _column(df: DataFrame, name: str, default=None):
    """A column that some graphs lack."""
    return F.col(name) if name in df.columns else F.lit(default)


def _edges(g: Graph, name: str) -> DataFrame:
    """Edges of a type, none where the graph has no such type."""
    return g.rel(name) if name in g.types else g.spark.createDataFrame([], "src string, dst string")


def _top(df: DataFrame, order: list, k: int | None) -> DataFrame:
    return df.orderBy(*order).limit(k) if k else df


# ---- requirements and tests ----


def requirements_without_test_intent(g: Graph) -> DataFrame:
    """Requirements that neither a test case nor a criterion with one validates."""
    direct = _edges(g, "VALIDATED_BY")
    through = _edges(g, "HAS_CRITERION").select(F.col("src").alias("r"), F.col("dst").alias("c")).join(direct.select(F.col("src").alias("c")), "c", "left_semi").select(F.col("r").alias("src"))
    r = absent(absent(g.label("Requirement"), "uid", direct, "src"), "uid", through, "src")
    return r.select("uid", F.col("title").alias("requirement"), "changeId")


def test_cases_without_implementation(g: Graph) -> DataFrame:
    return absent(g.label("TestCase"), "uid", _edges(g, "IMPLEMENTED_BY"), "src").select("uid", F.col("title").alias("testCase"), "changeId")


def source_validation_trace(g: Graph) -> DataFrame:
    """What each test case validates, and the source that implements it, if any."""
    nodes = g.nodes()
    tested = hop(g, prefixed(g.label("TestCase"), "t"), "t_uid", "VALIDATES", None, "n").join(prefixed(nodes, "n"), "n_uid")
    tests = _edges(g, "IMPLEMENTED_BY").select(F.col("src").alias("t_uid"), F.col("dst").alias("testId")).join(nodes.select(F.col("uid").alias("testId"), F.col("file").alias("testFile")), "testId")
    return tested.join(tests, "t_uid", "left").select(F.col("n_uid").alias("uid"), F.col("n_name").alias("source"), F.col("n_file").alias("file"), F.col("t_title").alias("testCase"), "testId", "testFile")


# ---- calls ----


def direct_recursion(g: Graph, rel: str = CALLS) -> DataFrame:
    return present(g.label("Function"), "uid", g.rel(rel).where("src = dst"), "src").select("uid", F.col("name").alias("function"), "file")


def call_graph_coverage(g: Graph, k: int = 40) -> DataFrame:
    """Resolved share of each file's internal call sites, worst first."""
    f = g.label("File").where("internalCallSites > 0")
    out = f.select(F.col("path").alias("file"), F.col("callSites").alias("allSites"), F.col("externalCallSites").alias("externalSites"), F.col("internalCallSites").alias("internalSites"), F.col("callsResolved").alias("resolved"), F.round(F.lit(100.0) * F.col("callsResolved") / F.col("internalCallSites"), 1).cast("double").alias("percent"))
    return _top(out, ["percent", "file"], k)


def call_resolution_quality(g: Graph, rel: str = CALLS) -> DataFrame:
    """Edges by how they were resolved."""
    edges = g.rel(rel)
    return edges.groupBy(_column(edges, "resolvedBy").alias("resolvedBy")).agg(F.count(F.lit(1)).alias("edges"))


def recursion(g: Graph, rel: str = CALLS, max_hops: int = 5, k: int | None = None) -> DataFrame:
    """Functions on a closed walk of calls, direct recursion included."""
    ids = traverse.cyclic(g, [rel], max_hops).unionByName(g.rel(rel).where("src = dst").select(F.col("src").alias("uid"))).distinct()
    return _top(g.label("Function").join(ids, "uid", "left_semi").select("uid", F.col("name").alias("recursiveFunction"), "file"), ["uid"], k)


def _ranked(g: Graph) -> DataFrame:
    """Functions (uid, name, file) with ids in order of their names, and ``last``, the last id of their name (null: none)."""
    f = g.label("Function").select("uid", "name", "file")
    ids = written(f.repartitionByRange("name", "uid").sortWithinPartitions("name", "uid").withColumn("id", F.monotonically_increasing_id()))
    return written(ids.join(ids.where("name IS NOT NULL").groupBy("name").agg(F.max("id").alias("last")), "name", "left"))


def _sharing(g: Graph, ids: DataFrame, rel: str, by: str, on: str) -> tuple[DataFrame, int]:
    """(a, shared, ends) for each function and neighbour ``on``: functions of later names with the same neighbour; and how
    many tasks their pairs need. All are ids."""
    x = ids.where("last IS NOT NULL").select(F.col("uid").alias(by), F.col("id").alias("a"), "last")
    y = ids.select(F.col("uid").alias(on), F.col("id").alias("shared"))
    e = written(g.rel(rel).select(by, on).join(x.hint("merge"), by).join(y.hint("merge"), on).select("a", "last", "shared"))
    return wedges.above(wedges.across(e, "shared", wedges.lists(e, "shared", "a")), "last").select("a", "shared", "ends"), wedges.tasks(e, "shared", "shared")


def _pairs(pairs: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b: ids) with the columns (uid, name, file) of both."""
    for end in ("a", "b"):
        pairs = pairs.join(ids.select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns)).hint("merge"), end)
    return pairs


def duplicate_functions_by_callees(g: Graph, rel: str = CALLS, least: int = 2) -> DataFrame:
    """Pairs of functions that call at least ``least`` same ones.

    Pairs are shuffled as lists of ids; callees are named for pairs that share enough.
    """
    ids = _ranked(g)
    rows, n = _sharing(g, ids, rel, "src", "dst")
    each = rows.repartition(n, "a").select("a", F.explode("ends").alias("b"), "shared")
    some = each.withColumn("overlap", F.count(F.lit(1)).over(Window.partitionBy("a", "b"))).where(F.col("overlap") >= least)
    named = some.join(ids.select(F.col("id").alias("shared"), F.col("name").alias("callee")).hint("merge"), "shared")
    pairs = named.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("callee")), ",").alias("sharedCallees"), F.count(F.lit(1)).alias("overlap"))
    return _pairs(pairs, ids, "uid", "name", "file").select(F.col("a_uid").alias("uid"), F.col("a_name").alias("funcA"), F.col("a_file").alias("fileA"), F.col("b_name").alias("funcB"), F.col("b_file").alias("fileB"), "sharedCallees", "overlap")


def duplicate_functions_by_signature(g: Graph) -> DataFrame:
    """Pairs of functions with other names and the same parameters, if any.

    A function meets those that the result can't tell apart once, and the pair is repeated.
    """
    f = g.label("Function").where("params <> '()'").select("name", "file", "params")
    both = crossed(prefixed(f, "a"), prefixed(counted_rows(f, "n"), "b"), [("a_params", "b_params")], times=(None, "b_n")).where("a_name < b_name")
    pairs = both.select(F.col("a_name").alias("funcA"), F.col("a_file").alias("fileA"), F.col("b_name").alias("funcB"), F.col("b_file").alias("fileB"), F.col("a_params").alias("sharedSignature"), F.col("b_n").alias("_times"))
    return repeated(pairs, "_times")


def duplicate_functions_by_callers_and_callees(g: Graph, rel: str = CALLS) -> DataFrame:
    """Pairs of functions with a caller and a callee in common.

    Pairs are shuffled as lists of ids, both kinds by the first function; neighbours are named for pairs that have both.
    """
    ids = _ranked(g)
    (up, m), (down, n) = _sharing(g, ids, rel, "dst", "src"), _sharing(g, ids, rel, "src", "dst")
    rows = up.withColumn("calls", F.lit(False)).unionByName(down.withColumn("calls", F.lit(True)))
    each = rows.repartition(m + n, "a").select("a", F.explode("ends").alias("b"), "shared", "calls")
    pair = Window.partitionBy("a", "b")
    some = each.withColumn("both", F.max("calls").over(pair) & ~F.min("calls").over(pair)).where("both")
    named = some.join(ids.select(F.col("id").alias("shared"), F.col("name").alias("other")).hint("merge"), "shared")
    one = {name: F.array_join(F.array_sort(F.collect_set(F.when(F.col("calls") == calls, F.col("other")))), ",").alias(name) for name, calls in (("sharedCallers", False), ("sharedCallees", True))}
    pairs = _pairs(named.groupBy("a", "b").agg(*one.values()), ids, "uid", "name")
    return pairs.select(F.col("a_name").alias("funcA"), F.col("b_name").alias("funcB"), "sharedCallers", "sharedCallees", F.col("a_uid").alias("uid"), F.col("b_uid").alias("uidB"))


def dead_code(g: Graph, rel: str = CALLS) -> DataFrame:
    """Functions that nothing calls or renders, with the evidence against their being dead."""
    f = absent(absent(g.label("Function"), "uid", g.rel(rel), "dst"), "uid", _edges(g, "RENDERS"), "dst")
    for name, edge in (("taskSignals", "AFFECTS"), ("callbackSignals", "PASSES_CALLBACK"), ("specSignals", "REALIZED_BY")):
        f = counted(f, "uid", present(_edges(g, edge), "dst", f, "uid"), "dst", name, F.count_distinct("src"))
    yes = {k: F.coalesce(_column(f, k, False), F.lit(False)) for k in ("isFrameworkEntrypoint", "isAbstract", "isPlannedStub")}
    planned = yes["isPlannedStub"] | (F.col("taskSignals") > 0) | (F.col("specSignals") > 0)
    called_back, public = F.col("callbackSignals") > 0, F.col("visibility") == "public"
    category = F.when(yes["isFrameworkEntrypoint"], "framework_entrypoint").when(called_back, "callback_target").when(yes["isAbstract"], "abstract_contract").when(planned, "planned_stub").when(public, "public_no_static_caller").otherwise("private_no_caller")
    confidence = F.when(yes["isFrameworkEntrypoint"] | called_back | yes["isAbstract"] | planned, "none").when(public, "low").otherwise("medium")
    return f.select("uid", F.col("name").alias("function"), "file", category.alias("category"), confidence.alias("analysisConfidence"), "visibility", _column(f, "entryPointKind").cast("string").alias("frameworkKind"), "taskSignals", "specSignals", called_back.alias("passedAsCallback"))


def most_called_functions(g: Graph, rel: str = CALLS, k: int = 20) -> DataFrame:
    # counted and cut before the join: only k rows meet the nodes
    top = g.rel(rel).groupBy(F.col("dst").alias("uid")).agg(F.count(F.lit(1)).alias("calledBy")).orderBy(F.desc("calledBy"), "uid").limit(k)
    return top.join(g.label("Function"), "uid").select("uid", F.col("name").alias("function"), "file", "calledBy")


def most_complex_functions(g: Graph, rel: str = CALLS, k: int | None = 40) -> DataFrame:
    """Refactoring candidates by length, decisions, nesting, state writes, spread over files, parameters and fan-out."""
    f = g.label("Function")
    callee = g.rel(rel).join(f.select(F.col("uid").alias("dst"), F.col("file").alias("module")), "dst")
    out = counted(f, "uid", callee, "src", "internalFanOut", F.count_distinct("dst"))
    out = counted(out, "uid", callee, "src", "moduleSpread", F.count_distinct("module"))
    flows = _edges(g, "CONTAINS_FLOW")
    out = counted(out, "uid", flows, "src", "decisions", F.count_distinct("dst"))
    out = counted(out, "uid", flows, "src", "maxNesting", F.max(_column(flows, "depth", 0)))
    out = counted(out, "uid", _edges(g, "WRITES_STATE"), "src", "stateWrites", F.count_distinct("dst"))
    out = out.withColumn("lines", F.coalesce(F.col("endLine") - F.col("startLine") + 1, F.lit(0))).withColumn("parameters", F.coalesce(_column(out, "parameterCount", 0), F.lit(0)).cast("long"))
    score = F.expr("lines + decisions * 5 + maxNesting * 6 + stateWrites * 4 + moduleSpread * 3 + 3 * greatest(0, parameters - 5) + 2 * greatest(0, internalFanOut - 8)")
    out = out.withColumn("refactoringScore", score.cast("long"))
    level = F.when((F.col("refactoringScore") >= 120) & (F.col("decisions") >= 6), "high").when(F.col("refactoringScore") >= 70, "medium").otherwise("low")
    out = out.select("uid", F.col("name").alias("function"), "file", "lines", "parameters", "decisions", F.col("maxNesting").cast("long").alias("maxNesting"), "internalFanOut", "stateWrites", "moduleSpread", "refactoringScore", level.alias("analysisConfidence"))
    return _top(out, [F.desc("refactoringScore"), "uid"], k)


def cyclomatic_complexity(g: Graph, k: int | None = 40) -> DataFrame:
    out = counted(g.label("Function"), "uid", g.rel("CONTAINS_FLOW"), "src", "n").select("uid", F.col("name").alias("function"), "file", (F.col("n") + 1).alias("cyclomaticComplexity"))
    return _top(out, [F.desc("cyclomaticComplexity"), "uid"], k)


def long_functions(g: Graph, k: int | None = 40) -> DataFrame:
    f = g.label("Function").where("startLine IS NOT NULL AND endLine IS NOT NULL")
    return _top(f.select("uid", F.col("name").alias("function"), "file", (F.col("endLine") - F.col("startLine") + 1).alias("lines")), [F.desc("lines"), "uid"], k)


def large_classes(g: Graph, rel: str = "CONTAINS", k: int | None = 40) -> DataFrame:
    c = g.label("Class")
    out = counted(c, "uid", g.rel(rel), "src", "methods")
    lines = (F.col("endLine") - F.col("startLine") + 1) if "endLine" in c.columns else F.lit(None).cast("long")
    return _top(out.select("uid", F.col("name").alias("class"), "file", "methods", lines.alias("lines")), [F.desc("methods"), F.desc("lines"), "uid"], k)


def entry_points(g: Graph, rel: str = CALLS) -> DataFrame:
    f = absent(present(g.label("Function"), "uid", g.rel(rel), "src"), "uid", g.rel(rel), "dst")
    return f.select("uid", F.col("name").alias("entryPoint"), "file")


def callers_of_function(g: Graph, name: str, rel: str = CALLS) -> DataFrame:
    target = g.label("Function").where(F.col("name") == name).select(F.col("uid").alias("t"))
    return hop(g, target, "t", rel, "Function", "caller", "in").select(F.col("caller_name").alias("caller"), F.col("caller_file").alias("file"), F.col("caller_uid").alias("uid"), F.col("t").alias("callee"))


def call_chain(g: Graph, uid: str, rel: str = CALLS, max_hops: int = 8, k: int | None = 30) -> DataFrame:
    """Simple call paths from a function, as uids."""
    seeds = g.label("Function").where(F.col("uid") == uid).select("uid")
    out = traverse.paths(g, seeds, [rel], max_hops, k).select(F.array_join("path", ",").alias("callChain"), "hops")
    return _top(out, ["hops", "callChain"], k)


# ---- files ----

# Literals that need no name, and those by convention.
COMMON = "100 1000 10000 100000 1000000 100.0 1000.0 10.00 0.00 0.000 0.0000 1.00 1.000 2.00".split()
CODES = "200 201 204 300 301 302 304 400 401 403 404 409 422 429 500 502 503 600 700 800 900".split()
NUMBER, DECIMAL, TEST_FILES = r"^-?([0-9]{3,}|[0-9]*[.][0-9]{2,})$", r"^-?[0-9]*[.][0-9]{2,}$", ("/test", ".test.", ".spec.", "/spec/", "__tests__")


def _unnamed(literals: DataFrame) -> DataFrame:
    out = literals.where(F.col("value").rlike(NUMBER) & ~F.col("value").isin(COMMON))
    for part in TEST_FILES:
        out = out.where(~F.contains(F.col("file"), F.lit(part)))
    return out


def magic_numbers(g: Graph, k: int | None = 40) -> DataFrame:
    """Unexplained number literals that repeat, by how many files share them."""
    per = _unnamed(g.label("ASTNode")).groupBy(F.col("value").alias("number")).agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("file").alias("fileCount")).where("occurrences >= 2")
    code = F.col("number").isin(CODES)
    kind = F.when(code, "standard_code").when(F.col("number").rlike(DECIMAL), "precise_decimal").when(F.col("number").rlike("^-?[0-9]{4,}$"), "large_integer").otherwise("integer")
    level = F.when(code, "low").when(F.col("fileCount") >= 3, "high").when(F.col("fileCount") >= 2, "medium").otherwise("low")
    out = per.select("number", "occurrences", "fileCount", kind.alias("numberKind"), level.alias("analysisConfidence"))
    return _top(out, [code.cast("int"), F.desc("fileCount"), F.desc("occurrences"), "number"], k)


def magic_number_sites(g: Graph, k: int | None = 200) -> DataFrame:
    inside = _edges(g, "CONTAINS_AST").select(F.col("dst").alias("uid"), F.col("src").alias("f")).join(g.label("Function").select(F.col("uid").alias("f"), F.col("name").alias("fn")), "f") if "Function" in g.labels else None
    lit = _unnamed(g.label("ASTNode"))
    lit = lit.join(inside, "uid", "left") if inside is not None else lit.withColumn("fn", F.lit(None).cast("string"))
    out = lit.select("uid", F.col("value").alias("number"), "file", F.col("startLine").alias("line"), F.coalesce("fn", F.lit("(module level)")).alias("function"))
    return _top(out, ["file", "line", "uid"], k)


def circular_imports(g: Graph, rel: str = "IMPORTS", max_hops: int = 6, label: str = "File") -> DataFrame:
    """Files on an import cycle of 2 to ``max_hops``, with the first of their shortest ones by the uids along it."""
    found = cycles.witnesses(g.rel(rel), max_hops).select("uid", F.array_join("cycle", ",").alias("importCycle"))
    f = g.label(label)
    return f.select("uid", _column(f, "path").cast("string").alias("path")).join(found, "uid")


def external_dependencies(g: Graph) -> DataFrame:
    used = hop(g, prefixed(g.label("File"), "f"), "f_uid", "IMPORTS", "Module", "m")
    return used.groupBy(F.col("m_name").alias("module")).agg(F.array_join(F.array_sort(F.collect_set("f_path")), ",").alias("usedIn"))


def files_overview(g: Graph) -> DataFrame:
    f = g.label("File")
    return counted(f, "uid", g.rel("CONTAINS"), "src", "functions").select(F.col("path").alias("file"), _column(f, "language").cast("string").alias("lang"), "functions")


# ---- endpoints, states, effects, props, DOM ----


def _linked(g: Graph, rel: str, left: str, right: str) -> DataFrame:
    return hop(g, prefixed(g.label(left), "a"), "a_uid", rel, right, "b")


def api_endpoints(g: Graph) -> DataFrame:
    return _linked(g, "HANDLES", "Function", "Endpoint").select(F.col("a_uid").alias("uid"), F.col("b_url").alias("url"), F.col("b_method").alias("method"), F.col("a_name").alias("handler"), F.col("a_file").alias("file"))


def functions_fetching_api(g: Graph) -> DataFrame:
    return _linked(g, "FETCHES", "Function", "Endpoint").select(F.col("a_name").alias("function"), F.col("a_file").alias("file"), F.col("b_url").alias("url"), F.col("b_method").alias("method"))


def react_state_writers(g: Graph) -> DataFrame:
    return _linked(g, "WRITES_STATE", "Function", "State").select(F.col("a_uid").alias("uid"), F.col("a_name").alias("component"), F.col("b_name").alias("stateSetter"), F.col("a_file").alias("file"))


def untracked_state_deps(g: Graph) -> DataFrame:
    """States that a component writes and nothing watches."""
    out = absent(_linked(g, "WRITES_STATE", "Function", "State"), "b_uid", _edges(g, "WATCHES"), "dst")
    return out.select(F.col("a_name").alias("component"), F.col("b_name").alias("state"), F.col("a_file").alias("file"))


def effect_watches(g: Graph) -> DataFrame:
    out = hop(g, _linked(g, "HAS_EFFECT", "Function", "Effect"), "b_uid", "WATCHES", "State", "s")
    return out.select(F.col("a_name").alias("component"), F.col("a_file").alias("file"), F.col("b_hookType").alias("hook"), F.col("b_startLine").alias("line"), F.col("s_name").alias("watchedState"), F.col("b_deps").alias("allDeps"))


def all_effects(g: Graph) -> DataFrame:
    return _linked(g, "HAS_EFFECT", "Function", "Effect").select(F.col("a_name").alias("component"), F.col("a_file").alias("file"), F.col("b_hookType").alias("hook"), F.col("b_startLine").alias("line"), F.col("b_deps").alias("deps"))


def component_accepts_props(g: Graph) -> DataFrame:
    return g.label("Function").where(F.size("acceptsProps") > 0).select(F.col("name").alias("component"), "file", F.col("acceptsProps").alias("acceptedProps"))


def missing_props(g: Graph, with_spread: bool = False) -> DataFrame:
    """Accepted props that a call site doesn't pass; sites that spread only if wanted."""
    f = g.label("Function")
    sites = g.rel("PASSES_PROP").join(f.select(F.col("uid").alias("src"), F.col("name").alias("parent")), "src").join(f.select(F.col("uid").alias("dst"), F.col("name").alias("child"), "acceptsProps"), "dst").where("acceptsProps IS NOT NULL")
    if not with_spread:
        sites = sites.where(~F.coalesce("hasSpread", F.lit(False)))
    sites = sites.withColumn("missingProps", F.array_except("acceptsProps", F.coalesce("props", F.array().cast("array<string>")))).where(F.size("missingProps") > 0)
    return sites.select(F.col("src").alias("uid"), "parent", "child", "missingProps", F.col("props").alias("passedProps"), *(["hasSpread"] if with_spread else []))


def dom_elements(g: Graph) -> DataFrame:
    """Statically extracted elements; those of the runtime aside, unknown counts as static."""
    d = g.label("DOMElement")
    return d.where(~F.coalesce(_column(d, "isRuntime", False), F.lit(False))).select(_column(d, "elementId").cast("string").alias("id"), F.col("tagName").alias("tag"), _column(d, "testId").cast("string").alias("testId"), "file", F.col("startLine").alias("line"))


def dom_to_handler_chain(g: Graph, max_hops: int = 4, k: int | None = 30) -> DataFrame:
    events = g.rel("ON_EVENT")
    handled = prefixed(g.label("DOMElement"), "d").join(events.select(F.col("src").alias("d_uid"), F.col("dst").alias("origin"), _column(events, "event").alias("event")), "d_uid").join(g.label("Function").select(F.col("uid").alias("origin"), F.col("name").alias("handler")), "origin")
    if k:  # each step of a handler gives a row at least, so the first handlers by these give the first k rows
        degree = g.rel(CALLS).where("src <> dst").groupBy(F.col("src").alias("origin")).agg(F.count(F.lit(1)).alias("n"))
        first = handled.orderBy("d_testId", "handler", "origin", "d_uid").limit(k).join(degree, "origin", "left")
        before = F.sum(F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))).over(Window.orderBy("d_testId", "handler", "origin", "d_uid").rowsBetween(Window.unboundedPreceding, -1))
        handled = written(first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k))
    chains = traverse.paths(g, handled.select(F.col("origin").alias("uid")).distinct(), [CALLS], max_hops).select("origin", F.array_join("path", ",").alias("callChain"))
    out = handled.join(chains, "origin", "left").select(F.col("d_testId").alias("testId"), F.col("d_tagName").alias("tag"), "event", "handler", "callChain")
    return _top(out, ["testId", "handler", "callChain"], k)


def runtime_dom_tree(g: Graph, k: int | None = 50) -> DataFrame:
    out = _linked(g, "HAS_CHILD", "RuntimeDOM", "RuntimeDOM")
    return _top(out.select(F.col("a_tagName").alias("parentTag"), F.col("a_testId").alias("parentTestId"), F.col("b_tagName").alias("childTag"), F.col("b_testId").alias("childTestId"), F.col("b_xpath").alias("xpath")), ["xpath"], k)


# ---- runtime ----


def functions_with_errors(g: Graph, labels: list[str] | None = None) -> DataFrame:
    n = g.nodes(labels)
    return n.where("lastError IS NOT NULL").select("uid", F.col("name").alias("function"), "file", F.col("lastError").alias("error"), F.col("lastErrorTimestamp").alias("timestamp"))


def user_events(g: Graph, k: int | None = 30) -> DataFrame:
    out = hop(g, prefixed(g.label("User"), "u"), "u_uid", "PERFORMED", "UserEvent", "e")
    return _top(out.select(F.col("e_uid").alias("uid"), F.col("u_uid").alias("user"), F.col("e_eventType").alias("type"), F.col("e_ts").alias("timestamp")), [F.desc("timestamp"), "uid"], k)


def execution_path_for_event(g: Graph, uid: str) -> DataFrame:
    steps = g.rel("EXECUTION_STEP").where(F.col("src") == uid)
    return steps.join(g.label("Function"), F.col("dst") == F.col("uid")).select("stepOrder", F.col("name").alias("function"), "file", "uid")


def click_to_state_changes(g: Graph, component: str, k: int | None = 20) -> DataFrame:
    e = prefixed(g.label("UserEvent").where(F.col("componentName") == component), "e")
    out = hop(g, hop(g, e, "e_uid", "EXECUTION_STEP", "Function", "f"), "f_uid", "WRITES_STATE", "State", "s")
    return _top(out.select(F.col("e_timestamp").alias("occurredAt"), F.col("f_name").alias("writer"), F.col("s_name").alias("state")), [F.desc("occurredAt"), "writer", "state"], k)


def click_full_trace(g: Graph, component: str, max_hops: int = 5, k: int | None = 10) -> DataFrame:
    """Per event on a component: functions called from it and states those write."""
    e = hop(g, prefixed(g.label("UserEvent").where(F.col("componentName") == component), "e"), "e_uid", "TRIGGERS", "Function", "c")
    e = written(_top(e, [F.desc("e_timestamp"), "c_name", "e_uid"], k))  # an event is a row of the result, so only k are walked from
    called = traverse.reach(g, e.select(F.col("c_uid").alias("uid")).distinct(), [CALLS], max_hops).where("dist > 0").join(g.label("Function").select(F.col("uid").alias("node"), F.col("name").alias("callee")), "node")
    states = _edges(g, "WRITES_STATE").select(F.col("src").alias("node"), F.col("dst").alias("s")).join(g.label("State").select(F.col("uid").alias("s"), F.col("name").alias("state")), "s")
    per = called.join(states, "node", "left").groupBy(F.col("origin").alias("c_uid")).agg(F.array_sort(F.collect_set("callee")).alias("calledFunctions"), F.array_sort(F.collect_set("state")).alias("stateChanges"))
    out = e.join(per, "c_uid", "left").select(F.col("e_timestamp").alias("occurredAt"), F.col("c_name").alias("component"), "calledFunctions", "stateChanges")
    return _top(out, [F.desc("occurredAt"), "component"], k)


def most_clicked_components(g: Graph, k: int = 20) -> DataFrame:
    out = g.rel("CLICKS_ON").join(g.label("Function"), F.col("dst") == F.col("uid")).select(F.col("name").alias("component"), F.col("count").alias("clicks"), "uid")
    return _top(out, [F.desc("clicks"), "uid"], k)


def execution_path_frequency(g: Graph, k: int | None = 15) -> DataFrame:
    out = g.label("UserEvent").groupBy(F.col("executionPathHex").alias("pathHex")).agg(F.count(F.lit(1)).alias("freq"))
    return _top(out, [F.desc("freq"), "pathHex"], k)


# ---- lookups ----


def find_by_name(g: Graph, name: str, labels: list[str] | None = None) -> DataFrame:
    n = g.nodes(labels)
    return n.where(F.col("name") == name).select("uid", "name", F.col("label").alias("type"), _column(n, "file").alias("file"), _column(n, "startLine").alias("line"))


def verify_terms(g: Graph, terms: list[str], labels: list[str] | None = None) -> DataFrame:
    """How many nodes have each term as their name, and in which files; 0 for none."""
    asked = g.spark.createDataFrame([(t,) for t in terms], "term string")
    n = g.nodes(labels).select("name", "file")
    return asked.join(n, F.col("term") == F.col("name"), "left").groupBy("term").agg(F.count("name").alias("hits"), F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))


def node_search(g: Graph, text: str, k: int = 51, labels: list[str] | None = None) -> DataFrame:
    """Nodes whose name (their file's, if they have none) holds ``text`` in any case: exact ones first, then those that
    begin with it. A caller who shows k - 1 knows by the last row that there are more."""
    low, want = F.lower(F.coalesce("name", "file")), text.lower()
    out = g.nodes(labels).where(F.contains(low, F.lit(want)))
    rank = F.when(low == want, 0).when(F.startswith(low, F.lit(want)), 1).otherwise(2)
    return _top(out.select("uid", "name", "file", rank.alias("rank")), ["rank", "name", "file", "uid"], k)


def label_census(g: Graph, labels: list[str] | None = None) -> DataFrame:
    return g.nodes(labels).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def edge_census(g: Graph, types: list[str] | None = None) -> DataFrame:
    return g.edges(types).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


def node_relations(g: Graph, uid: str, types: list[str] | None = None) -> DataFrame:
    """Edges of a node by direction and type."""
    e = g.edges(types)
    out = e.where(F.col("src") == uid).select(F.lit("out").alias("direction"), "rel_type").unionAll(e.where(F.col("dst") == uid).select(F.lit("in").alias("direction"), "rel_type"))
    return out.groupBy("direction", "rel_type").agg(F.count(F.lit(1)).alias("n"))
