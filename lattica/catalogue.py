"""All queries of the graph engine over the star-schema tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica import cypher
from lattica.functions import identity
from lattica.graph import Graph
from lattica.operators import budget, cycles, insertion, intervals, mutate, shortest, traverse
from lattica.plans import addresses, class_model, conformance, diff, impact, locks, messaging, rebuild, scheduling, scope, views, workflow
from lattica.plans import analyses as A
from lattica.scratch import written
from lattica.sources import dom, extract
from lattica.sources.app import APP_SQL, app_graph
from lattica.sources.dom import DOM_SQL
from lattica.sources.star import STAR_SQL, star_graph
from lattica.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BASE = "CALLS_FINISHED"
CODE = ["Function", "File", "Class", "State"]
TYPES = ["CALLS", "CONTAINS", "HAS_METHOD", "WRITES_STATE", "IMPORTS"]
ALL_EDGES = " UNION ALL ".join(f"SELECT '{t}' AS rel_type, src, dst FROM {v}" for t, v in zip(TYPES, ("calls", "contains", "hasm", "writes", "imports"), strict=True))
ALL_NODES = "SELECT 'Function' AS label, uid, name, file FROM fn UNION ALL SELECT 'File', uid, name, NULL FROM fi UNION ALL SELECT 'Class', uid, name, file FROM cl UNION ALL SELECT 'State', uid, name, NULL FROM st"


def _add(name: str, make: Callable[[Graph], DataFrame], sql: str | None = None, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(star_graph(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = f"WITH {'RECURSIVE' if recursive else ''} {STAR_SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"


def _table(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLE_SQL[name] = sql


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_add("dead_code", lambda g: A.dead_code(g).drop("frameworkKind", "specSignals"), """
SELECT f.uid, f.name AS function, f.file, CASE WHEN coalesce(t, 0) > 0 THEN 'planned_stub' WHEN visibility = 'public' THEN 'public_no_static_caller' ELSE 'private_no_caller' END AS category,
CASE WHEN coalesce(t, 0) > 0 THEN 'none' WHEN visibility = 'public' THEN 'low' ELSE 'medium' END AS "analysisConfidence", visibility, coalesce(t, 0) AS "taskSignals", false AS "passedAsCallback"
FROM fn f LEFT JOIN (SELECT dst, count(DISTINCT src) AS t FROM affects GROUP BY dst) a ON f.uid = a.dst WHERE f.uid NOT IN (SELECT dst FROM calls)""")
_add("direct_recursion", A.direct_recursion, "SELECT uid, name AS function, file FROM fn WHERE uid IN (SELECT src FROM calls WHERE src = dst)")
_add("call_resolution_quality", lambda g: A.call_resolution_quality(_resolved(g), "CALLS"), """
SELECT CASE WHEN x.file = y.file THEN 'same-file' ELSE 'imported-symbol' END AS "resolvedBy", count(*) AS edges FROM calls JOIN fn x ON src = x.uid JOIN fn y ON dst = y.uid GROUP BY 1""")
# closed walks of up to five hops: two sets of walks that meet
_add("recursion", lambda g: A.recursion(g), """
, s2 AS (SELECT DISTINCT a.src AS o, b.dst AS n FROM step a JOIN step b ON a.dst = b.src), s3 AS (SELECT DISTINCT o, dst AS n FROM s2 JOIN step ON n = src),
hit AS (SELECT a.src AS o FROM step a JOIN step b ON a.src = b.dst AND a.dst = b.src UNION SELECT o FROM s2 JOIN step ON o = dst AND n = src UNION SELECT a.o FROM s2 a JOIN s2 b ON a.o = b.n AND a.n = b.o UNION SELECT a.o FROM s3 a JOIN s2 b ON a.o = b.n AND a.n = b.o UNION SELECT src FROM calls WHERE src = dst)
SELECT uid, name AS "recursiveFunction", file FROM fn WHERE uid IN (SELECT o FROM hit)""")
_add("duplicate_functions_by_callees", lambda g: A.duplicate_functions_by_callees(g), """
SELECT a.uid, a.name AS "funcA", a.file AS "fileA", b.name AS "funcB", b.file AS "fileB", string_agg(s.name, ',' ORDER BY s.name) AS "sharedCallees", count(*) AS overlap
FROM calls x JOIN calls y ON x.dst = y.dst JOIN fn a ON x.src = a.uid JOIN fn b ON y.src = b.uid JOIN fn s ON x.dst = s.uid WHERE a.name < b.name GROUP BY a.uid, a.name, a.file, b.uid, b.name, b.file HAVING count(*) >= 2""")
_add("duplicate_functions_by_signature", A.duplicate_functions_by_signature, """
SELECT a.name AS "funcA", a.file AS "fileA", b.name AS "funcB", b.file AS "fileB", a.params AS "sharedSignature" FROM fn a JOIN fn b ON a.params = b.params WHERE a.name < b.name AND a.params <> '()'""")
_add("duplicate_functions_by_callers_and_callees", lambda g: A.duplicate_functions_by_callers_and_callees(g), """
, up AS (SELECT a.uid AS a, b.uid AS b, string_agg(DISTINCT s.name, ',' ORDER BY s.name) AS l FROM calls x JOIN calls y ON x.src = y.src JOIN fn a ON x.dst = a.uid JOIN fn b ON y.dst = b.uid JOIN fn s ON x.src = s.uid WHERE a.name < b.name GROUP BY 1, 2),
dn AS (SELECT a.uid AS a, b.uid AS b, string_agg(DISTINCT s.name, ',' ORDER BY s.name) AS l FROM calls x JOIN calls y ON x.dst = y.dst JOIN fn a ON x.src = a.uid JOIN fn b ON y.src = b.uid JOIN fn s ON x.dst = s.uid WHERE a.name < b.name GROUP BY 1, 2)
SELECT p.name AS "funcA", q.name AS "funcB", up.l AS "sharedCallers", dn.l AS "sharedCallees", up.a AS uid, up.b AS "uidB" FROM up JOIN dn ON up.a = dn.a AND up.b = dn.b JOIN fn p ON up.a = p.uid JOIN fn q ON up.b = q.uid""")
_add("most_called_functions", A.most_called_functions, 'SELECT uid, name AS function, file, "calledBy" FROM (SELECT dst, count(*) AS "calledBy" FROM calls GROUP BY dst ORDER BY 2 DESC, dst LIMIT 20) JOIN fn ON dst = uid')
_add("most_complex_functions", lambda g: A.most_complex_functions(g, "CALLS", None), """
, a AS (SELECT src, count(DISTINCT dst) AS fo, count(DISTINCT file) AS ms FROM calls JOIN fn ON dst = uid GROUP BY src), b AS (SELECT src, count(DISTINCT dst) AS de, max(depth) AS mn FROM flows GROUP BY src), c AS (SELECT src, count(DISTINCT dst) AS sw FROM writes GROUP BY src),
m AS (SELECT uid, name AS function, file, "endLine" - "startLine" + 1 AS lines, CAST(0 AS BIGINT) AS parameters, coalesce(de, 0) AS decisions, coalesce(mn, 0) AS "maxNesting", coalesce(fo, 0) AS "internalFanOut", coalesce(sw, 0) AS "stateWrites", coalesce(ms, 0) AS "moduleSpread" FROM fn LEFT JOIN a ON uid = a.src LEFT JOIN b ON uid = b.src LEFT JOIN c ON uid = c.src),
s AS (SELECT *, CAST(lines + decisions * 5 + "maxNesting" * 6 + "stateWrites" * 4 + "moduleSpread" * 3 + 2 * greatest(0, "internalFanOut" - 8) AS BIGINT) AS "refactoringScore" FROM m)
SELECT *, CASE WHEN "refactoringScore" >= 120 AND decisions >= 6 THEN 'high' WHEN "refactoringScore" >= 70 THEN 'medium' ELSE 'low' END AS "analysisConfidence" FROM s""")
_add("cyclomatic_complexity", lambda g: A.cyclomatic_complexity(g, None), 'SELECT uid, name AS function, file, coalesce(n, 0) + 1 AS "cyclomaticComplexity" FROM fn LEFT JOIN (SELECT src, count(*) AS n FROM flows GROUP BY src) ON uid = src')
_add("long_functions", A.long_functions, 'SELECT uid, name AS function, file, "endLine" - "startLine" + 1 AS lines FROM fn ORDER BY lines DESC, uid LIMIT 40')
_add("large_classes", lambda g: A.large_classes(g, "HAS_METHOD").drop("lines"), 'SELECT uid, name AS class, file, coalesce(n, 0) AS methods FROM cl LEFT JOIN (SELECT src, count(*) AS n FROM hasm GROUP BY src) ON uid = src ORDER BY methods DESC, uid LIMIT 40')
_add("entry_points", lambda g: A.entry_points(g), 'SELECT uid, name AS "entryPoint", file FROM fn WHERE uid IN (SELECT src FROM calls) AND uid NOT IN (SELECT dst FROM calls)')
_add("callers_of_function", lambda g: A.callers_of_function(g, _first_name(g)), """
SELECT a.name AS caller, a.file, a.uid, b.uid AS callee FROM calls JOIN fn a ON src = a.uid JOIN fn b ON dst = b.uid WHERE b.name = (SELECT min(name) FROM fn)""")
PATHS = ", p AS (SELECT src AS o, [src, dst] AS path, 1 AS hops FROM step WHERE src = (SELECT src FROM hub) UNION ALL SELECT o, list_append(path, step.dst), hops + 1 FROM p JOIN step ON path[-1] = step.src WHERE hops < {k} AND NOT list_contains(path, step.dst)) "
_add("call_chain", lambda g: A.call_chain(g, _hub(g)), PATHS.format(k=2) + """SELECT array_to_string(path, ',') AS "callChain", CAST(hops AS BIGINT) AS hops FROM p ORDER BY hops, "callChain" LIMIT 30""", True)


def _first_cycles(edges: str, most: int) -> str:
    """Tables w1 to w<most>: the first walk of so many edges between two nodes; and cyc, each node's first shortest cycle."""
    parts = [f"w1 AS (SELECT src AS o, dst AS n, [src, dst] AS path FROM {edges} WHERE src <> dst)"]
    parts += [f"w{k} AS (SELECT o, dst AS n, min(list_append(path, dst)) AS path FROM w{k - 1} JOIN {edges} ON n = src WHERE n <> o AND src <> dst GROUP BY 1, 2)" for k in range(2, most + 1)]
    every = " UNION ALL ".join(f"SELECT o, path FROM w{k} WHERE o = n" for k in range(2, most + 1))
    return f", {', '.join(parts)}, cyc AS (SELECT o, arg_min(path, len(path)) AS path FROM ({every}) GROUP BY o) "


_add("circular_imports", lambda g: A.circular_imports(g, "IMPORTS", 6), _first_cycles("imports", 6) + """SELECT uid, fi.path, array_to_string(cyc.path, ',') AS "importCycle" FROM fi JOIN cyc ON uid = o""")
# the same questions to the sparse calls of urgent orders, where both answers occur
_add("circular_calls_urgent", lambda g: A.circular_imports(g, "CALLS_URGENT", 6, "Function").drop("path"), _first_cycles("urgent", 6) + """SELECT uid, array_to_string(path, ',') AS "importCycle" FROM fn JOIN cyc ON uid = o""")
_add("recursion_urgent", lambda g: A.recursion(g, "CALLS_URGENT"), _first_cycles("urgent", 5) + """SELECT uid, name AS "recursiveFunction", file FROM fn WHERE uid IN (SELECT o FROM cyc UNION SELECT src FROM urgent WHERE src = dst)""")
_add("entry_points_urgent", lambda g: A.entry_points(g, "CALLS_URGENT"), 'SELECT uid, name AS "entryPoint", file FROM fn WHERE uid IN (SELECT src FROM urgent) AND uid NOT IN (SELECT dst FROM urgent)')
_add("dead_code_urgent", lambda g: A.dead_code(g, "CALLS_URGENT").drop("frameworkKind", "specSignals"), """
SELECT f.uid, f.name AS function, f.file, CASE WHEN coalesce(t, 0) > 0 THEN 'planned_stub' WHEN visibility = 'public' THEN 'public_no_static_caller' ELSE 'private_no_caller' END AS category,
CASE WHEN coalesce(t, 0) > 0 THEN 'none' WHEN visibility = 'public' THEN 'low' ELSE 'medium' END AS "analysisConfidence", visibility, coalesce(t, 0) AS "taskSignals", false AS "passedAsCallback"
FROM fn f LEFT JOIN (SELECT dst, count(DISTINCT src) AS t FROM affects GROUP BY dst) a ON f.uid = a.dst WHERE f.uid NOT IN (SELECT dst FROM urgent)""")
_add("strong_components", lambda g: cycles.components(g.rel("CALLS_URGENT")), """
, r AS (SELECT src AS o, dst AS n FROM urgent WHERE src <> dst UNION SELECT o, dst FROM r JOIN urgent ON n = src), both_ AS (SELECT a.o, a.n FROM r a JOIN r b ON a.o = b.n AND a.n = b.o)
SELECT o AS uid, min(n) AS component, count(*) AS size FROM both_ GROUP BY o HAVING count(*) > 1""", True)
QUERIES["component_cycles"] = lambda spark, d: cycles.component_cycles(star_graph(spark, d).rel("CALLS_URGENT")).withColumn("cycle", F.array_join("cycle", ","))


def _urgent(g: Graph) -> Graph:
    """The graph whose calls are those of urgent orders."""
    return _with(g, "CALLS", lambda: g.rel("CALLS_URGENT"))


_add("recursion_pattern", lambda g: cypher.run(_urgent(g), "MATCH (f:Function)-[:CALLS*1..5]->(f) RETURN DISTINCT elementId(f) AS uid, f.name AS recursiveFunction, f.file AS file"), ORACLE_SQL["recursion_urgent"].split("WITH ", 1)[1].split(STAR_SQL, 1)[1])
# walks that use no edge twice, from each function back to itself
_add("closed_walks", lambda g: cypher.run(_urgent(g), "MATCH path = (a:Function)-[:CALLS*2..5]->(a) RETURN elementId(a) AS uid, [n IN nodes(path) | n.name] AS names").select("uid", F.array_join("names", ",").alias("cycle")), """
, e AS (SELECT src, dst, src || '>' || dst AS id FROM urgent), w AS (SELECT src AS o, [src, dst] AS path, [id] AS used FROM e UNION ALL SELECT o, list_append(path, dst), list_append(used, id) FROM w JOIN e ON path[-1] = src WHERE len(used) < 5 AND NOT list_contains(used, id))
, c AS (SELECT row_number() OVER () AS k, o, path FROM w WHERE len(used) >= 2 AND path[-1] = o), x AS (SELECT k, o, unnest(range(len(path))) AS i, unnest(path) AS node FROM c)
SELECT o AS uid, string_agg(fn.name, ',' ORDER BY i) AS cycle FROM x JOIN fn ON node = fn.uid GROUP BY k, o""", True)


def _far(g: Graph) -> DataFrame:
    """The first and the last function of each finished order."""
    t = g.rel("AFFECTS").join(g.label("Task").where("status = 'done'").select(F.col("uid").alias("src")), "src", "left_semi")
    return t.groupBy("src").agg(F.min("dst").alias("start"), F.max("dst").alias("target")).select("start", "target")


_WALKS = ", w0 AS (SELECT DISTINCT src AS o, src AS n, CAST(1 AS BIGINT) AS c FROM urgent)" + "".join(f", w{k} AS (SELECT o, dst AS n, CAST(sum(c) AS BIGINT) AS c FROM w{k - 1} JOIN urgent ON n = src WHERE src <> dst GROUP BY 1, 2)" for k in range(1, 7))
_FAR = ", far AS (SELECT DISTINCT min(dst) AS start, max(dst) AS target FROM affects JOIN ta ON src = ta.uid WHERE status = 'done' GROUP BY src)"
_add("shortest_pairs", lambda g: shortest.shortest(g.rel("CALLS_URGENT"), _far(g), 6), _WALKS + _FAR + f"""
, d AS ({" UNION ALL ".join(f"SELECT start, target, {k} AS hops, c FROM far JOIN w{k} ON o = start AND n = target WHERE start <> target" for k in range(1, 7))})
SELECT start, target, CAST(min(hops) AS BIGINT) AS hops, arg_min(c, hops) AS paths FROM d GROUP BY 1, 2 UNION ALL SELECT start, target, CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM far WHERE start = target""")
QUERIES["budget_view"] = lambda spark, d: _budget_view(star_graph(spark, d))


def _budget_view(g: Graph) -> DataFrame:
    """500 connected nodes of the code, a quarter of them without edges if there are such."""
    return budget.connected(g.nodes(CODE).select("uid", "label"), g.edges(TYPES), 500, isolated=True)


def _edits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as edits of the file of their part, from the part's first line on, as many lines as were ordered; and
    parts as spans."""
    f = star_graph(spark, d).label("Function").select("uid", "file", F.col("startLine").alias("start"), F.col("endLine").alias("end"))
    line = _read(spark, d, "lineitem").select(F.concat(F.lit("Task:"), "l_orderkey").alias("task"), F.concat(F.lit("Function:"), "l_partkey").alias("uid"), F.col("l_quantity").cast("long").alias("n"), F.to_date("l_shipdate").alias("at"))
    edits = line.join(f.select("uid", "file", "start"), "uid").select("task", "file", "start", (F.col("start") + F.col("n") - 1).alias("end"), "at")
    return edits, f


_EDITS = ', ed AS (SELECT \'Task:\' || l_orderkey AS task, file, "startLine" AS s, "startLine" + CAST(l_quantity AS BIGINT) - 1 AS e, CAST(l_shipdate AS DATE) AS "at" FROM lineitem JOIN fn ON uid = \'Function:\' || l_partkey) '
QUERIES["touched_functions"] = lambda spark, d: intervals.touches(*_edits(spark, d))
ORACLE_SQL["touched_functions"] = f"""WITH {STAR_SQL} {_EDITS}
SELECT task, uid, ed.file, max("at") AS "at", min("at") AS "firstAt", count(*) AS edits, CAST(sum(least(e, "endLine") - greatest(s, "startLine") + 1) AS BIGINT) AS lines FROM ed JOIN fn ON ed.file = fn.file AND s <= "endLine" AND "startLine" <= e GROUP BY 1, 2, 3"""
QUERIES["innermost_function"] = lambda spark, d: _innermost(spark, d)
ORACLE_SQL["innermost_function"] = f"""WITH {STAR_SQL} {_EDITS}
, l AS (SELECT DISTINCT file, e AS line FROM ed), h AS (SELECT l.file, line, arg_min(uid, ("endLine" - "startLine", -"startLine", uid)) AS inner_ FROM l JOIN fn ON l.file = fn.file AND line BETWEEN "startLine" AND "endLine" GROUP BY 1, 2)
SELECT ed.file, e AS line, inner_ AS "inner", count(*) AS n FROM ed LEFT JOIN h ON ed.file = h.file AND e = line GROUP BY 1, 2, 3"""
_add("nested_spans", lambda g: intervals.nested(g.label("Function").select("uid", "file", F.col("startLine").alias("start"), F.col("endLine").alias("end")), "file").select("uid", "parent"), """
SELECT a.uid, arg_min(b.uid, (b."endLine" - b."startLine", -b."startLine", b.uid)) AS parent FROM fn a LEFT JOIN fn b ON a.file = b.file AND b."startLine" <= a."startLine" AND b."endLine" >= a."endLine" AND b."endLine" - b."startLine" > a."endLine" - a."startLine" GROUP BY a.uid""")


def _innermost(spark: SparkSession, d: str) -> DataFrame:
    """How often each line is an edit's last, and the innermost function there."""
    edits, f = _edits(spark, d)
    points = written(edits.groupBy("file", F.col("end").alias("line")).agg(F.count(F.lit(1)).alias("n")))
    return intervals.innermost(points, f, "file").select("file", "line", "inner", "n")


_add("files_overview", lambda g: A.files_overview(g).drop("lang"), "SELECT path AS file, coalesce(n, 0) AS functions FROM fi LEFT JOIN (SELECT src, count(*) AS n FROM contains GROUP BY src) ON uid = src")
_add("react_state_writers", A.react_state_writers, 'SELECT f.uid, f.name AS component, s.name AS "stateSetter", f.file FROM writes JOIN fn f ON src = f.uid JOIN st s ON dst = s.uid')
_add("user_events", A.user_events, """SELECT 'UserEvent:' || event_id AS uid, 'User:' || user_id AS "user", event_type AS type, ts AS "timestamp" FROM events ORDER BY ts DESC, uid LIMIT 30""")
_add("find_by_name", lambda g: A.find_by_name(g, "Customer", CODE).unionByName(A.find_by_name(g, _first_name(g), CODE)).drop("line"), f"SELECT uid, name, label AS type, file FROM ({ALL_NODES}) WHERE name = 'Customer' OR name = (SELECT min(name) FROM fn)")
_add("verify_terms", lambda g: A.verify_terms(g, ["Brand#11", "NATION_3", "no such name"], CODE), f"SELECT term, count(n.uid) AS hits, coalesce(string_agg(DISTINCT n.file, ',' ORDER BY n.file), '') AS files FROM (VALUES ('Brand#11'), ('NATION_3'), ('no such name')) t(term) LEFT JOIN ({ALL_NODES}) n ON n.name = term GROUP BY term")
_add("node_search", lambda g: A.node_search(g, "_1", 51, ["State", "Class"]), f"SELECT uid, name, file, CAST(CASE WHEN lower(name) = '_1' THEN 0 WHEN starts_with(lower(name), '_1') THEN 1 ELSE 2 END AS INTEGER) AS rank FROM ({ALL_NODES}) WHERE label IN ('State', 'Class') AND contains(lower(name), '_1') ORDER BY rank, name, file NULLS FIRST, uid LIMIT 51")
_add("label_census", lambda g: A.label_census(g, CODE), f"SELECT label, count(*) AS n FROM ({ALL_NODES}) GROUP BY label")
_add("edge_census", lambda g: A.edge_census(g, TYPES), f"SELECT rel_type, count(*) AS n FROM ({ALL_EDGES}) GROUP BY rel_type")
_add("node_relations", lambda g: A.node_relations(g, "Function:7", TYPES), f"SELECT CASE WHEN src = 'Function:7' THEN 'out' ELSE 'in' END AS direction, rel_type, count(*) AS n FROM (SELECT * FROM ({ALL_EDGES}) WHERE src = 'Function:7' UNION ALL SELECT rel_type, '-' AS src, dst FROM ({ALL_EDGES}) WHERE dst = 'Function:7') GROUP BY 1, 2")
_add("label_adjacency", lambda g: traverse.adjacency(g, CODE, TYPES), f", e AS (SELECT DISTINCT x.label AS a, y.label AS b FROM ({ALL_EDGES}) JOIN ({ALL_NODES}) x ON src = x.uid JOIN ({ALL_NODES}) y ON dst = y.uid) SELECT a AS from_label, b AS to_label FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b")
_add("degree", lambda g: traverse.degree(g, CODE, TYPES), f"SELECT n.uid, CAST(count(e.uid) AS BIGINT) AS degree FROM ({ALL_NODES}) n LEFT JOIN (SELECT src AS uid FROM ({ALL_EDGES}) UNION ALL SELECT dst FROM ({ALL_EDGES})) e ON n.uid = e.uid GROUP BY n.uid")
# seeds: the functions that call themselves
_add("reach", lambda g: traverse.reach(g, _selfish(g), ["CALLS"], 3), """
, w AS (SELECT DISTINCT src AS o, src AS n, 0 AS k FROM calls WHERE src = dst UNION SELECT o, step.dst, k + 1 FROM w JOIN step ON n = step.src WHERE k < 3) SELECT o AS origin, n AS node, CAST(min(k) AS BIGINT) AS dist FROM w GROUP BY o, n""", True)
_add("shortest_routes", lambda g: _routes(g), PATHS.format(k=3) + """, t AS (SELECT path, hops FROM p WHERE path[-1] = (SELECT max(path[-1]) FROM p WHERE hops = 2)), m AS (SELECT min(hops) AS h FROM t)
SELECT CAST(hops AS BIGINT) AS hops, array_to_string(path, ',') AS path FROM t, m WHERE hops = h ORDER BY t.path LIMIT 5""", True)
_add("induced_subgraph", lambda g: traverse.induced(g, g.spark.createDataFrame([(_hub(g),)], "uid string"), ["CALLS"], 2), """
, u AS (SELECT src, dst FROM step UNION SELECT dst, src FROM step), w AS (SELECT src AS n, 0 AS k FROM hub UNION SELECT u.dst, k + 1 FROM w JOIN u ON n = u.src WHERE k < 2)
SELECT 'CALLS' AS rel_type, src, dst FROM calls WHERE src IN (SELECT n FROM w) AND dst IN (SELECT n FROM w)""", True)
_add("impact", lambda g: impact.impact(g, _selfish(g), ["CALLS"], "balanced"), """
, w AS (SELECT DISTINCT src AS seed, src AS n, 0 AS k FROM calls WHERE src = dst UNION SELECT seed, step.src, k + 1 FROM w JOIN step ON n = step.dst WHERE k < 2),
d AS (SELECT seed, n, min(k) AS k FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY k, n) AS i FROM d)
SELECT seed, n AS uid, CAST(k AS BIGINT) AS dist, CASE WHEN k = 0 THEN 'exact' ELSE 'unknown' END AS confidence FROM r WHERE i <= 200""", True)
IMPACT_SQL = """
, s AS (SELECT DISTINCT src AS u FROM calls WHERE src = dst), e1 AS (SELECT u AS seed, src AS n, u || ':CALLS:in:' || src AS path FROM s JOIN step ON dst = u),
o1 AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY path) AS i FROM e1), b1 AS (SELECT * FROM o1 WHERE i <= 199), used AS (SELECT u AS seed, 1 + count(n) AS k FROM s LEFT JOIN b1 ON u = seed GROUP BY u),
e2 AS (SELECT seed, step.src AS n, path || '|' || n || ':CALLS:in:' || step.src AS path FROM b1 JOIN step ON step.dst = n WHERE step.src <> seed AND NOT EXISTS (SELECT 1 FROM b1 x WHERE x.seed = b1.seed AND x.n = step.src)),
f2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, n ORDER BY path) AS r FROM e2) WHERE r <= 3),
o2 AS (SELECT seed, n, row_number() OVER (PARTITION BY seed ORDER BY min(path)) AS i FROM f2 GROUP BY seed, n), b2 AS (SELECT o2.seed, n FROM o2 JOIN used ON o2.seed = used.seed WHERE i + k <= 200),
paths AS (SELECT u AS seed, u AS uid, 0 AS dist, '' AS path FROM s UNION ALL SELECT seed, n, 1, path FROM b1 UNION ALL SELECT f2.seed, f2.n, 2, path FROM f2 JOIN b2 ON f2.seed = b2.seed AND f2.n = b2.n),
omitted AS (SELECT seed, n FROM o1 WHERE i > 199 UNION SELECT o2.seed, o2.n FROM o2 ANTI JOIN b2 ON o2.seed = b2.seed AND o2.n = b2.n)
"""
_add("impact_paths", lambda g: impact.explore(g, _selfish(g), impact.profile_of("balanced", ["CALLS"]))[0].select("seed", "uid", "dist", "path"), IMPACT_SQL + "SELECT seed, uid, CAST(dist AS BIGINT) AS dist, path FROM paths")
_add("impact_attachments", lambda g: impact.attachments(g, impact.explore(g, _selfish(g), impact.profile_of("fast", ["CALLS"]))[0], ["Function", "Task"], ["AFFECTS"]), """
, s AS (SELECT DISTINCT src AS u FROM calls WHERE src = dst), v AS (SELECT u AS seed, u AS n FROM s UNION SELECT seed, n FROM (SELECT u AS seed, src AS n, row_number() OVER (PARTITION BY u ORDER BY u || ':CALLS:in:' || src) AS i FROM s JOIN step ON dst = u) WHERE i <= 99)
SELECT seed, 'tasks' AS section, src AS uid, string_agg(DISTINCT 'AFFECTS:' || n, ',' ORDER BY 'AFFECTS:' || n) AS reasons FROM v JOIN affects ON dst = n GROUP BY seed, src""")
_add("impact_quality", lambda g: _impact_quality(g), IMPACT_SQL + """
, used2 AS (SELECT seed, count(DISTINCT x) AS n FROM (SELECT seed, unnest(string_split(path, '|')) AS x FROM paths WHERE path <> '') GROUP BY seed), om AS (SELECT seed, count(*) AS n FROM omitted GROUP BY seed),
q AS (SELECT u AS seed, coalesce(used2.n, 0) AS edges, coalesce(om.n, 0) AS omitted FROM s LEFT JOIN used2 ON u = used2.seed LEFT JOIN om ON u = om.seed)
SELECT seed, edges, edges AS unknown, CAST(0 AS BIGINT) AS possible, CAST(0 AS BIGINT) AS likely, CAST(0 AS BIGINT) AS exact, omitted, concat_ws(',', CASE WHEN omitted > 0 THEN 'node-limit-reached' END, CASE WHEN edges > 0 THEN 'unknown-edge-evidence' END) AS limitations,
CASE WHEN omitted > 0 OR edges > 0 THEN 'qualified' ELSE 'eligible' END AS status, CASE WHEN omitted > 0 THEN 'incomplete' ELSE 'none-found' END AS test_selection, CASE WHEN omitted > 0 THEN 'incomplete' ELSE 'none-linked' END AS knowledge_review FROM q""")
SNAP = "SELECT 'Function' AS label, name, file, \"startLine\", \"endLine\", params, 'Function|' || name || '|' || file || CASE WHEN r > 1 THEN '#' || (r - 1) ELSE '' END AS key FROM (SELECT *, row_number() OVER (PARTITION BY name, file ORDER BY \"startLine\", \"endLine\", params) AS r FROM {t})"
_add("snapshot_diff", lambda g: diff.node_diff(*_snapshots(g)), f"""
, fb AS (SELECT uid, name, file, params, "startLine", least("endLine", "startLine" + 40) AS "endLine" FROM fn WHERE uid IN (SELECT dst FROM affects JOIN ta ON src = ta.uid WHERE status = 'done')), fh AS (SELECT * FROM fn), b AS ({SNAP.format(t="fb")}), h AS ({SNAP.format(t="fh")})
SELECT coalesce(b.key, h.key) AS key, 'Function' AS label, coalesce(h.name, b.name) AS name, coalesce(h.file, b.file) AS file, CASE WHEN b.key IS NULL THEN 'added' WHEN h.key IS NULL THEN 'removed' ELSE 'changed' END AS status,
CASE WHEN b.key IS NULL OR h.key IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.params <> h.params THEN 'signature' END, CASE WHEN b."endLine" - b."startLine" <> h."endLine" - h."startLine" THEN 'span' END) END AS reasons
FROM b FULL JOIN h ON b.key = h.key WHERE b.key IS NULL OR h.key IS NULL OR b.params <> h.params OR b."endLine" - b."startLine" <> h."endLine" - h."startLine\"""")
_add("edge_diff", lambda g: diff.edge_diff(g.edges([BASE]).withColumn("rel_type", F.lit("CALLS")), g.edges(["CALLS"])), "SELECT 'CALLS' AS rel_type, src, dst, 'added' AS status FROM (SELECT * FROM calls EXCEPT SELECT * FROM loc)")
_add("blast_radius", lambda g: diff.blast_radius(g.spark.createDataFrame([], "key string"), diff.edge_diff(g.edges([BASE]).withColumn("rel_type", F.lit("CALLS")), g.edges(["CALLS"]))), """
, d AS (SELECT * FROM calls EXCEPT SELECT * FROM loc) SELECT key, string_agg(DISTINCT r, ',' ORDER BY r) AS reasons, count(*) AS n FROM (SELECT src AS key, 'gained-out' AS r FROM d UNION ALL SELECT dst, 'gained-in' FROM d) GROUP BY key""")


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as functions before and after a rebuild: of five, one is renamed; of seven, one moves to the next brand's file;
    of eleven, one is copied there too; of thirteen, one is gone. Uids are hashes of names and files."""
    p = _read(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("params"), F.concat_ws(" ", "p_type", F.expr("p_partkey div 2").cast("string")).alias("body"))
    more = lambda df, *copy: df.select(F.sha2(F.concat_ws("::", "name", "file", F.col("p_partkey").cast("string"), *copy), 256).alias("uid"), F.lit("Function").alias("label"), "name", "file", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("owner"), "params", "body")
    by = lambda n: F.pmod("p_partkey", F.lit(n)) == 0
    brands = p.select("file").distinct()
    after = brands.select("file", F.coalesce(F.lead("file").over(Window.orderBy("file")), F.col("file")).alias("next"))  # one row a brand
    moved = p.join(F.broadcast(after), "file").withColumn("home", F.when(by(7), F.col("next")).otherwise(F.col("file")))
    now = moved.where(~by(13)).select("p_partkey", F.when(by(5), F.concat("name", F.lit(" v2"))).otherwise(F.col("name")).alias("name"), F.col("home").alias("file"), "next", "params", "body")
    copies = now.where(by(11)).withColumn("file", F.col("next"))
    return more(p), more(now).unionByName(more(copies, F.lit("copy")))


_VERSIONS_SQL = """WITH p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS file, p_type || ' ' || p_size AS params, p_type || ' ' || (p_partkey // 2) AS body FROM part),
nx AS (SELECT file, coalesce(lead(file) OVER (ORDER BY file), file) AS next FROM (SELECT DISTINCT file FROM p)),
o AS (SELECT sha256(name || '::' || file || '::' || k) AS uid, * FROM p),
m AS (SELECT k, CASE WHEN k % 5 = 0 THEN name || ' v2' ELSE name END AS name, CASE WHEN k % 7 = 0 THEN next ELSE file END AS file, next, params, body FROM p JOIN nx USING (file) WHERE k % 13 <> 0),
n AS (SELECT sha256(name || '::' || file || '::' || k) AS uid, name, file, params, body FROM m UNION ALL SELECT sha256(name || '::' || next || '::' || k || '::copy'), name, next, params, body FROM m WHERE k % 11 = 0),
un AS (SELECT name, file, min(uid) AS now FROM n GROUP BY ALL HAVING count(*) = 1), uh AS (SELECT file, params, body, min(uid) AS now FROM n GROUP BY ALL HAVING count(*) = 1), ub AS (SELECT params, body, min(uid) AS now FROM n GROUP BY ALL HAVING count(*) = 1),
known AS (SELECT o.uid, coalesce(n.uid, un.now, uh.now, ub.now) AS now, CASE WHEN n.uid IS NOT NULL THEN 'uid' WHEN un.now IS NOT NULL THEN 'name' WHEN coalesce(uh.now, ub.now) IS NOT NULL THEN 'body' END AS how
FROM o LEFT JOIN n ON o.uid = n.uid LEFT JOIN un ON o.name = un.name AND o.file = un.file LEFT JOIN uh ON o.file = uh.file AND o.params = uh.params AND o.body = uh.body LEFT JOIN ub ON o.params = ub.params AND o.body = ub.body)
"""
_table("rebuilt_identities", lambda spark, d: rebuild.identities(*_versions(spark, d)), _VERSIONS_SQL + "SELECT * FROM known")


def _reattached(spark: SparkSession, d: str) -> DataFrame:
    """Calls of urgent orders, on what their functions are after the rebuild."""
    old, new = _versions(spark, d)
    key = _read(spark, d, "part").select(F.concat(F.lit("Function:"), "p_partkey").alias("f"), F.sha2(F.concat_ws("::", "p_name", "p_brand", F.col("p_partkey").cast("string")), 256).alias("uid"))
    e = star_graph(spark, d).rel("CALLS_URGENT")
    for end in ("src", "dst"):
        e = e.join(key.select(F.col("f").alias(end), F.col("uid").alias(f"{end}_")), end).drop(end)
    back, _ = rebuild.reattached(e.select(F.lit("CALLS").alias("rel_type"), F.col("src_").alias("src"), F.col("dst_").alias("dst")), rebuild.identities(old, new))
    return back


QUERIES["reattached_calls"] = _reattached
ORACLE_SQL["reattached_calls"] = f"WITH {STAR_SQL}, " + _VERSIONS_SQL.split("WITH ", 1)[1] + """SELECT DISTINCT 'CALLS' AS rel_type, a.now AS src, b.now AS dst FROM urgent JOIN o x ON src = 'Function:' || x.k JOIN o y ON dst = 'Function:' || y.k JOIN known a ON x.uid = a.uid JOIN known b ON y.uid = b.uid WHERE a.now IS NOT NULL AND b.now IS NOT NULL"""
_add("rebuild_files", lambda g: rebuild.affected(g.label("Class").where("uid LIKE '%7'").select("file"), g.label("Class").select("uid", "file"), g.rel("HAS_METHOD").select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(g.rel("HAS_METHOD").select(F.col("src").alias("home"), F.col("dst").alias("src")), "src").select(F.col("home").alias("src"), "dst")), """
, ch AS (SELECT DISTINCT file FROM cl WHERE uid LIKE '%7'), dep AS (SELECT DISTINCT a.file FROM hasm x JOIN hasm y ON x.dst = y.dst JOIN cl a ON x.src = a.uid JOIN cl b ON y.src = b.uid WHERE b.file IN (SELECT file FROM ch))
SELECT file, 'changed' AS reason FROM ch UNION ALL SELECT file, 'dependent' FROM dep WHERE file NOT IN (SELECT file FROM ch)""")


def _insertions(spark: SparkSession, d: str) -> DataFrame:
    """New dependencies between a customer's orders, from each to the next by price, added by order number to the stored ones."""
    along = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    wanted = _read(spark, d, "orders").select("o_orderkey", F.lead("o_orderkey").over(along).alias("next")).where("next IS NOT NULL")
    wanted = wanted.select(F.concat(F.lit("Task:"), "o_orderkey").alias("src"), F.concat(F.lit("Task:"), "next").alias("dst"), F.col("o_orderkey").cast("long").alias("place"))
    return insertion.insertable(star_graph(spark, d).rel("DEPENDS_ON"), wanted)


QUERIES["edge_insertion"] = _insertions
_LONG = 'SELECT uid AS key FROM fn WHERE "endLine" - "startLine" > 40'
_add("blast_radius_changed", lambda g: diff.blast_radius(g.label("Function").where("endLine - startLine > 40").select(F.col("uid").alias("key")), diff.edge_diff(g.edges([BASE]).withColumn("rel_type", F.lit("CALLS")), g.edges(["CALLS"]))), f"""
, d AS (SELECT * FROM calls EXCEPT SELECT * FROM loc) SELECT key, string_agg(DISTINCT r, ',' ORDER BY r) AS reasons, count(*) AS n FROM (SELECT src AS key, 'gained-out' AS r FROM d UNION ALL SELECT dst, 'gained-in' FROM d) WHERE key NOT IN ({_LONG}) GROUP BY key""")
_add("change_impact", lambda g: impact.change_impact(_urgent(g), g.label("Function").where("endLine - startLine > 40").select("uid", F.lit("changed").alias("status")), ["CALLS"], seeds=None).drop("confidence"), f"""
, b AS (SELECT dst AS n, src AS m FROM urgent WHERE src <> dst), s AS ({_LONG}), w AS (SELECT key AS seed, key AS uid, 0 AS k FROM s UNION ALL SELECT key, m, 1 FROM s JOIN b ON key = n UNION ALL SELECT key, y.m, 2 FROM s JOIN b x ON key = x.n JOIN b y ON x.m = y.n),
z AS (SELECT seed, uid, min(k) AS k FROM w GROUP BY 1, 2) SELECT seed, 'changed' AS status, uid, CAST(k AS BIGINT) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY k, uid) AS r FROM z) WHERE r <= 100""")
_add("locked_nodes", lambda g: views.locked_nodes(_urgent(g), g.label("Function").where("visibility = 'private'")).drop("reads", "returns"), """
SELECT uid, coalesce((SELECT string_agg(DISTINCT a.name, ',' ORDER BY a.name) FROM urgent JOIN fn a ON src = a.uid WHERE dst = f.uid), '') AS callers, coalesce((SELECT string_agg(DISTINCT a.name, ',' ORDER BY a.name) FROM urgent JOIN fn a ON dst = a.uid WHERE src = f.uid), '') AS callees,
coalesce((SELECT string_agg(DISTINCT st.name, ',' ORDER BY st.name) FROM writes JOIN st ON dst = st.uid WHERE src = f.uid), '') AS writes FROM fn f WHERE visibility = 'private'""")
EVERY_EDGE = f"{ALL_EDGES} UNION ALL SELECT 'AFFECTS', src, dst FROM affects UNION ALL SELECT 'DEPENDS_ON', src, dst FROM depends"
EVERY_NODE = f"SELECT label, uid FROM ({ALL_NODES}) UNION ALL SELECT 'Task', uid FROM ta"
_add("level_report", lambda g: scope.report(g, 1, ("PERFORMED", "CALLS_FINISHED", "CALLS_URGENT", "CONTAINS_FLOW")), f""", nn AS ({EVERY_NODE}), ee AS (SELECT src, dst, x.label AS a, y.label AS b FROM ({EVERY_EDGE}) JOIN nn x ON src = x.uid JOIN nn y ON dst = y.uid WHERE src <> dst),
ends AS (SELECT src AS uid FROM ee UNION SELECT dst FROM ee), adj AS (SELECT DISTINCT a, b FROM ee WHERE a <> b UNION SELECT DISTINCT b, a FROM ee WHERE a <> b)
SELECT label, count(*) AS n, count(ends.uid) AS connected, coalesce((SELECT string_agg(b, ',' ORDER BY b) FROM adj WHERE a = label), '') AS near FROM nn LEFT JOIN ends ON nn.uid = ends.uid GROUP BY label""")
_add("pattern_query_urgent", lambda g: cypher.run(_urgent(g), "MATCH (a:Function)-[:CALLS]->(b:Function) WHERE a.visibility = 'public' AND NOT (b)-[:CALLS]->() RETURN a.file AS file, count(*) AS n, count(DISTINCT b.uid) AS targets ORDER BY n DESC, file LIMIT 10"), """
SELECT a.file, count(*) AS n, count(DISTINCT b.uid) AS targets FROM urgent JOIN fn a ON src = a.uid JOIN fn b ON dst = b.uid WHERE a.visibility = 'public' AND b.uid NOT IN (SELECT src FROM urgent) GROUP BY a.file ORDER BY n DESC, a.file LIMIT 10""")
_add("orphan_functions", lambda g: mutate.orphans(g.label("Function"), g.rel("CALLS_URGENT")).select("uid", "name"), "SELECT uid, name FROM fn WHERE uid NOT IN (SELECT dst FROM urgent UNION SELECT src FROM urgent)")
_add("quality_regressions", lambda g: scheduling.regressions(scheduling.quality_report(_quality_files(g)), scheduling.quality_baseline(scheduling.quality_report(_quality_files(g).where("sites % 2 = 0"))), 0.5), """
, q AS (SELECT file AS language, length(name) AS s, length(name) // 2 AS r FROM fn), now_ AS (SELECT language, round(1000.0 * sum(r) / sum(s)) / 10 AS p, count(*) AS e FROM q GROUP BY 1), was AS (SELECT language, round(1000.0 * sum(r) / sum(s)) / 10 AS p, count(*) AS e FROM q WHERE s % 2 = 0 GROUP BY 1)
SELECT language, 'resolution' AS gate, now_.p AS actual, was.p AS expected FROM was JOIN now_ USING (language) WHERE now_.p < was.p - 0.5 UNION ALL SELECT language, 'parse errors', CAST(now_.e AS DOUBLE), CAST(was.e AS DOUBLE) FROM was JOIN now_ USING (language) WHERE now_.e > was.e""")
_table("epic_order", lambda spark, d: views.epic_sequence(_read(spark, d, "orders").select(F.concat(F.lit("Epic:"), "o_custkey").alias("epic"), F.concat(F.lit("Task:"), "o_orderkey").alias("uid"), "o_orderdate"), "epic", ["o_orderdate"]), "SELECT 'Epic:' || o_custkey AS epic, 'Task:' || o_orderkey AS uid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, 'Task:' || o_orderkey) AS place FROM orders")
_add("next_tasks", lambda g: scheduling.next_tasks(g.label("Task"), g.rel("DEPENDS_ON")), """
 SELECT uid, status, priority FROM ta WHERE status IN ('todo', 'backlog') AND uid NOT IN (SELECT src FROM depends WHERE dst NOT IN (SELECT uid FROM ta WHERE status IN ('done', 'review')))
AND uid NOT IN (SELECT a.src FROM depends a JOIN depends b ON a.dst = b.src WHERE b.dst NOT IN (SELECT uid FROM ta WHERE status = 'done')) ORDER BY list_position(['todo', 'backlog'], status), list_position(['critical', 'high', 'medium', 'low'], priority), uid LIMIT 10""")
_add("task_waves", lambda g: traverse.waves(g.label("Task").select("uid"), g.rel("DEPENDS_ON")), """
, w AS (SELECT uid, 1 AS k FROM ta WHERE uid NOT IN (SELECT src FROM depends) UNION ALL SELECT depends.src, k + 1 FROM w JOIN depends ON depends.dst = w.uid) SELECT uid, CAST(k AS BIGINT) AS wave FROM w""", True)
_add("task_board", lambda g: scheduling.task_board(g.label("Task"), g.rel("AFFECTS")), "SELECT uid, status, priority, coalesce(n, 0) AS nodes FROM ta LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM affects GROUP BY src) ON uid = src")
_add("epic_progress", lambda g: scheduling.epic_progress(g.label("Task").select(F.col("priority").alias("epic"), "status")), "SELECT priority AS epic, count(*) AS tasks, count(*) FILTER (status = 'done') AS done, CASE WHEN bool_and(status = 'done') THEN 'done' WHEN bool_and(status IN ('done', 'review')) THEN 'review' WHEN bool_or(status IN ('in_progress', 'review', 'done')) THEN 'in_progress' ELSE 'todo' END AS status FROM ta GROUP BY priority")
_add("quality_report", lambda g: scheduling.quality_report(_quality_files(g)), """
, q AS (SELECT file AS language, CAST(1 AS BIGINT) AS e, CAST(length(name) AS BIGINT) AS s, CAST(length(name) // 2 AS BIGINT) AS r FROM fn) SELECT language, count(*) AS files, CAST(sum(e) AS BIGINT) AS "parseErrors", CAST(sum(s) AS BIGINT) AS sites, CAST(sum(r) AS BIGINT) AS resolved, round(1000.0 * sum(r) / sum(s)) / 10 AS percent FROM q GROUP BY ROLLUP (language)""")
_add("hash_identity", lambda g: g.label("Function").select("uid", identity.hash_uid(F.lit("Function"), F.col("name"), F.col("file")).alias("hash"), identity.merge_uid("Function", name="name", file="file").alias("merged")), "SELECT uid, left(sha256('Function::' || name || '::' || file), 16) AS hash, 'Function||file=' || file || '||name=' || name AS merged FROM fn")
_add("address_segments", lambda g: g.label("File").select("uid", identity.fnv1a32(F.col("uid")).alias("fnv"), F.concat(F.lit("fd00:0001:"), identity.segment(F.col("uid"))).alias("subnet")), """
, f AS (SELECT uid, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(uid, '')]), lambda h, c: xor(h, c) * 16777619 % 4294967296) AS fnv FROM fi) SELECT uid, fnv, 'fd00:0001:' || lpad(lower(to_hex(fnv % 65536)), 4, '0') AS subnet FROM f""")
_add("pattern_query", lambda g: cypher.run(g, "MATCH (a:Function)-[:CALLS]->(b:Function) WHERE a.visibility = 'public' AND NOT (b)-[:CALLS]->() RETURN a.file AS file, count(*) AS n, count(DISTINCT b.uid) AS targets ORDER BY n DESC, file LIMIT 10"), """
SELECT a.file, count(*) AS n, count(DISTINCT b.uid) AS targets FROM calls JOIN fn a ON src = a.uid JOIN fn b ON dst = b.uid WHERE a.visibility = 'public' AND b.uid NOT IN (SELECT src FROM calls) GROUP BY a.file ORDER BY n DESC, a.file LIMIT 10""")
_add("pattern_conditions", lambda g: cypher.run(g, "MATCH (f:Function) WHERE EXISTS { MATCH (f)-[:CALLS]->(c:Function) WHERE c.visibility = 'private' } AND ((f)-[:WRITES_STATE]->() OR f.visibility = 'public') RETURN f.visibility AS visibility, EXISTS { (f)-[:CALLS]->(f) } AS selfish, count(*) AS n"), """
SELECT visibility, uid IN (SELECT src FROM calls WHERE src = dst) AS selfish, count(*) AS n FROM fn WHERE uid IN (SELECT src FROM calls JOIN fn c ON dst = c.uid WHERE c.visibility = 'private') AND (uid IN (SELECT src FROM writes) OR visibility = 'public') GROUP BY 1, 2""")
_add("walks_by_file", lambda g: cypher.run(g, "MATCH p = (f:Function)-[:CALLS*1..2]->(c:Function) WHERE f.uid = $hub RETURN length(p) AS hops, c.file AS file, count(*) AS n", {"hub": _hub(g)}), """
, p AS (SELECT dst AS n, 1 AS hops FROM calls WHERE src = (SELECT src FROM hub) UNION ALL SELECT b.dst, 2 FROM calls a JOIN calls b ON a.dst = b.src WHERE a.src = (SELECT src FROM hub) AND NOT (a.src = b.src AND a.dst = b.dst))
SELECT CAST(hops AS BIGINT) AS hops, file, count(*) AS n FROM p JOIN fn ON n = uid GROUP BY 1, 2""")
_add("signature_pairs", lambda g: cypher.run(g, "MATCH (f1:Function), (f2:Function) WHERE f1.params = f2.params AND f1.params <> '()' AND f1.name < f2.name RETURN elementId(f1) AS uid, f1.name + ' / ' + f2.name AS pair, f1.file + f2.file AS files"), "SELECT a.uid, a.name || ' / ' || b.name AS pair, a.file || b.file AS files FROM fn a JOIN fn b ON a.params = b.params AND a.name < b.name WHERE a.params <> '()'")

_table("magic_numbers", lambda spark, d: A.magic_numbers(_literals(spark, d)), f"""
WITH l AS (SELECT source AS file, unnest(list_filter(regexp_extract_all(regexp_replace(text, '[^A-Za-z0-9_.]+', ' ', 'g'), '[A-Za-z0-9_.]+'), lambda x: regexp_full_match(x, '[0-9]+([.][0-9]+)?'))) AS v FROM documents),
m AS (SELECT v AS number, count(*) AS occurrences, count(DISTINCT file) AS "fileCount", v IN ({", ".join(repr(c) for c in A.CODES)}) AS code FROM l WHERE regexp_full_match(v, '-?([0-9]{{3,}}|[0-9]*[.][0-9]{{2,}})') AND v NOT IN ({", ".join(repr(c) for c in A.COMMON)}) GROUP BY v HAVING count(*) >= 2)
SELECT number, occurrences, "fileCount", CASE WHEN code THEN 'standard_code' WHEN contains(number, '.') THEN 'precise_decimal' WHEN length(number) >= 4 THEN 'large_integer' ELSE 'integer' END AS "numberKind", CASE WHEN code THEN 'low' WHEN "fileCount" >= 3 THEN 'high' WHEN "fileCount" >= 2 THEN 'medium' ELSE 'low' END AS "analysisConfidence"
FROM m ORDER BY code, "fileCount" DESC, occurrences DESC, number LIMIT 40""")
_table("execution_next", lambda spark, d: events.execution_next(_read(spark, d, "events")), 'SELECT src, dst, count(*) AS count, max(nt) AS "lastSeen" FROM (SELECT event_type AS src, lead(event_type) OVER w AS dst, lead(ts) OVER w AS nt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE dst IS NOT NULL GROUP BY 1, 2')


OWN = ", own AS (SELECT dst AS uid, min(src) AS alias FROM hasm GROUP BY dst), mem AS (SELECT alias, fn.uid, name FROM own JOIN fn ON own.uid = fn.uid)"
QUERIES["spec_sequence"] = lambda spark, d: _sequence(spark, d)
ORACLE_SQL["spec_sequence"] = f"""WITH {STAR_SQL}{OWN},
msg AS (SELECT k AS message, 'Class:' || s AS f, 'Class:' || t AS t, p_name AS m, dashed FROM (SELECT l_orderkey AS o, l_orderkey || ':' || l_linenumber AS k, l_suppkey AS s, l_returnflag = 'R' AS dashed, lead(l_suppkey) OVER w AS t, lead(l_partkey) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)) JOIN part ON p_partkey = n JOIN orders ON o = o_orderkey WHERE o_orderstatus = 'F'),
q AS (SELECT *, CASE WHEN dashed THEN 'return' WHEN f NOT IN (SELECT alias FROM mem) OR t NOT IN (SELECT alias FROM mem) THEN 'unbound_endpoint' END AS skip FROM msg),
bt AS (SELECT DISTINCT x.alias AS f, y.alias AS t, y.name AS m, src, dst FROM calls JOIN mem x ON src = x.uid JOIN mem y ON dst = y.uid),
hit AS (SELECT f, t, m, string_agg(DISTINCT dst, ',' ORDER BY dst) AS h FROM bt GROUP BY f, t, m), known AS (SELECT alias AS t, name AS m, string_agg(DISTINCT uid, ',' ORDER BY uid) AS c FROM mem GROUP BY 1, 2)
SELECT CASE WHEN skip IS NOT NULL THEN 'skipped' WHEN h IS NOT NULL THEN 'conforms' ELSE 'missing' END AS region, CASE WHEN skip IS NOT NULL THEN skip WHEN h IS NOT NULL THEN NULL WHEN c IS NULL THEN 'no_method' ELSE 'not_called' END AS reason, message, q.f AS from_alias, q.t AS to_alias, q.m AS method, NULL AS caller, CASE WHEN skip IS NULL THEN coalesce(h, c) END AS callees
FROM q LEFT JOIN hit ON q.f = hit.f AND q.t = hit.t AND q.m = hit.m LEFT JOIN known ON q.t = known.t AND q.m = known.m
UNION ALL SELECT 'extra', NULL, NULL, f, t, m, src, dst FROM bt WHERE f <> t AND NOT EXISTS (SELECT 1 FROM q WHERE skip IS NULL AND q.f = bt.f AND q.t = bt.t AND q.m = bt.m)
UNION ALL SELECT 'unbound', NULL, NULL, a, NULL, NULL, NULL, NULL FROM (SELECT f AS a FROM msg WHERE NOT dashed UNION SELECT t FROM msg WHERE NOT dashed) WHERE a NOT IN (SELECT alias FROM mem)"""
_add("spec_classes", lambda g: _classes(g), OWN + """
, dia AS (SELECT DISTINCT hasm.src AS c, name AS m FROM hasm JOIN fn ON dst = uid), bound AS (SELECT DISTINCT alias FROM mem), cod AS (SELECT DISTINCT alias AS c, name AS m FROM mem),
rel AS (SELECT DISTINCT hasm.src AS a, alias AS b FROM hasm JOIN own ON dst = uid WHERE hasm.src <> alias), inh AS (SELECT DISTINCT x.alias AS a, y.alias AS b FROM calls JOIN own x ON src = x.uid JOIN own y ON dst = y.uid)
SELECT 'method' AS kind, CASE WHEN cod.c IS NULL THEN 'missing' WHEN d.c IS NULL THEN 'extra' ELSE 'conforms' END AS region, coalesce(d.c, cod.c) AS class, coalesce(d.m, cod.m) AS member FROM (SELECT * FROM dia WHERE c IN (SELECT alias FROM bound)) d FULL JOIN cod ON d.c = cod.c AND d.m = cod.m
UNION ALL SELECT 'inherits', CASE WHEN EXISTS (SELECT 1 FROM inh WHERE inh.a = rel.a AND inh.b = rel.b) THEN 'conforms' ELSE 'missing' END, a, b FROM rel WHERE a IN (SELECT alias FROM bound) AND b IN (SELECT alias FROM bound)
UNION ALL SELECT 'class', 'unbound', c, NULL FROM (SELECT c FROM dia UNION SELECT a FROM rel) WHERE c NOT IN (SELECT alias FROM bound)""")
_table("spec_activities", lambda spark, d: _activities(spark, d), """
WITH b AS (SELECT DISTINCT user_id AS process FROM events WHERE event_type = 'error'), c AS (SELECT DISTINCT user_id AS process, upper(event_type) AS callee FROM events WHERE value >= 50 AND user_id IN (SELECT process FROM b))
SELECT user_id AS process, CASE WHEN callee IS NULL THEN 'missing' ELSE 'conforms' END AS region, event_id AS action, event_type AS method, callee FROM events LEFT JOIN c ON user_id = process AND upper(event_type) = callee WHERE user_id IN (SELECT process FROM b)
UNION ALL SELECT process, 'extra', NULL, NULL, callee FROM c WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = process AND upper(event_type) = callee)
UNION ALL SELECT DISTINCT user_id, 'unbound', NULL, NULL, NULL FROM events WHERE user_id NOT IN (SELECT process FROM b)""")
_add("workflow_findings", lambda g: workflow.findings(*_duties(g)), """
, proven AS (SELECT DISTINCT affects.dst AS uid FROM affects JOIN ta ON affects.src = ta.uid WHERE status = 'done')
SELECT uid, 'missing-test-intent' AS code FROM cl WHERE uid NOT IN (SELECT src FROM hasm) OR uid IN (SELECT src FROM hasm WHERE dst NOT IN (SELECT uid FROM proven))
UNION ALL SELECT uid, 'missing-task-obligation' FROM ta WHERE uid NOT IN (SELECT src FROM affects)""")


# ---- what the queries above are run on ----
_add("class_relations", lambda g: class_model.relations(_design(g), class_model.boxes(g), "HAS_METHOD", "CALLS", True, 2), """
, own AS (SELECT dst AS f, min(src) AS c FROM hasm GROUP BY dst),
inh AS (SELECT uid AS src, m AS dst FROM (SELECT uid, min(uid) OVER (PARTITION BY file) AS m FROM cl) WHERE uid <> m),
cre AS (SELECT DISTINCT c AS src, hasm.src AS dst FROM hasm JOIN own ON hasm.dst = f WHERE c <> hasm.src),
strong AS (SELECT * FROM inh UNION SELECT * FROM cre),
uses AS (SELECT a.c AS src, b.c AS dst, count(*) AS calls FROM calls JOIN own a ON calls.src = a.f JOIN own b ON calls.dst = b.f WHERE a.c <> b.c GROUP BY a.c, b.c HAVING count(*) >= 2)
SELECT src, dst, 'inherits' AS kind, CAST(NULL AS BIGINT) AS calls FROM inh UNION ALL SELECT src, dst, 'creates', NULL FROM cre
UNION ALL SELECT u.src, u.dst, 'uses', calls FROM uses u ANTI JOIN strong s ON u.src = s.src AND u.dst = s.dst""")
_add("class_members", lambda g: class_model.members(g, class_model.boxes(g), "HAS_METHOD", cap=10), """
, one AS (SELECT h.src AS cls, f.name, f.visibility <> 'private' AND NOT regexp_matches(f.name, '^[_#]') AS visible, f."startLine" AS line, row_number() OVER (PARTITION BY h.src, f.name ORDER BY f."startLine", f.uid) AS k, count(*) OVER (PARTITION BY h.src, f.name) AS total FROM hasm h JOIN fn f ON h.dst = f.uid)
SELECT cls, 'method' AS section, name, name || '()' AS text, line, visible AND row_number() OVER (PARTITION BY cls, visible ORDER BY line, name) <= 10 AS shown, CAST(0 AS BIGINT) AS abstract, total FROM one WHERE k = 1""")
_table("interface_overview", lambda spark, sf_dir: messaging.overview(messaging.interfaces(_sites(_read(spark, sf_dir, "events")))), """
SELECT kind, name, dynamic, count(DISTINCT CASE WHEN p THEN node END) AS providers, count(DISTINCT CASE WHEN NOT p THEN node END) AS users, count(DISTINCT type) AS types FROM (SELECT 'n' || user_id AS node, event_id % 5 = 0 AS p, event_id % 4 = 3 AS dynamic,
CASE event_id % 3 WHEN 1 THEN 'service' ELSE 'topic' END AS kind, CASE event_id % 3 WHEN 0 THEN 'std_msgs/msg/Note' WHEN 1 THEN 'std_srvs/srv/Empty' ELSE 'Note' END AS type,
CASE event_id % 4 WHEN 2 THEN '/n' || user_id || '/' || event_type WHEN 3 THEN 'self.' || event_type ELSE '/' || event_type END AS name FROM events) GROUP BY kind, name, dynamic""")


def _app(name: str, make: Callable[[Graph], DataFrame], sql: str, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(app_graph(spark, sf_dir))
    ORACLE_SQL[name] = f"WITH {'RECURSIVE' if recursive else ''} {STAR_SQL}{APP_SQL}{sql}"


def _joined(df: DataFrame, *names: str) -> DataFrame:
    """With array columns as text, in their order."""
    return df.withColumns({c: F.array_join(c, ",") for c in names})


_app("requirements_without_test_intent", A.requirements_without_test_intent, """SELECT 'Requirement:' || c_custkey AS uid, c_name AS requirement, c_mktsegment AS "changeId" FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '1%')""")
_app("test_cases_without_implementation", A.test_cases_without_implementation, """SELECT uid, title AS "testCase", change AS "changeId" FROM test WHERE uid NOT IN (SELECT src FROM impl)""")
_app("source_validation_trace", lambda g: A.source_validation_trace(Graph(g.spark, {x: g._nodes[x] for x in ("TestCase", "Class", "Function")}, g._edges)), """
SELECT cl.uid, cl.name AS source, cl.file, test.title AS "testCase", t.dst AS "testId", t.file AS "testFile" FROM vali JOIN test ON vali.src = test.uid JOIN cl ON vali.dst = cl.uid LEFT JOIN (SELECT src, dst, file FROM impl JOIN fn ON dst = uid) t ON t.src = test.uid""")
_app("call_graph_coverage", A.call_graph_coverage, """
SELECT p_brand AS file, count(*) AS "allSites", count(*) FILTER (l_returnflag = 'R') AS "externalSites", count(*) FILTER (l_returnflag <> 'R') AS "internalSites", count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS resolved, round(100.0 * count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') / count(*) FILTER (l_returnflag <> 'R'), 1) AS percent
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand HAVING count(*) FILTER (l_returnflag <> 'R') > 0 ORDER BY percent, file LIMIT 40""")
_app("api_endpoints", A.api_endpoints, """SELECT uid, '/' || p_type AS url, CASE WHEN length(p_type) % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, name AS handler, file FROM fn JOIN part ON uid = 'Function:' || p_partkey WHERE visibility = 'public'""")
_app("functions_fetching_api", A.functions_fetching_api, """SELECT name AS function, file, '/' || p_type AS url, CASE WHEN length(p_type) % 2 = 0 THEN 'GET' ELSE 'POST' END AS method FROM fn JOIN part ON uid = 'Function:' || p_partkey WHERE visibility = 'private'""")
_app("external_dependencies", A.external_dependencies, """SELECT p_type AS module, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS "usedIn" FROM part GROUP BY p_type""")
_app("functions_with_errors", lambda g: A.functions_with_errors(g, ["User"]), """
SELECT 'User:' || user_id AS uid, CAST(user_id AS VARCHAR) AS function, CAST(NULL AS VARCHAR) AS file, props AS error, ts AS timestamp FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'error') WHERE r = 1""")
_app("dom_elements", A.dom_elements, """SELECT 'DOMElement:' || page_id || ':' || n AS id, t AS tag, CAST(NULL AS VARCHAR) AS "testId", url AS file, n AS line FROM tags""")
_app("dom_to_handler_chain", lambda g: A.dom_to_handler_chain(_handlers(g)), """
, h AS (SELECT CAST(page_id AS VARCHAR) AS t, uid AS o, name AS handler, greatest(1, coalesce(d, 0)) AS w FROM pages JOIN fn ON uid = 'Function:' || page_id LEFT JOIN (SELECT src, count(*) AS d FROM step GROUP BY src) ON uid = src),
c AS (SELECT *, coalesce(sum(w) OVER (ORDER BY t, handler, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM h), k AS (SELECT * FROM c WHERE s < 30),
p AS (SELECT o, [o, dst] AS path, 1 AS hops FROM k JOIN step ON o = src UNION ALL SELECT o, list_append(path, step.dst), hops + 1 FROM p JOIN step ON path[-1] = step.src WHERE hops < 4 AND NOT list_contains(path, step.dst))
SELECT t AS "testId", 'html' AS tag, 'click' AS event, handler, array_to_string(path, ',') AS "callChain" FROM k LEFT JOIN p ON k.o = p.o ORDER BY 1, 4, 5 NULLS FIRST LIMIT 30""", True)
QUERIES["runtime_dom_tree"] = lambda spark, d: A.runtime_dom_tree(app_graph(spark, d))
ORACLE_SQL["runtime_dom_tree"] = f"""WITH RECURSIVE {DOM_SQL}
SELECT a.tag AS "parentTag", CAST(NULL AS VARCHAR) AS "parentTestId", b.tag AS "childTag", CAST(NULL AS VARCHAR) AS "childTestId", xpath FROM dom a JOIN dom b ON a.page_id = b.page_id AND b.parent = a.n JOIN paths p ON p.page_id = b.page_id AND p.n = b.n ORDER BY xpath LIMIT 50"""
_table("dom_tree", lambda spark, d: dom.tree(_read(spark, d, "pages")), f"""WITH RECURSIVE {DOM_SQL}
SELECT d.page_id, url, d.n, tag AS "tagName", depth, parent, xpath FROM dom d JOIN paths p ON d.page_id = p.page_id AND d.n = p.n""")
_app("most_clicked_components", A.most_clicked_components, """SELECT fn.name AS component, n AS clicks, uid FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) JOIN fn ON uid = 'Function:' || user_id ORDER BY n DESC, uid LIMIT 20""")
_app("execution_path_frequency", A.execution_path_frequency, """SELECT lower(hex(event_type)) AS "pathHex", count(*) AS freq FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
_app("execution_path_for_event", lambda g: A.execution_path_for_event(g, g.rel("EXECUTION_STEP").agg(F.max("src")).first()[0] or ""), """SELECT n AS "stepOrder", fn.name AS function, file, uid FROM steps JOIN fn ON f = uid WHERE 'UserEvent:' || e = (SELECT max('UserEvent:' || e) FROM steps)""")
_app("click_to_state_changes", lambda g: A.click_to_state_changes(g, "click"), """
SELECT ts AS "occurredAt", fn.name AS writer, st.name AS state FROM events JOIN steps ON e = event_id JOIN fn ON f = fn.uid JOIN writes ON src = f JOIN st ON dst = st.uid WHERE event_type = 'click' ORDER BY ts DESC, writer, state LIMIT 20""")
_app("click_full_trace", lambda g: _joined(A.click_full_trace(g, "click"), "calledFunctions", "stateChanges"), """
, k AS (SELECT event_id, ts, f, name FROM ev WHERE event_type = 'click' ORDER BY ts DESC, name, 'UserEvent:' || event_id LIMIT 10),
w AS (SELECT DISTINCT f AS o, f AS n, 0 AS h FROM k UNION SELECT o, step.dst, h + 1 FROM w JOIN step ON n = src WHERE h < 5), r AS (SELECT DISTINCT o, n FROM w WHERE n <> o),
a AS (SELECT o, string_agg(DISTINCT name, ',' ORDER BY name) AS c FROM r JOIN fn ON n = uid GROUP BY o), b AS (SELECT o, string_agg(DISTINCT st.name, ',' ORDER BY st.name) AS s FROM r JOIN writes ON n = src JOIN st ON dst = st.uid GROUP BY o)
SELECT ts AS "occurredAt", name AS component, c AS "calledFunctions", CASE WHEN c IS NOT NULL THEN coalesce(s, '') END AS "stateChanges" FROM k LEFT JOIN a ON f = a.o LEFT JOIN b ON f = b.o""", True)
_app("component_accepts_props", lambda g: _joined(A.component_accepts_props(g), "acceptedProps"), """SELECT name AS component, file, replace(name, ' ', ',') AS "acceptedProps" FROM fn""")
PROPS = """
SELECT a.uid, a.name AS parent, b.name AS child, array_to_string(list_sort(list_distinct(list_filter(string_split(b.name, ' '), lambda x: NOT list_contains(string_split(a.name, ' '), x)))), ',') AS "missingProps", replace(a.name, ' ', ',') AS "passedProps"{more}
FROM calls JOIN fn a ON src = a.uid JOIN fn b ON dst = b.uid WHERE len(list_filter(string_split(b.name, ' '), lambda x: NOT list_contains(string_split(a.name, ' '), x))) > 0{where}"""
_app("missing_props", lambda g: _joined(A.missing_props(g).withColumn("missingProps", F.array_sort("missingProps")), "missingProps", "passedProps"), PROPS.format(more="", where=" AND a.visibility <> 'private'"))
_app("missing_props_including_spread", lambda g: _joined(A.missing_props(g, True).withColumn("missingProps", F.array_sort("missingProps")), "missingProps", "passedProps"), PROPS.format(more=", a.visibility = 'private' AS \"hasSpread\"", where=""))
_app("effect_watches", A.effect_watches, """SELECT fn.name AS component, file, 'useEffect' AS hook, CAST(k AS BIGINT) AS line, st.name AS "watchedState", deps AS "allDeps" FROM eff JOIN fn ON f = fn.uid JOIN st ON state = st.uid WHERE watches""")
_app("all_effects", A.all_effects, """SELECT name AS component, file, 'useEffect' AS hook, CAST(k AS BIGINT) AS line, deps FROM eff JOIN fn ON f = uid""")
_app("untracked_state_deps", A.untracked_state_deps, """SELECT fn.name AS component, st.name AS state, file FROM writes JOIN fn ON src = fn.uid JOIN st ON dst = st.uid WHERE dst NOT IN (SELECT state FROM eff WHERE watches)""")
_table("magic_number_sites", lambda spark, d: A.magic_number_sites(_literals(spark, d)), f"""
WITH l AS (SELECT doc_id, source AS file, list_filter(regexp_extract_all(regexp_replace(text, '[^A-Za-z0-9_.]+', ' ', 'g'), '[A-Za-z0-9_.]+'), lambda x: regexp_full_match(x, '[0-9]+([.][0-9]+)?')) AS l FROM documents), s AS (SELECT doc_id, file, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS n FROM l)
SELECT 'ASTNode:' || doc_id || ':' || n AS uid, v AS number, file, n AS line, '(module level)' AS function FROM s WHERE regexp_full_match(v, '-?([0-9]{{3,}}|[0-9]*[.][0-9]{{2,}})') AND v NOT IN ({", ".join(repr(c) for c in A.COMMON)}) ORDER BY file, line, uid LIMIT 200""")

# ---- addresses ----


def _segment(x: str) -> str:
    return f"lpad(lower(to_hex(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split({x}, '')]), lambda h, c: xor(h, c) * 16777619 % 4294967296) % 65536)), 4, '0')"


ADDRESS_SQL = f"""
, spans AS (SELECT file, "startLine" AS s, "endLine" AS e, min(uid) AS first FROM fn GROUP BY ALL),
tops AS (SELECT * FROM spans x WHERE NOT EXISTS (SELECT 1 FROM spans y WHERE y.file = x.file AND y.s <= x.s AND y.e >= x.e AND y.e - y.s > x.e - x.s)),
held AS (SELECT f.uid, f.name, f.file, f."startLine" AS line, (SELECT arg_max(t.first, t.s) FROM tops t WHERE t.file = f.file AND t.s <= f."startLine" AND t.e >= f."endLine" AND t.e - t.s > f."endLine" - f."startLine") AS owner FROM fn f),
adr AS (SELECT uid, 'File' AS label, name, path AS file, CAST(NULL AS BIGINT) AS line, 'fd00:0001:' || {_segment("uid")} || ':0000:0000:0000:0000:0000' AS ipv6, 48 AS mask FROM fi
UNION ALL SELECT uid, 'Function', name, file, line, 'fd00:0001:' || {_segment("'File:' || file")} || ':' || CASE WHEN owner IS NULL THEN {_segment("uid")} || ':0000' ELSE {_segment("coalesce(owner, uid)")} || ':' || {_segment("uid")} END || ':0000:0000:0000', CASE WHEN owner IS NULL THEN 64 ELSE 80 END FROM held)
"""


def _addressed(g: Graph) -> DataFrame:
    """Files and functions with their addresses."""
    f = g.label("Function")
    nodes = g.label("File").select("uid", F.lit("File").alias("label"), "name", F.col("path").alias("file"), F.lit(None).cast("long").alias("line")).unionByName(f.select("uid", F.lit("Function").alias("label"), "name", "file", F.col("startLine").alias("line")))
    return nodes.join(addresses.addresses(g.label("File"), f), "uid", "left")


def _fullest(nodes: DataFrame) -> str:
    """The subnet of a declaration that holds most."""
    best = nodes.where("mask > 48").groupBy(F.substring("ipv6", 1, 19).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p").first()
    return best["p"] if best else ""


for _name, _make, _sql in (
    ("ipv6_overview", lambda g: addresses.overview(_addressed(g)), "SELECT label AS type, mask, count(*) AS count FROM adr GROUP BY label, mask"),
    ("ipv6_file_subnets", lambda g: addresses.file_subnets(_addressed(g), g.rel("CONTAINS")), "SELECT file, ipv6 AS subnet, n AS nodes FROM adr JOIN (SELECT src, count(*) AS n FROM contains GROUP BY src) ON uid = src WHERE label = 'File'"),
    ("ipv6_hierarchy", lambda g: addresses.hierarchy(_addressed(g), g.rel("CONTAINS"), "#1"), "SELECT a.file, a.ipv6 AS \"fileAddr\", b.name AS node, b.label AS type, b.ipv6 AS \"nodeAddr\", b.mask, b.line FROM adr a JOIN contains ON a.uid = src JOIN adr b ON dst = b.uid WHERE a.label = 'File' AND contains(a.file, '#1')"),
    ("ipv6_lookup", lambda g: (lambda n: addresses.lookup(n, n.where("label = 'Function'").agg(F.min("ipv6")).first()[0] or ""))(_addressed(g)), "SELECT name, label AS type, file, uid, ipv6, mask FROM adr WHERE ipv6 = (SELECT min(ipv6) FROM adr WHERE label = 'Function')"),
    ("ipv6_subnet_members", lambda g: (lambda n: addresses.subnet_members(n, _fullest(n)))(_addressed(g)), "SELECT name, label AS type, uid, ipv6, mask, line FROM adr WHERE left(ipv6, 19) = (SELECT left(ipv6, 19) FROM adr WHERE mask > 48 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"),
    ("ipv6_node_by_name", lambda g: addresses.by_name(_addressed(g), _first_name(g)), "SELECT name, label AS type, file, uid, ipv6, mask FROM adr WHERE name = (SELECT min(name) FROM fn)"),
    ("enclosing_declaration", lambda g: addresses.containment(g.label("Function")).select("uid", "owner"), "SELECT uid, owner FROM held"),
):
    _add(_name, _make, ADDRESS_SQL + _sql)

# ---- changes and views ----

_table("merge_event_counters", lambda spark, d: mutate.merge_counters(_counted(_read(spark, d, "events").where("event_type <> 'click'")), _counted(_read(spark, d, "events").where("event_type = 'click'"))), """SELECT 'User:' || user_id AS src, 'Type:' || left(event_type, 1) AS dst, count(*) AS count, max(ts) AS "lastSeen" FROM events GROUP BY 1, 2""")
_add("merge_nodes", lambda g: mutate.merge_nodes(g.label("State").withColumn("status", F.lit("old")), g.label("Class").select(F.concat(F.lit("State:"), F.substring_index("uid", ":", -1)).alias("uid"), F.col("name").alias("owner")), {"status": F.lit("new")}), """
SELECT coalesce(st.uid, c.uid) AS uid, st.name, CASE WHEN st.uid IS NULL THEN 'new' ELSE 'old' END AS status, c.name AS owner FROM st FULL JOIN (SELECT 'State:' || split_part(uid, ':', 2) AS uid, name FROM cl) c ON st.uid = c.uid""")
_add("set_properties", lambda g: mutate.set_properties(g.label("Task"), (F.col("status") == "todo") & (F.col("priority") == "critical"), {"status": F.lit("in_progress"), "priority": F.lit(None).cast("string")}), """
SELECT uid, CASE WHEN status = 'todo' AND priority = 'critical' THEN 'in_progress' ELSE status END AS status, CASE WHEN status = 'todo' AND priority = 'critical' THEN NULL ELSE priority END AS priority FROM ta""")
_add("detach_delete", lambda g: _left_over(g), """
SELECT 'nodes' AS kind, count(*) AS n FROM (SELECT uid FROM ta WHERE status <> 'done' UNION ALL SELECT uid FROM fn) UNION ALL SELECT 'edges', count(*) FROM affects WHERE src NOT IN (SELECT uid FROM ta WHERE status = 'done')""")
_add("orphan_nodes", lambda g: mutate.orphans(g.label("Function"), g.rel("AFFECTS").join(g.label("Task").where("status = 'in_progress'").select(F.col("uid").alias("src")), "src", "left_semi")).select("uid", "name"), "SELECT uid, name FROM fn WHERE uid NOT IN (SELECT dst FROM affects JOIN ta ON src = uid WHERE status = 'in_progress')")
_add("expand_node", lambda g: views.expand(g, _hub(g)), "SELECT d AS direction, uid, name, file FROM (SELECT 'child' AS d, dst AS u FROM calls WHERE src = (SELECT src FROM hub) UNION SELECT 'parent', src FROM calls WHERE dst = (SELECT src FROM hub)) JOIN fn ON u = uid")
_add("call_tree", lambda g: views.call_tree(g, _hub(g)), """
, w AS (SELECT src AS n, 0 AS k FROM hub UNION SELECT step.dst, k + 1 FROM w JOIN step ON n = src WHERE k < 6), d AS (SELECT n, min(k) AS k FROM w GROUP BY n) SELECT n AS node, CAST(k AS BIGINT) AS dist, dst AS child FROM d LEFT JOIN (SELECT * FROM step WHERE dst IN (SELECT n FROM d)) ON n = src""", True)
_add("relation_summary", lambda g: views.relation_summary(g, "Function:7", TYPES), f"SELECT rel_type, count(*) FILTER (dst = 'Function:7') AS incoming, count(*) FILTER (src = 'Function:7') AS outgoing FROM ({ALL_EDGES}) WHERE src = 'Function:7' OR dst = 'Function:7' GROUP BY rel_type")
_add("graph_stats", lambda g: views.graph_stats(g, CODE, TYPES), f"SELECT (SELECT count(*) FROM ({ALL_NODES})) AS nodes, (SELECT count(*) FROM fi) AS files, (SELECT count(*) FROM ({ALL_EDGES})) AS edges")
_add("call_context", lambda g: views.call_context(g, _selfish(g)), """
, s AS (SELECT DISTINCT src AS u FROM calls WHERE src = dst) SELECT u AS uid, coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM calls JOIN fn ON src = uid WHERE dst = u), '') AS callers, coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM calls JOIN fn ON dst = uid WHERE src = u), '') AS callees FROM s""")
_add("task_context", lambda g: views.task_context(g.label("Task"), g.rel("AFFECTS"), g.label("Function")).withColumn("nodes", F.array_join(F.transform("nodes", lambda x: F.concat_ws("=", x["uid"], x["name"])), ",")), "SELECT ta.uid, status, coalesce(string_agg(fn.uid || '=' || fn.name, ',' ORDER BY fn.uid), '') AS nodes FROM ta LEFT JOIN affects ON src = ta.uid LEFT JOIN fn ON dst = fn.uid GROUP BY ta.uid, status")
_add("wave_status", lambda g: views.wave_status(traverse.waves(g.label("Task").select("uid"), g.rel("DEPENDS_ON")), g.label("Task")), """
, w AS (SELECT uid, 1 AS k FROM ta WHERE uid NOT IN (SELECT src FROM depends) UNION ALL SELECT depends.src, k + 1 FROM w JOIN depends ON depends.dst = w.uid)
SELECT CAST(k AS BIGINT) AS wave, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'review') AS in_review, count(*) FILTER (status NOT IN ('done', 'review')) AS open, bool_and(status IN ('done', 'review')) AS passed FROM w JOIN ta ON w.uid = ta.uid GROUP BY k""", True)
_add("epic_sequence", lambda g: views.epic_sequence(g.label("Task"), "priority"), "SELECT priority AS epic, uid, row_number() OVER (PARTITION BY priority ORDER BY uid) AS place FROM ta")
LEASES_SQL = "WITH l AS (SELECT p_brand AS file, 'Function:' || l_partkey AS node, CAST(o_custkey AS VARCHAR) AS owner, CAST(epoch(max(o_orderdate)) AS BIGINT) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3), now AS (SELECT CAST(epoch(min(o_orderdate)) + epoch(max(o_orderdate)) AS BIGINT) // 2 AS t FROM orders) "


def _held(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Leases with the address of their node, as locks of a file, a declaration or a member by the owner's number."""
    held, now = _leases(spark, d)
    where = _addressed(star_graph(spark, d)).select(F.col("uid").alias("node"), "name", "ipv6")
    mask = F.element_at(F.array(F.lit(48), F.lit(64), F.lit(80)), (F.pmod(F.col("owner").cast("long"), F.lit(3)) + 1).cast("int"))
    return written(held.join(where, "node").select("node", "name", "ipv6", mask.alias("mask"), "owner", F.col("node").alias("lockGroup"), F.col("lockExpires").alias("expires"))), now


_HELD_SQL = f"""WITH {STAR_SQL} {ADDRESS_SQL}, {LEASES_SQL.split("WITH ", 1)[1].rstrip()}
, held_ AS (SELECT l.node, adr.name, adr.ipv6, CASE CAST(owner AS BIGINT) % 3 WHEN 0 THEN 48 WHEN 1 THEN 64 ELSE 80 END AS mask, owner, l.node AS grp, x FROM l JOIN adr ON l.node = adr.uid)
"""
QUERIES["lock_cover"] = lambda spark, d: (lambda held, now: locks.covering(_addressed(star_graph(spark, d)), held, now))(*_held(spark, d))
ORACLE_SQL["lock_cover"] = _HELD_SQL + """, m AS (SELECT adr.uid, h.mask, h.owner, h.grp, h.x FROM adr JOIN (SELECT held_.* FROM held_, now WHERE x > t) h ON left(adr.ipv6, h.mask // 16 * 5 - 1) = left(h.ipv6, h.mask // 16 * 5 - 1))
SELECT uid, mask, owner, grp AS "lockGroup" FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY mask DESC, x DESC, owner, grp) AS r FROM m) WHERE r = 1"""


def _crossing(spark: SparkSession, d: str) -> DataFrame:
    """Owners of the locks that have ended ask for their nodes' subnets again; the other locks are on the nodes alone."""
    held, now = _held(spark, d)
    asked = held.where(F.col("expires") <= now).select(F.concat_ws("/", "owner", "node").alias("request"), F.col("owner").alias("agent"), "ipv6", "mask")
    nodes = held.select(F.col("node").alias("uid"), "name", "ipv6", F.col("owner").alias("lockedBy"), "lockGroup", "expires")
    return locks.crossing(asked, nodes, now)


QUERIES["lock_crossing"] = _crossing
ORACLE_SQL["lock_crossing"] = _HELD_SQL + """, a AS (SELECT owner || '/' || node AS request, owner AS agent, ipv6, mask FROM held_, now WHERE x <= t), v AS (SELECT held_.* FROM held_, now WHERE x > t),
nets AS (SELECT 48 AS m, left(ipv6, 14) AS net, owner, count(*) AS n, min(struct_pack(name := name, node := node, owner := owner, grp := grp)) AS f FROM v GROUP BY ALL UNION ALL SELECT 64, left(ipv6, 19), owner, count(*), min(struct_pack(name := name, node := node, owner := owner, grp := grp)) FROM v GROUP BY ALL UNION ALL SELECT 80, left(ipv6, 24), owner, count(*), min(struct_pack(name := name, node := node, owner := owner, grp := grp)) FROM v GROUP BY ALL)
SELECT request, agent, CAST(sum(n) AS BIGINT) AS conflicts, min(f).name AS node, min(f).owner AS "lockedBy", min(f).grp AS "lockGroup" FROM a JOIN nets ON mask = m AND net = left(ipv6, mask // 16 * 5 - 1) AND owner <> agent GROUP BY 1, 2"""


def _transitions(spark: SparkSession, d: str) -> DataFrame:
    """Every finished order's task ends and every open one begins, by the order's date, on the functions it affects that no
    other task has (of several, the first by number)."""
    g = star_graph(spark, d)
    o = _read(spark, d, "orders").select(F.concat(F.lit("Task:"), "o_orderkey").alias("task"), F.col("o_custkey").cast("string").alias("agent"), "o_orderstatus", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"))
    status = {"F": ("in_progress", "done"), "O": ("todo", "in_progress"), "P": ("todo", "review")}
    old, new = (F.coalesce(*(F.when(F.col("o_orderstatus") == s, x[k]) for s, x in status.items())) for k in (0, 1))
    requests = o.select("task", "agent", old.alias("old"), new.alias("new"), "at")
    last = g.rel("AFFECTS").groupBy(F.col("dst").alias("uid")).agg(F.max("src").alias("task"), F.min("src").alias("other"))
    files = _addressed(g).select("uid", "name", F.col("file"))
    nodes = last.join(files, "uid").join(o.select("task", "agent", "o_orderstatus"), "task")
    held = F.col("o_orderstatus") == "F"
    state = nodes.select("uid", "name", F.col("file").alias("ipv6"), F.col("task").alias("lockGroup"), F.when(~held, "planned").alias("lockStatus"), F.when(held, F.col("agent")).alias("lockedBy"))
    results, _ = locks.transitions(requests, state)
    return results


QUERIES["lock_transitions"] = _transitions
_add("waves_barred", lambda g: locks.barred(g.label("Task").select("uid", "status", F.col("priority").alias("wave")), g.label("Task").select(F.col("priority").alias("wave"), F.when(F.col("priority") < "i", "active").otherwise("waiting").alias("status")).distinct()), "SELECT uid, priority AS wave FROM ta WHERE status IN ('backlog', 'todo', 'open') AND NOT priority < 'i'")
_table("lock_summary", lambda spark, d: (lambda held, now: views.lock_summary(held, now))(*_leases(spark, d)), LEASES_SQL + "SELECT owner, count(*) FILTER (x > t) AS live, count(*) FILTER (x <= t) AS expired FROM l, now GROUP BY owner")
_table("expired_locks", lambda spark, d: (lambda held, now: scheduling.expired(held, now))(*_leases(spark, d)), LEASES_SQL + "SELECT file, node, owner, x AS \"lockExpires\" FROM l, now WHERE x <= t")
_table("lock_conflicts", lambda spark, d: (lambda held, now: scheduling.conflicts(held, spark.createDataFrame([("Brand#11", None), ("", "Function:7")], "file string, node string"), "1", now))(*_leases(spark, d)), LEASES_SQL + "SELECT file, node, owner, x AS \"lockExpires\" FROM l, now WHERE x > t AND owner <> '1' AND (file = 'Brand#11' OR node = 'Function:7')")
_add("shared_file_groups", lambda g: scheduling.shared_file_groups(g.rel("AFFECTS").join(g.label("Task").where("status = 'in_progress'").select(F.col("uid").alias("src")), "src", "left_semi"), g.label("Function")))


def _counted(events_: DataFrame) -> DataFrame:
    return events_.groupBy(F.concat(F.lit("User:"), "user_id").alias("src"), F.concat(F.lit("Type:"), F.substring("event_type", 1, 1)).alias("dst")).agg(F.count(F.lit(1)).alias("count"), F.max("ts").alias("lastSeen"))


def _impact_quality(g: Graph) -> DataFrame:
    p = impact.profile_of("balanced", ["CALLS"])
    return impact.quality(g, p, *impact.explore(g, _selfish(g), p))


def _left_over(g: Graph) -> DataFrame:
    """What stays when finished tasks go, with their edges."""
    nodes = g.label("Task").select("uid").unionByName(g.label("Function").select("uid"))
    kept, edges = mutate.detach_delete(nodes, g.rel("AFFECTS").select("src", "dst"), g.label("Task").where("status = 'done'"))
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("kind"), "n").unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), "n"))


def _leases(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Customers hold what they order until their last order; now is half way through all orders."""
    o = _read(spark, d, "orders")
    line = _read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), "l_orderkey").join(_read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    held = line.groupBy(F.col("p_brand").alias("file"), F.concat(F.lit("Function:"), "l_partkey").alias("node"), F.col("o_custkey").cast("string").alias("owner")).agg(F.unix_seconds(F.max("o_orderdate").cast("timestamp")).alias("lockExpires"))
    ends = o.agg(F.unix_seconds(F.min("o_orderdate").cast("timestamp")).alias("a"), F.unix_seconds(F.max("o_orderdate").cast("timestamp")).alias("b")).first()
    return held, ((ends["a"] or 0) + (ends["b"] or 0)) // 2


def _handlers(g: Graph) -> Graph:
    """Each page as one element whose clicks go to the function of its number."""
    d = g.label("DOMElement").where("startLine = 0").select(F.concat(F.lit("Page:"), F.split("uid", ":")[1]).alias("uid"), F.lit("html").alias("tagName"), F.split("uid", ":")[1].alias("testId"))
    on = d.select(F.col("uid").alias("src"), F.concat(F.lit("Function:"), "testId").alias("dst"), F.lit("click").alias("event"))
    return Graph(g.spark, {**g._nodes, "DOMElement": lambda: d}, {**g._edges, "ON_EVENT": lambda: on})


def _selfish(g: Graph) -> DataFrame:
    """(uid): functions that call themselves."""
    return g.rel("CALLS").where("src = dst").select(F.col("src").alias("uid"))


def _design(g: Graph) -> Graph:
    """With classes that inherit from the first of their nation, and functions that make each class that has them."""
    c = g.label("Class")
    first = c.groupBy("file").agg(F.min("uid").alias("dst"))
    inherits = lambda: c.select(F.col("uid").alias("src"), "file").join(first, "file").select("src", "dst")
    return _with(_with(g, "INHERITS", inherits), "INSTANTIATES", lambda: g.rel("HAS_METHOD").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _sites(e: DataFrame) -> DataFrame:
    """Events as call sites of interfaces, their names written in four ways and their types in three."""
    kind = F.pmod("event_id", F.lit(4))
    name = F.when(kind == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(kind == 1, F.concat(F.lit("'/"), "event_type", F.lit("'"))).when(kind == 2, F.concat(F.lit('"~/'), "event_type", F.lit('"'))).otherwise(F.concat(F.lit("self."), "event_type"))
    form = F.pmod("event_id", F.lit(3))
    type_ = F.when(form == 0, "const std_msgs::msg::Note &").when(form == 1, "std_srvs.srv.Empty").otherwise("Note")
    side = F.when(F.pmod("event_id", F.lit(5)) == 0, "provides").otherwise("uses")
    return e.select(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("node"), name.alias("raw_name"), (kind != 3).alias("literal"), type_.alias("raw_type"), F.lit("topic").alias("kind"), side.alias("side"))


def _owners(g: Graph) -> DataFrame:
    """(alias, uid, name): each function with the first class that has it."""
    own = g.rel("HAS_METHOD").groupBy(F.col("dst").alias("uid")).agg(F.min("src").alias("alias"))
    return own.join(g.label("Function").select("uid", "name"), "uid").select("alias", "uid", "name")


def _sequence(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders as diagrams: from each line's supplier to the next one's, by the part's name; returned lines are replies."""
    g = star_graph(spark, d)
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    done = _read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    line = _read(spark, d, "lineitem").join(done, "l_orderkey", "left_semi")
    line = line.select(F.struct("l_orderkey", "l_linenumber").alias("message"), F.col("l_suppkey").alias("from_alias"), F.lead("l_suppkey").over(along).alias("to_alias"), F.lead("l_partkey").over(along).alias("p_partkey"), (F.col("l_returnflag") == "R").alias("dashed"))
    messages = line.join(_read(spark, d, "part").select("p_partkey", F.col("p_name").alias("method")), "p_partkey")

    def number(uid: str) -> Column:
        return F.substring_index(uid, ":", -1).cast("long")

    def text(label: str, key: Column) -> Column:
        return F.concat(F.lit(f"{label}:"), key.cast("string"))

    # keys are joined and written as numbers
    members = written(_owners(g).select(number("alias").alias("alias"), number("uid").alias("uid"), "name"))
    calls = g.rel("CALLS").select(number("src").alias("src"), number("dst").alias("dst"))
    found = conformance.sequence(messages, members, members, calls, lambda uid: text("Function", uid))
    message = F.when(F.col("message").isNotNull(), F.concat_ws(":", "message.l_orderkey", "message.l_linenumber"))
    ends = [text("Class", F.col(c)).alias(c) for c in ("from_alias", "to_alias")]
    return found.select("region", "reason", message.alias("message"), *ends, "method", text("Function", F.col("caller")).alias("caller"), "callees")


def _classes(g: Graph) -> DataFrame:
    members = _owners(g)
    has = g.rel("HAS_METHOD")
    drawn = has.join(g.label("Function").select(F.col("uid").alias("dst"), F.col("name").alias("method")), "dst").select(F.col("src").alias("class"), "method")
    bound = members.select(F.col("alias").alias("class"), F.col("alias").alias("uid"))
    relations = has.join(members.select(F.col("uid").alias("dst"), "alias"), "dst").where("src <> alias").select("src", F.col("alias").alias("dst"), F.lit("inherits").alias("type"))
    owner = [members.select(F.col("uid").alias(end), F.col("alias").alias(f"{end}_class")) for end in ("src", "dst")]
    inherits = g.rel("CALLS").join(owner[0], "src").join(owner[1], "dst").select(F.col("src_class").alias("src"), F.col("dst_class").alias("dst"))
    return conformance.classes(drawn, bound, members.select(F.col("alias").alias("class"), F.col("name").alias("method")), relations, inherits)


def _activities(spark: SparkSession, d: str) -> DataFrame:
    """Users as processes, bound if an error is known of them; what they do must be among their larger events."""
    e = _read(spark, d, "events")
    actions = e.select(F.col("user_id").alias("process"), F.col("event_id").alias("action"), F.col("event_type").alias("method"))
    bound = e.where("event_type = 'error'").select(F.col("user_id").alias("process"))
    return conformance.activity(actions, bound, e.where("value >= 50").select(F.col("user_id").alias("process"), F.upper("event_type").alias("name")))


def _duties(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Classes as requirements, their functions as criteria, validated by finished tasks; tasks implement what they affect."""
    nodes = g.label("Class").select("uid", F.lit("Requirement").alias("label")).unionByName(g.label("Task").select("uid", F.lit("Task").alias("label")))
    work = g.rel("AFFECTS").select("src", "dst")
    proof = work.join(g.label("Task").where("status = 'done'").select(F.col("uid").alias("src")), "src", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    links = g.rel("HAS_METHOD").select(F.lit("HAS_CRITERION").alias("rel_type"), "src", "dst").unionByName(proof.select(F.lit("VALIDATED_BY").alias("rel_type"), "src", "dst"))
    return nodes, links.unionByName(work.select(F.lit("IMPLEMENTS").alias("rel_type"), "src", "dst"))


def _first_name(g: Graph) -> str:
    return g.label("Function").agg(F.min("name")).first()[0]


def _with(g: Graph, name: str, make: Callable[[], DataFrame]) -> Graph:
    return Graph(g.spark, g._nodes, {**g._edges, name: make})


def _resolved(g: Graph) -> Graph:
    f = g.label("Function").select("uid", "file")
    calls = g.rel("CALLS").join(f.select(F.col("uid").alias("src"), F.col("file").alias("a")), "src").join(f.select(F.col("uid").alias("dst"), F.col("file").alias("b")), "dst")
    return _with(g, "CALLS", lambda: calls.select("src", "dst", F.when(F.col("a") == F.col("b"), "same-file").otherwise("imported-symbol").alias("resolvedBy")))


def _hub(g: Graph) -> str:
    """The function with the most callees."""
    return g.rel("CALLS").where("src <> dst").groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(1).first()[0]


def _routes(g: Graph) -> DataFrame:
    hub = _hub(g)
    target = traverse.paths(g, g.spark.createDataFrame([(hub,)], "uid string"), ["CALLS"], 2).where("hops = 2").agg(F.max("node")).first()[0]
    return traverse.routes(g, hub, target or "", ["CALLS"], 8, 5).select("hops", F.array_join("path", ",").alias("path"))


def _snapshots(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Before: the functions that finished tasks affect, none longer than 41 lines; after: all as they are."""
    f = g.label("Function").select("uid", F.lit("Function").alias("label"), "name", "file", "startLine", "endLine", F.col("params").alias("signature"), F.lit(None).cast("string").alias("bodySnippet"))
    done = g.rel("AFFECTS").join(g.label("Task").where("status = 'done'").select(F.col("uid").alias("src")), "src", "left_semi").select(F.col("dst").alias("uid"))
    before = f.join(done, "uid", "left_semi").withColumn("endLine", F.least("endLine", F.col("startLine") + 40))
    return diff.snapshot_nodes(before.drop("uid")), diff.snapshot_nodes(f.drop("uid"))


def _quality_files(g: Graph) -> DataFrame:
    n = F.length("name").cast("long")
    return g.label("Function").select(F.col("file").alias("language"), F.lit(1).cast("long").alias("parseErrors"), n.alias("sites"), F.expr("length(name) div 2").alias("resolved"))


def _literals(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(spark, {"ASTNode": lambda: extract.number_literals(_read(spark, sf_dir, "documents"), "doc_id", "text", "source")}, {})
