"""What an application adds to the code graph, derived from the star-schema tables: requirements and tests, endpoints,
effects, props, page elements and the steps of user events."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.sources import dom
from lattica.sources.extract import elements
from lattica.sources.star import star_graph


def app_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The star graph with the labels and relationship types that the analyses of an application ask for."""
    star = star_graph(spark, sf_dir)

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def uid(label: str, column: str) -> Column:
        return F.concat(F.lit(f"{label}:"), F.col(column).cast("string"))

    def edge(df: DataFrame, src: tuple[str, str], dst: tuple[str, str], *more: Column) -> DataFrame:
        return df.select(uid(*src).alias("src"), uid(*dst).alias("dst"), *more)

    urgent = F.col("o_orderpriority").startswith("1")

    def tests() -> DataFrame:
        return table("orders").where(urgent)

    def test_lines() -> DataFrame:
        return table("lineitem").join(tests().select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")

    def functions() -> DataFrame:
        return star.label("Function").withColumn("acceptsProps", F.split("name", " "))

    def files() -> DataFrame:
        """With call sites: returned lines are external, lines still open are resolved."""
        line = table("lineitem").join(table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
        inside = F.col("l_returnflag") != "R"
        count = lambda on: F.count(F.when(on, 1))
        per = line.groupBy(F.col("p_brand").alias("path")).agg(F.count(F.lit(1)).alias("callSites"), count(~inside).alias("externalCallSites"), count(inside).alias("internalCallSites"), count(inside & (F.col("l_linestatus") == "O")).alias("callsResolved"))
        return star.label("File").join(per, "path", "left")

    def users() -> DataFrame:
        bad = table("events").where("event_type = 'error'").groupBy("user_id").agg(F.max_by("props", F.struct("ts", "event_id")).alias("lastError"), F.max("ts").alias("lastErrorTimestamp"))
        return star.label("User").join(bad.select(uid("User", "user_id").alias("uid"), "lastError", "lastErrorTimestamp"), "uid", "left").withColumn("file", F.lit(None).cast("string"))

    def effects() -> DataFrame:
        s = table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
        each = table("lineitem").select("l_partkey", "l_suppkey").distinct().join(s, "l_suppkey")
        return each.select(F.concat_ws(":", F.lit("Effect"), "l_partkey", "l_suppkey").alias("uid"), uid("Function", "l_partkey").alias("of"), F.lit("useEffect").alias("hookType"), F.col("l_suppkey").cast("long").alias("startLine"), F.col("s_name").alias("deps"))

    def watches() -> DataFrame:
        """Effects of suppliers in debt watch the state of their nation."""
        s = table("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("long").alias("startLine"), uid("State", "s_nationkey").alias("dst"))
        return effects().join(s, "startLine").select(F.col("uid").alias("src"), "dst")

    def endpoints() -> DataFrame:
        return table("part").select("p_type").distinct().select(uid("Endpoint", "p_type").alias("uid"), F.concat(F.lit("/"), "p_type").alias("url"), F.when(F.length("p_type") % 2 == 0, "GET").otherwise("POST").alias("method"))

    def reached(visibility: str) -> DataFrame:
        f = star.label("Function").where(F.col("visibility") == visibility).select("uid")
        return f.join(edge(table("part"), ("Function", "p_partkey"), ("Endpoint", "p_type")), F.col("uid") == F.col("src")).select("src", "dst")

    def steps() -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        return edge(table("lineitem").withColumn("n", F.row_number().over(order).cast("long")), ("UserEvent", "l_orderkey"), ("Function", "l_partkey"), F.col("n").alias("stepOrder"))

    def props() -> DataFrame:
        """A call passes the words of the caller's name; private callers spread."""
        f = star.label("Function").select(F.col("uid").alias("src"), F.split("name", " ").alias("props"), (F.col("visibility") == "private").alias("hasSpread"))
        return star.rel("CALLS").join(f, "src")

    @cache
    def tree() -> DataFrame:
        return dom.tree(table("pages"))

    def rendered(n: str) -> Column:
        return F.concat_ws(":", F.lit("RuntimeDOM"), "page_id", n)

    nodes = {
        **star._nodes,
        "Function": functions,
        "File": files,
        "User": users,
        "Module": lambda: table("part").select("p_type").distinct().select(uid("Module", "p_type").alias("uid"), F.col("p_type").alias("name")),
        "Requirement": lambda: table("customer").select(uid("Requirement", "c_custkey").alias("uid"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("changeId")),
        "TestCase": lambda: tests().select(uid("TestCase", "o_orderkey").alias("uid"), F.concat_ws(" ", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderstatus").alias("changeId")),
        "Endpoint": endpoints,
        "Effect": lambda: effects().drop("of"),
        "DOMElement": lambda: elements(table("pages"), "DOMElement").withColumn("elementId", F.col("uid")),
        "RuntimeDOM": lambda: tree().select(rendered("n").alias("uid"), "tagName", F.lit(None).cast("string").alias("testId"), "xpath"),
        "UserEvent": lambda: table("events").select(uid("UserEvent", "event_id").alias("uid"), F.col("event_type").alias("componentName"), F.col("ts").alias("timestamp"), F.lower(F.hex("event_type")).alias("executionPathHex")),
    }
    edges = {
        **star._edges,
        "IMPORTS": lambda: star.rel("IMPORTS").unionByName(edge(table("part"), ("File", "p_brand"), ("Module", "p_type")).distinct()),
        "VALIDATED_BY": lambda: edge(tests().where("o_orderstatus = 'F'"), ("Requirement", "o_custkey"), ("TestCase", "o_orderkey")).unionByName(edge(tests().where("o_orderstatus = 'O'"), ("Criterion", "o_orderkey"), ("TestCase", "o_orderkey"))),
        "HAS_CRITERION": lambda: edge(table("orders").where("o_orderstatus = 'O'"), ("Requirement", "o_custkey"), ("Criterion", "o_orderkey")),
        "VALIDATES": lambda: edge(test_lines(), ("TestCase", "l_orderkey"), ("Class", "l_suppkey")).distinct(),
        "IMPLEMENTED_BY": lambda: edge(test_lines().where("l_returnflag = 'R'"), ("TestCase", "l_orderkey"), ("Function", "l_partkey")).distinct(),
        "HANDLES": lambda: reached("public"),
        "FETCHES": lambda: reached("private"),
        "HAS_EFFECT": lambda: effects().select(F.col("of").alias("src"), F.col("uid").alias("dst")),
        "WATCHES": watches,
        "PASSES_PROP": props,
        "EXECUTION_STEP": steps,
        "TRIGGERS": lambda: edge(table("events"), ("UserEvent", "event_id"), ("Function", "event_id")),
        "CLICKS_ON": lambda: table("events").where("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("count")).select(uid("User", "user_id").alias("src"), uid("Function", "user_id").alias("dst"), "count"),
        "HAS_CHILD": lambda: tree().where("parent IS NOT NULL").select(rendered("parent").alias("src"), rendered("n").alias("dst")),
    }
    return Graph(spark, nodes, edges)


#: Common tables of the same in SQL, after those of the star graph.
APP_SQL = """
, test AS (SELECT 'TestCase:' || o_orderkey AS uid, o_orderstatus || ' ' || o_orderkey AS title, o_orderstatus AS change, o_orderkey AS k FROM orders WHERE o_orderpriority LIKE '1%'),
impl AS (SELECT DISTINCT 'TestCase:' || l_orderkey AS src, 'Function:' || l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT k FROM test)),
vali AS (SELECT DISTINCT 'TestCase:' || l_orderkey AS src, 'Class:' || l_suppkey AS dst FROM lineitem WHERE l_orderkey IN (SELECT k FROM test)),
eff AS (SELECT DISTINCT 'Function:' || l_partkey AS f, l_suppkey AS k, s_name AS deps, s_acctbal < 0 AS watches, 'State:' || s_nationkey AS state FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
steps AS (SELECT l_orderkey AS e, 'Function:' || l_partkey AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
tags AS (SELECT page_id, url, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS n FROM (SELECT page_id, url, [lower(x) FOR x IN regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)] AS l FROM pages)),
ev AS (SELECT event_id, ts, event_type, fn.uid AS f, fn.name FROM events JOIN fn ON fn.uid = 'Function:' || event_id)
"""
