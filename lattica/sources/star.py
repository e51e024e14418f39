"""A code graph derived from the star-schema tables: parts are functions, brands files, suppliers classes, nations states,
orders tasks, events user actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.scratch import written

#: Edge sets derived once an application, by the state of the table they come from.
_derived: dict[tuple, DataFrame] = {}


def _changed(spark: SparkSession, path: str) -> int:
    """When a table's file or folder last changed, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph; edge sets that need a shuffle of order lines are written once an application and read from then on.

    Edges are told apart, joined and written by the numbers of their ends, and get uids where they are read.
    """

    def kept(name: str, make) -> DataFrame:
        key = (spark.sparkContext.applicationId, name, sf_dir, *(_changed(spark, f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part", "supplier")))
        if key not in _derived:
            _derived[key] = written(make())
        return _derived[key]

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def uid(label: str, column: str):
        return F.concat(F.lit(f"{label}:"), F.col(column).cast("string"))

    def functions() -> DataFrame:
        return table("part").select(uid("Function", "p_partkey").alias("uid"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.concat(F.lit("("), "p_type", F.lit(","), F.col("p_size").cast("string"), F.lit(")")).alias("params"), F.col("p_partkey").cast("long").alias("startLine"), (F.col("p_partkey") + F.col("p_size")).cast("long").alias("endLine"), F.when(F.col("p_size") % 2 == 0, "public").otherwise("private").alias("visibility"))

    def files() -> DataFrame:
        return table("part").select(uid("File", "p_brand").alias("uid"), F.col("p_brand").alias("name"), F.col("p_brand").alias("path")).distinct()

    def classes() -> DataFrame:
        s, n = table("supplier"), table("nation")
        return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(uid("Class", "s_suppkey").alias("uid"), F.col("s_name").alias("name"), F.col("n_name").alias("file"))

    def states() -> DataFrame:
        return table("nation").select(uid("State", "n_nationkey").alias("uid"), F.col("n_name").alias("name"))

    def tasks() -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "O", "todo").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("done")
        first = F.substring("o_orderpriority", 1, 1)
        return table("orders").select(uid("Task", "o_orderkey").alias("uid"), status.alias("status"), F.when(first == "1", "critical").when(first == "2", "high").when(first == "3", "medium").otherwise("low").alias("priority"))

    def calls() -> DataFrame:
        along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        pair = table("lineitem").select("l_partkey", F.lead("l_partkey").over(along).alias("next")).where("next IS NOT NULL")
        return pair.distinct()

    def named(pairs: DataFrame, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
        return pairs.select(uid(*src).alias("src"), uid(*dst).alias("dst"))

    def called(pairs: DataFrame) -> DataFrame:
        return named(pairs, ("Function", "l_partkey"), ("Function", "next"))

    def finished() -> DataFrame:
        """Calls in finished orders: an earlier state of all calls, for differences."""
        along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        done = table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
        pair = table("lineitem").join(done, "l_orderkey", "left_semi").select("l_partkey", F.lead("l_partkey").over(along).alias("next")).where("next IS NOT NULL")
        return pair.distinct()

    def urgent() -> DataFrame:
        """Calls in urgent orders in progress: a sparse state of all calls, with and without cycles."""
        along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        some = table("orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
        pair = table("lineitem").join(some, "l_orderkey", "left_semi").select("l_partkey", F.lead("l_partkey").over(along).alias("next")).where("next IS NOT NULL")
        return pair.distinct()

    def depends() -> DataFrame:
        queue = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")
        return table("orders").select(uid("Task", "o_orderkey").alias("src"), F.lag("o_orderkey").over(queue).alias("before")).where("before IS NOT NULL").select("src", uid("Task", "before").alias("dst"))

    def pairs(name: str, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
        return named(kept(name, lambda: table("lineitem").select(src[1], dst[1]).distinct()), src, dst)

    def writes() -> DataFrame:
        s = table("supplier").select("s_suppkey", "s_nationkey")
        return table("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "s_nationkey").distinct()

    def flows() -> DataFrame:
        rows = kept("CONTAINS_FLOW", lambda: table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct())
        return rows.select(uid("Function", "l_partkey").alias("src"), F.concat_ws(":", F.lit("ControlFlow"), "l_orderkey", "l_linenumber", "l_partkey").alias("dst"), F.col("l_linenumber").cast("long").alias("depth"))

    def imports() -> DataFrame:
        a, b = (table("part").select(F.col("p_partkey").alias(end), F.col("p_brand").alias(name)) for end, name in (("l_partkey", "a"), ("next", "b")))
        out = kept("CALLS", calls).join(a, "l_partkey").join(b, "next").where("a <> b")
        return out.select(uid("File", "a").alias("src"), uid("File", "b").alias("dst")).distinct()

    nodes = {"Function": functions, "File": files, "Class": classes, "State": states, "Task": tasks}
    nodes["User"] = lambda: table("events").select(uid("User", "user_id").alias("uid"), F.col("user_id").cast("string").alias("name")).distinct()
    nodes["UserEvent"] = lambda: table("events").select(uid("UserEvent", "event_id").alias("uid"), F.col("event_type").alias("eventType"), "ts", "value", "user_id", "event_id")
    edges = {
        "CALLS": lambda: called(kept("CALLS", calls)),
        "CALLS_FINISHED": lambda: called(finished()),
        "CALLS_URGENT": lambda: called(kept("CALLS_URGENT", urgent)),
        "DEPENDS_ON": depends,
        "CONTAINS": lambda: functions().select(uid("File", "file").alias("src"), F.col("uid").alias("dst")),
        "HAS_METHOD": lambda: pairs("HAS_METHOD", ("Class", "l_suppkey"), ("Function", "l_partkey")),
        "WRITES_STATE": lambda: named(kept("WRITES_STATE", writes), ("Function", "l_partkey"), ("State", "s_nationkey")),
        "CONTAINS_FLOW": flows,
        "AFFECTS": lambda: pairs("AFFECTS", ("Task", "l_orderkey"), ("Function", "l_partkey")),
        "IMPORTS": lambda: kept("IMPORTS", imports),
        "PERFORMED": lambda: table("events").select(uid("User", "user_id").alias("src"), uid("UserEvent", "event_id").alias("dst")),
    }
    return Graph(spark, nodes, edges)


#: The same graph for SQL: common tables to put before a query.
STAR_SQL = """
fn AS (SELECT 'Function:' || p_partkey AS uid, p_name AS name, p_brand AS file, '(' || p_type || ',' || p_size || ')' AS params, CAST(p_partkey AS BIGINT) AS "startLine", CAST(p_partkey + p_size AS BIGINT) AS "endLine", CASE WHEN p_size % 2 = 0 THEN 'public' ELSE 'private' END AS visibility FROM part),
fi AS (SELECT DISTINCT 'File:' || p_brand AS uid, p_brand AS name, p_brand AS path FROM part),
cl AS (SELECT 'Class:' || s_suppkey AS uid, s_name AS name, n_name AS file FROM supplier JOIN nation ON s_nationkey = n_nationkey),
st AS (SELECT 'State:' || n_nationkey AS uid, n_name AS name FROM nation),
ta AS (SELECT 'Task:' || o_orderkey AS uid, CASE o_orderstatus WHEN 'O' THEN 'todo' WHEN 'P' THEN 'in_progress' ELSE 'done' END AS status, CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS priority FROM orders),
c0 AS (SELECT DISTINCT l_partkey AS a, b FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b FROM lineitem) WHERE b IS NOT NULL),
calls AS (SELECT 'Function:' || a AS src, 'Function:' || b AS dst FROM c0),
loc AS (SELECT DISTINCT 'Function:' || a AS src, 'Function:' || b AS dst FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) WHERE b IS NOT NULL),
urgent AS (SELECT DISTINCT 'Function:' || a AS src, 'Function:' || b AS dst FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')) WHERE b IS NOT NULL),
step AS (SELECT src, dst FROM calls WHERE src <> dst),
hub AS (SELECT src FROM step GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
depends AS (SELECT 'Task:' || o_orderkey AS src, 'Task:' || b AS dst FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL),
contains AS (SELECT 'File:' || file AS src, uid AS dst FROM fn),
hasm AS (SELECT DISTINCT 'Class:' || l_suppkey AS src, 'Function:' || l_partkey AS dst FROM lineitem),
writes AS (SELECT DISTINCT 'Function:' || l_partkey AS src, 'State:' || s_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
flows AS (SELECT DISTINCT 'Function:' || l_partkey AS src, 'ControlFlow:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey AS dst, CAST(l_linenumber AS BIGINT) AS depth FROM lineitem),
affects AS (SELECT DISTINCT 'Task:' || l_orderkey AS src, 'Function:' || l_partkey AS dst FROM lineitem),
imports AS (SELECT DISTINCT 'File:' || x.file AS src, 'File:' || y.file AS dst FROM calls JOIN fn x ON calls.src = x.uid JOIN fn y ON calls.dst = y.uid WHERE x.file <> y.file)
"""
