"""The element tree of pages: tags matched by running sums and windows, JVM-side; no page leaves Spark's operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.scratch import written

# Fixed values of the markup language: elements without content, and those whose content is text.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
RAW = "script style textarea title".split()
#: Bytes of pages' files that a task takes: a page's tags and paths fill many times that in memory.
EACH = 2 << 20
COMMENT, TAG, NAME = r"(?s)<!--.*?-->", r"</?[a-zA-Z][a-zA-Z0-9]*[^>]*>", r"^</?([a-zA-Z][a-zA-Z0-9]*)"


def raw_pattern(name: str) -> str:
    """An element whose content is text: its start tag and its end tag are groups."""
    return rf"(?is)(<{name}\b[^>]*>).*?(</{name}\s*>)"


def _tags(html: Column) -> Column:
    text = F.regexp_replace(html, COMMENT, "")
    for name in RAW:
        text = F.regexp_replace(text, raw_pattern(name), "$1$2")
    return F.regexp_extract_all(text, F.lit(TAG), F.lit(0))


def parts(pages: DataFrame) -> int:
    """How many tasks the tags of ``pages`` are dealt to, in proportion to the size of what they are read from, if known."""
    leaves = pages._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # rows that were made in the application have no size
    usual = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(usual, -(-size // EACH)), 1 << 15)


def tags(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, tag, kind): the tags of pages in order; kind is open, close or leaf, comments are left out.

    An end tag belongs to the last start tag of its name that has none yet. A start tag without an end tag is a leaf, like
    elements that have no content and tags that end in ``/>``; an end tag without a start tag is left out. A tag ends at
    the first ``>``, also within quotes. What stands in scripts, styles, titles and text areas is text.
    """
    # all windows of a page are within its task: its tags are shuffled once
    each = pages.select("page_id", "url", F.posexplode(_tags(F.col("html"))).alias("pos", "raw")).repartition(parts(pages), "page_id")
    tag = F.lower(F.regexp_extract("raw", NAME, 1))
    leaf = tag.isin(VOID) | F.col("raw").endswith("/>")
    kind = F.when(F.col("raw").startswith("</"), F.when(tag.isin(VOID), "none").otherwise("close")).when(leaf, "leaf").otherwise("open")
    each = each.select("page_id", "url", "pos", tag.alias("tag"), kind.alias("kind")).where("kind <> 'none'")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)

    # a tag without a partner: the sum of its name's tags, from its side, falls to a new least below zero
    for name, order, sign, kind_ in (("ends", F.col("pos"), step, "close"), ("begins", F.desc("pos"), -step, "open")):
        along = Window.partitionBy("page_id", "tag").orderBy(order)
        earlier = along.rowsBetween(Window.unboundedPreceding, -1)
        each = each.withColumn("total", F.sum(sign).over(along)).withColumn("least", F.least(F.lit(0), F.coalesce(F.min("total").over(earlier), F.lit(0))))
        each = each.withColumn(name, (F.col("kind") == kind_) & (F.col("total") < F.col("least"))).drop("total", "least")
    matched = F.when(F.col("begins"), "leaf").otherwise(F.col("kind"))
    return each.where("NOT ends").select("page_id", "url", "pos", "tag", matched.alias("kind"))


def tree(pages: DataFrame) -> DataFrame:
    """(page_id, url, n, tagName, depth, parent, xpath): every element of pages (page_id, url, html), in order from 0.

    ``parent`` is the number of the element about it, null at the top, ``depth`` how many are about it; ``xpath`` counts
    elements of one name under one parent. Start tags open a level, an end tag that has a start tag closes the last one:
    as on a stack, whose height is a running sum and whose top is the last element opened at that height. Null and empty
    pages have no elements; repeated rows of a page aren't told apart: pages are by page_id. The windows are a page each;
    paths grow by doubling, in as many joins as the logarithm of the depth. Files hide how large the paths are, so none
    of these joins, nor one of the result, sends a side to all tasks.
    """
    page = Window.partitionBy("page_id").orderBy("pos")
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    height = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    element = F.when(F.col("kind") != "close", 1).otherwise(0)
    sums = {"depth": F.coalesce(F.sum(height).over(before), F.lit(0)), "n": F.coalesce(F.sum(element).over(before), F.lit(0))}
    each = tags(pages).withColumns(sums).where("kind <> 'close'")
    # an element asks at its own depth for the last one that opened this depth
    roles = F.array(F.struct(F.col("depth").alias("at"), F.lit(None).cast("long").alias("opened")), F.struct((F.col("depth") + 1).alias("at"), F.col("n").alias("opened")))
    roles = F.when(F.col("kind") == "open", roles).otherwise(F.slice(roles, 1, 1))
    asked = each.withColumn("role", F.explode(roles)).select("*", "role.at", "role.opened").drop("role")
    level = Window.partitionBy("page_id", "at").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.withColumn("parent", F.last("opened", ignorenulls=True).over(level)).where("opened IS NULL").drop("at", "opened")
    like = Window.partitionBy("page_id", "parent", "tag").orderBy("pos")
    step = F.concat(F.lit("/"), "tag", F.lit("["), F.row_number().over(like).cast("string"), F.lit("]"))
    rows = asked.select("page_id", "url", "n", F.col("tag").alias("tagName"), "depth", "parent", F.col("parent").alias("up"), step.alias("xpath"))
    rows, many = written(rows), parts(pages)
    while not rows.where("up IS NOT NULL").isEmpty():
        above = rows.select(F.col("page_id").alias("p"), F.col("n").alias("m"), F.col("up").alias("next"), F.col("xpath").alias("head"))
        met = rows.repartition(many, "page_id", "up").join(above.repartition(many, "p", "m").hint("merge"), (F.col("page_id") == F.col("p")) & (F.col("up") == F.col("m")), "left")
        rows = written(met.select("page_id", "url", "n", "tagName", "depth", "parent", F.col("next").alias("up"), F.concat(F.coalesce("head", F.lit("")), "xpath").alias("xpath")))
    return rows.drop("up").hint("merge")


def _sql_tags() -> str:
    text = f"regexp_replace(html, '{COMMENT}', '', 'g')"
    for name in RAW:
        text = f"regexp_replace({text}, '{raw_pattern(name)}', '\\1\\2', 'g')"
    return f"regexp_extract_all({text}, '{TAG}')"


#: The same in SQL: common tables up to ``dom``.
DOM_SQL = f"""
raw AS (SELECT page_id, url, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, url, {_sql_tags()} AS l FROM pages)),
named AS (SELECT *, lower(regexp_extract(raw, '{NAME}', 1)) AS tag FROM raw),
kinds AS (SELECT page_id, url, pos, tag, CASE WHEN starts_with(raw, '</') THEN -1 WHEN tag IN ({", ".join(repr(x) for x in VOID)}) OR ends_with(raw, '/>') THEN 0 ELSE 1 END AS s FROM named WHERE NOT (starts_with(raw, '</') AND tag IN ({", ".join(repr(x) for x in VOID)}))),
sums AS (SELECT *, sum(s) OVER (PARTITION BY page_id, tag ORDER BY pos) AS a, sum(-s) OVER (PARTITION BY page_id, tag ORDER BY pos DESC) AS b FROM kinds),
matched AS (SELECT *, s = -1 AND a < least(0, coalesce(min(a) OVER (PARTITION BY page_id, tag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS ends, s = 1 AND b < least(0, coalesce(min(b) OVER (PARTITION BY page_id, tag ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS begins FROM sums),
heights AS (SELECT page_id, url, pos, tag, s = -1 AS closes, CASE WHEN begins THEN 0 ELSE s END AS s FROM matched WHERE NOT ends),
numbered AS (SELECT *, coalesce(sum(s) OVER w, 0) AS depth, coalesce(sum(CASE WHEN closes THEN 0 ELSE 1 END) OVER w, 0) AS n FROM heights WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
elements AS (SELECT * FROM numbered WHERE NOT closes),
held AS (SELECT e.*, o.n AS parent FROM elements e ASOF LEFT JOIN (SELECT page_id, depth + 1 AS depth, n, pos FROM elements WHERE s = 1) o ON e.page_id = o.page_id AND e.depth = o.depth AND e.pos > o.pos),
dom AS (SELECT page_id, url, CAST(n AS BIGINT) AS n, tag, CAST(depth AS BIGINT) AS depth, CAST(parent AS BIGINT) AS parent, '/' || tag || '[' || row_number() OVER (PARTITION BY page_id, parent, tag ORDER BY pos) || ']' AS step FROM held),
paths AS (SELECT page_id, n, step AS xpath FROM dom WHERE parent IS NULL UNION ALL SELECT d.page_id, d.n, p.xpath || d.step FROM paths p JOIN dom d ON d.page_id = p.page_id AND d.parent = p.n)"""
