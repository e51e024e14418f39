"""The property graph: node sets by label and edge sets by relationship type, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels kept as boolean columns of other labels.
FACETS = {"Component": "isComponent", "HTTPHandler": "isHttpHandler", "RuntimeDOM": "isRuntime", "Hook": "isHook", "Async": "isAsync"}


class Graph:
    """``nodes``: label -> DataFrame with uid; ``edges``: type -> DataFrame with src and dst. Built when first used."""

    def __init__(self, spark: SparkSession, nodes: dict[str, Callable[[], DataFrame]], edges: dict[str, Callable[[], DataFrame]]):
        self.spark, self._nodes, self._edges, self._made = spark, nodes, edges, {}

    @classmethod
    def stored(cls, spark: SparkSession, path: str) -> Graph:
        """A graph written by ``write``; labels and types are partitions, so each is read alone."""
        nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
        labels = [r[0] for r in nodes.select("label").distinct().collect()]
        types = [r[0] for r in edges.select("rel_type").distinct().collect()]
        return cls(spark, {x: lambda x=x: nodes.where(F.col("label") == x).drop("label") for x in labels}, {x: lambda x=x: edges.where(F.col("rel_type") == x).drop("rel_type") for x in types})

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> Graph:
        """A graph of two tables with columns label and rel_type."""
        labels = [r[0] for r in nodes.select("label").distinct().collect()]
        types = [r[0] for r in edges.select("rel_type").distinct().collect()]
        return cls(nodes.sparkSession, {x: lambda x=x: nodes.where(F.col("label") == x).drop("label") for x in labels}, {x: lambda x=x: edges.where(F.col("rel_type") == x).drop("rel_type") for x in types})

    @property
    def labels(self) -> list[str]:
        return sorted(self._nodes)

    @property
    def types(self) -> list[str]:
        return sorted(self._edges)

    def _get(self, kind: str, made: dict, name: str) -> DataFrame:
        if (kind, name) not in self._made:
            if name not in made:
                raise ValueError(f"the graph has no {kind} {name}; it has {', '.join(sorted(made))}")
            self._made[kind, name] = made[name]()
        return self._made[kind, name]

    def label(self, name: str) -> DataFrame:
        """Nodes of a label; a facet label selects by its column."""
        if name in FACETS and name not in self._nodes:
            some = [self.label(x) for x in self.labels if FACETS[name] in self.label(x).columns]
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some).where(F.col(FACETS[name]))
        return self._get("label", self._nodes, name)

    def rel(self, *names: str) -> DataFrame:
        """Edges of one or more types; of several, (rel_type, src, dst)."""
        if len(names) == 1:
            return self._get("relationship type", self._edges, names[0])
        return reduce(DataFrame.unionByName, [self.rel(x).select(F.lit(x).alias("rel_type"), "src", "dst") for x in names])

    def nodes(self, labels: Iterable[str] | None = None) -> DataFrame:
        """Nodes of all (or some) labels with the union of their columns and ``label``."""
        some = [self.label(x).withColumn("label", F.lit(x)) for x in labels or self.labels]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some)

    def edges(self, types: Iterable[str] | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.rel(x).select(F.lit(x).alias("rel_type"), "src", "dst") for x in types or self.types])

    def write(self, path: str) -> None:
        self.nodes().write.partitionBy("label").parquet(f"{path}/nodes")
        some = [self.rel(x).withColumn("rel_type", F.lit(x)) for x in self.types]
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some).write.partitionBy("rel_type").parquet(f"{path}/edges")

    def validate(self) -> DataFrame:
        """Broken invariants: (problem, subject, n) for repeated uids and edges without a node at an end."""
        ids = self.nodes().select("uid")
        twice = ids.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated uid").alias("problem"), F.col("uid").alias("subject"), "n")
        loose = [self.edges().join(ids, F.col(end) == F.col("uid"), "left_anti").groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"no node at {end}").alias("problem"), F.col("rel_type").alias("subject"), "n") for end in ("src", "dst")]
        return twice.unionByName(loose[0]).unionByName(loose[1])
