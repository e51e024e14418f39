"""A stored graph that is changed by whole batches: new tables are written aside, then one file is swapped that names them."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.graph import Graph

MANIFEST = "manifest.json"


class Store:
    """A graph under ``path``: a table for each label and relationship type, and a manifest of those that count.

    Readers see the manifest's tables alone, so a writer that dies leaves the old state; its tables stay until ``vacuum``.
    The manifest is replaced by a rename, which is whole on file systems that have one (an object store's isn't). One
    writer at a time; a batch whose request id the manifest holds is not applied again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("").getFileSystem(self._conf)

    def manifest(self) -> dict:
        """nodes and edges: name -> folder; requests: the ids of all batches applied."""
        where = self._at(MANIFEST)
        if not self._files().exists(where):
            return {"nodes": {}, "edges": {}, "requests": []}
        stream = self._files().open(where)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _swap(self, manifest: dict) -> None:
        aside = self._at(f"_{MANIFEST}-{uuid.uuid4().hex}")
        stream = self._files().create(aside)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(aside, self._at(MANIFEST), options)

    def graph(self) -> Graph:
        """The graph as the manifest names it now; later batches don't change it."""
        held = self.manifest()
        tables = lambda kind: {name: lambda f=folder: self.spark.read.parquet(f"{self.path}/{f}") for name, folder in held[kind].items()}
        return Graph(self.spark, tables("nodes"), tables("edges"))

    def upsert(self, request: str, nodes: dict[str, DataFrame] | None = None, edges: dict[str, DataFrame] | None = None) -> bool:
        """Adds nodes (uid, properties) by label and edges (src, dst, properties) by type, or changes those that are there.

        A property that isn't null replaces the old one, others stay; of rows with one key in a batch, the largest values
        count. Returns False, and does nothing, for a request that was applied before. Only the tables of labels and types
        that the batch names are written anew, each by one join on its key.
        """
        held = self.manifest()
        if request in held["requests"]:
            return False
        now = {"nodes": dict(held["nodes"]), "edges": dict(held["edges"]), "requests": [*held["requests"], request]}
        for kind, tables, key in (("nodes", nodes or {}, ["uid"]), ("edges", edges or {}, ["src", "dst"])):
            for name, new in tables.items():
                new = new.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key)))
                more = [c for c in new.columns if c not in key]
                new = new.groupBy(*key).agg(*(F.max(c).alias(c) for c in more)) if more else new.select(*key).distinct()
                if name in held[kind]:
                    new = self._merged(self.spark.read.parquet(f"{self.path}/{held[kind][name]}"), new, key)
                folder = f"data/{kind}/{name}/{uuid.uuid4().hex}"
                new.write.parquet(f"{self.path}/{folder}")
                now[kind][name] = folder
        self._swap(now)
        return True

    def _merged(self, old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
        names = [*old.columns, *(c for c in new.columns if c not in old.columns)]
        a, b = old.alias("a"), new.alias("b")
        met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full")

        def value(c: str):
            sides = [F.col(f"{side}.{c}") for side, df in (("b", new), ("a", old)) if c in df.columns]
            return F.coalesce(*sides).alias(c)

        return met.select(*(value(c) for c in names))

    def vacuum(self) -> int:
        """Deletes tables and manifests that don't count, once no reader or writer is at work; how many it deleted."""
        held, files, gone = self.manifest(), self._files(), 0
        keep = {f"{self.path}/{folder}" for kind in ("nodes", "edges") for folder in held[kind].values()}
        names = {folder.rstrip("/").rsplit("/", 1)[1] for folder in keep}
        for pattern in ("data/*/*/*", f"_{MANIFEST}-*"):
            for status in files.globStatus(self._at(pattern)) or []:
                if status.getPath().getName() not in names:
                    files.delete(status.getPath(), True)
                    gone += 1
        return gone
