"""Token-ID output: Parquet list columns in document order, with dictionary and delta encoding, read selectively."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vocab

#: Small row groups and pages, so that min and max of the sorted doc_id let a reader skip all others.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding where a dictionary doesn't pay
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
#: Bytes of text in a file, about.
FILE_BYTES = 64 << 20
STORED = "doc_id long, part long, part_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str = vocab.WORDS, end_id: int = 1) -> None:
    """Writes the ids of every document, ``end_id`` behind each, in ascending order of doc_id, then of the text's hash.

    Files follow that order by ``part``, one for about ``FILE_BYTES`` of text. A null or empty text is stored as its end
    id alone; a null doc_id comes first; rows with the same doc_id are stored each, and many of them are dealt to
    several files by their texts (equal rows lie together); an empty table gives an empty one; further columns are left
    out, whatever their names.
    """
    keyed = common.keyed(docs)
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    keyed = keyed.withColumn("text_hash", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").drop("text_hash")

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, ids, bounds in vocab.encoded(batch, tokenizer, end_id):
                sizes = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(np.full(j - i, part)),
                        pa.array(before + bounds[:-1]),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    ],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                before += len(ids)

    ordered.mapInArrow(run, STORED).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, ids: bool = True) -> DataFrame:
    """Stored rows with doc_id from ``first`` to ``last``: filters reach row groups and pages; without ``ids`` only metadata is read."""
    stored = spark.read.schema(STORED).parquet(path)
    if first is not None:
        stored = stored.where(F.col("doc_id") >= first)
    if last is not None:
        stored = stored.where(F.col("doc_id") <= last)
    return stored if ids else stored.drop("ids")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: its place in the whole id sequence, its ids' number and checksum, from the files."""
    totals = read_tokens(spark, path, ids=False).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row a file
    before = dict(zip((r["part"] for r in totals), np.concatenate(([0], np.cumsum([r["n"] for r in totals])[:-1])).tolist() if totals else [], strict=True))

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.asarray(lists.offsets)
            flat = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<u4")).cast("B")
            starts = np.array([before[p] for p in batch.column("part").to_pylist()], np.int64) + np.asarray(batch.column("part_start"))
            sums = [zlib.crc32(flat[4 * i : 4 * j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).select("doc_id", "part", "part_start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written to token files and read back from them; nulls, repeats and empty tables as in ``write_tokens``."""
    path = common.scratch_path(spark)
    write_tokens(common.table(spark, sf_dir, "documents"), path)
    return token_index(spark, path)
