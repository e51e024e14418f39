"""Runtime events as a stream: counters of what follows what, kept in a table that batches update."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def execution_next(events: DataFrame) -> DataFrame:
    """(src, dst, count, lastSeen): event types that follow each other for one user."""
    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = events.select(F.col("event_type").alias("src"), F.lead("event_type").over(along).alias("dst"), F.lead("ts").over(along).alias("at")).where("dst IS NOT NULL")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("count"), F.max("at").alias("lastSeen"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of one user's events, ended by a pause: an extension beside the counters."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of events, each event once within an hour."""
    return spark.readStream.schema(EVENT_SCHEMA).parquet(path).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])


def count_types(stream: DataFrame, path: str, checkpoint: str):
    """A query that keeps (event_type, n, lastSeen) per batch under ``path``, by batch number: a batch replayed replaces
    its own rows, so totals hold."""

    def put(batch: DataFrame, number: int) -> None:
        per = batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("lastSeen"))
        per.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("n").alias("n"), F.max("lastSeen").alias("lastSeen"))
