"""Streams with state against batch results: late and repeated files, restarts, leases that end."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.streaming import events, state

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture(autouse=True)
def store(spark):
    state.prepare(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(spark, rows, path, name):
    df = spark.createDataFrame(rows, "event_id long, ms long, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.timestamp_millis("ms")).select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{path}/{name}")


def test_late_and_replayed_files_give_the_batch(spark, tmp_path):
    rng = random.Random(1)
    minute = 60_000
    rows = [(k, 1_700_000_000_000 + rng.randrange(600) * minute // 4, rng.randrange(5), rng.choice("abc"), 1.0, None) for k in range(300)]
    rows.sort(key=lambda r: r[1] + rng.randrange(25) * minute)  # up to 25 minutes late
    parts = [rows[:100], rows[100:200], rows[200:] + rows[250:260]]
    where, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    end = max(r[1] for r in rows) + 24 * 60 * minute
    for k, part in enumerate([*parts, rows[150:220], [(9000, end, 99, "end", 0.0, None)], [(9001, end + 1, 99, "end", 0.0, None)]]):
        put(spark, part, where, f"file{k}")
        stream = events.event_stream(spark, f"{where}/*")
        query = state.count_follows(stream, out, f"{checkpoint}")  # a new query each time goes on from the checkpoint
        query.awaitTermination()
    every = spark.createDataFrame(rows, "event_id long, ms long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_millis("ms"))
    want = {tuple(r) for r in events.execution_next(every).collect()}
    assert {tuple(r) for r in state.followed(spark, out).where("src <> 'end' AND dst <> 'end'").select("src", "dst", "count", "lastSeen").collect()} == want


def test_leases_end_once(spark, tmp_path):
    schema = "node string, owner string, action string, ts timestamp, seq long"

    def ask(name, rows):
        df = spark.createDataFrame([(n, o, a, ms, k) for k, (n, o, a, ms) in enumerate(rows, 100 * name)], "node string, owner string, action string, ms long, seq long")
        df.withColumn("ts", F.timestamp_millis("ms")).select("node", "owner", "action", "ts", "seq").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*").withWatermark("ts", "0 seconds")
        told = state.leases(stream, 1000)
        query = told.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()

    ask(0, [("a", "x", "acquire", 1000), ("a", "y", "acquire", 1500), ("b", "x", "acquire", 1200), ("b", "x", "release", 1700), ("c", "x", "renew", 1000), ("d", "x", "acquire", 1000), (None, "x", "acquire", 1000)])
    ask(1, [("a", "x", "renew", 1800), ("b", "y", "acquire", 1900), ("z", "z", "acquire", 2500)])
    ask(2, [("a", "y", "acquire", 2900), ("z", "z", "renew", 3400)])
    ask(3, [("z", "z", "release", 9000)])
    ask(4, [("q", "q", "acquire", 9500)])
    got = sorted((r.node, r.ms, r.owner, r.event) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [
        ("a", 1000, "x", "acquired"), ("a", 1500, "y", "refused"), ("a", 1800, "x", "renewed"), ("a", 2800, "x", "expired"), ("a", 2900, "y", "acquired"), ("a", 3900, "y", "expired"),
        ("b", 1200, "x", "acquired"), ("b", 1700, "x", "released"), ("b", 1900, "y", "acquired"), ("b", 2900, "y", "expired"),
        ("c", 1000, "x", "refused"), ("d", 1000, "x", "acquired"), ("d", 2000, "x", "expired"),
        ("q", 9500, "q", "acquired"),
        ("z", 2500, "z", "acquired"), ("z", 3400, "z", "renewed"), ("z", 4400, "z", "expired"), ("z", 9000, "z", "refused"),
    ]
