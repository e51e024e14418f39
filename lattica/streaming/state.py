"""Streams with state by key: what follows what for each user, in event order, and leases that end by timers.

State is kept by the stream's own store (RocksDB) and checkpoint, so a restarted query goes on where it was. A key's state
lies in one task, as with every keyed stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long a lease holds without renewal, in milliseconds.
TTL = 5 * 60 * 1000


FOLLOWED = {"src": object, "dst": object, "ms": "int64"}
TOLD = {"node": object, "owner": object, "event": object, "ms": "int64", "seq": "int64"}


def _frame(rows: list[tuple], kinds: dict) -> pd.DataFrame:
    """Rows as a frame whose columns have these types, also where there are none."""
    return pd.DataFrame({name: pd.Series([r[k] for r in rows], dtype=kind) for k, (name, kind) in enumerate(kinds.items())})


def prepare(spark: SparkSession) -> None:
    """Sets the state store that these processors need; for the session that starts them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Follows(StatefulProcessor):
    """Pairs of a user's events that follow each other, once no earlier event can come between them.

    State: the last event that was settled, and those that the watermark hasn't passed. A timer at the first of these
    settles all that it has passed, by (ts, event_id); so late files change nothing as long as they keep to the watermark.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_type string")
        self.open = handle.getListState("open", "ms long, event_id long, event_type string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            for ms, number, kind in zip(batch["ms"].tolist(), batch["event_id"].tolist(), batch["event_type"].tolist(), strict=True):
                self.open.appendValue((ms, number, kind))
                first = ms if first is None else min(first, ms)
        if first is not None:
            self.handle.registerTimer(first)
        yield _frame([], FOLLOWED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.open.get())
        done, rest = [x for x in held if x[0] <= passed], [x for x in held if x[0] > passed]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for ms, _, kind in done:
            if last is not None:
                out.append((last, kind, ms))
            last = kind
        if done:
            self.last.update((last,))
            if rest:
                self.open.put(rest)
                self.handle.registerTimer(rest[0][0])
            else:
                self.open.clear()
        yield _frame(out, FOLLOWED)

    def close(self) -> None:
        pass


def follows(events: DataFrame) -> DataFrame:
    """(src, dst, ms) of a stream of events (event_id, ts with a watermark, user_id, event_type): a row for each pair.

    Events without a user, time or type are left out, and so are those later than the watermark.
    """
    sound = events.where("user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL").withColumn("ms", F.unix_millis("ts"))
    return sound.groupBy("user_id").transformWithStateInPandas(Follows(), "src string, dst string, ms long", "Append", "EventTime")


def count_follows(stream: DataFrame, path: str, checkpoint: str):
    """A query that keeps (src, dst, count, lastSeen) a batch under ``path``: a batch that is replayed replaces its own rows."""
    prepare(stream.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        per = batch.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("count"), F.timestamp_millis(F.max("ms")).alias("lastSeen"))
        per.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return follows(stream).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, count, lastSeen) of all batches."""
    rows = spark.read.schema("src string, dst string, count long, lastSeen timestamp").parquet(path)
    return rows.groupBy("src", "dst").agg(F.sum("count").alias("count"), F.max("lastSeen").alias("lastSeen"))


class Leases(StatefulProcessor):
    """Who holds a node: ``acquire`` and ``renew`` begin or prolong a lease, ``release`` ends it, a timer ends it unrenewed.

    A node that another holds isn't acquired, and only its owner renews or releases it; such requests are refused. Requests
    of a batch are taken in order of (ts, seq).
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "owner string, expires long")

    def _set(self, owner: str | None, ms: int) -> None:
        if self.held.exists():
            self.handle.deleteTimer(self.held.get()[1])
        if owner is None:
            self.held.clear()
        else:
            self.held.update((owner, ms + self.ttl))
            self.handle.registerTimer(ms + self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = sorted(row for batch in rows for row in zip(batch["ms"].tolist(), batch["seq"].tolist(), batch["owner"].tolist(), batch["action"].tolist(), strict=True))
        out = []
        for ms, seq, owner, action in asked:
            holder, expires = self.held.get() if self.held.exists() else (None, 0)
            if holder is not None and expires <= ms:  # ended before this request, though no timer has come yet
                out.append((key[0], holder, "expired", expires, -1))
                self._set(None, ms)
                holder = None
            if holder == owner or holder is None and action == "acquire":
                self._set(None if action == "release" else owner, ms)
                out.append((key[0], owner, {"release": "released", "renew": "renewed"}.get(action, "acquired"), ms, seq))
            else:
                out.append((key[0], owner, "refused", ms, seq))
        yield _frame(out, TOLD)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.held.exists():
            holder, expires = self.held.get()
            if expires <= expiredTimerInfo.getExpiryTimeInMs():
                out.append((key[0], holder, "expired", expires, -1))
                self.held.clear()
        yield _frame(out, TOLD)

    def close(self) -> None:
        pass


def leases(requests: DataFrame, ttl: int = TTL) -> DataFrame:
    """(node, owner, event, ms, seq) of a stream of requests (node, owner, action, ts with a watermark, seq).

    ``event``: acquired, renewed, released, refused, or expired, which comes once for each lease that ends unrenewed, with
    the time it ended and no seq (-1). Requests without a node, owner, action or time are left out. Set the session's store
    with ``prepare`` first.
    """
    sound = requests.where("node IS NOT NULL AND owner IS NOT NULL AND ts IS NOT NULL AND action IN ('acquire', 'renew', 'release')").withColumn("ms", F.unix_millis("ts"))
    return sound.groupBy("node").transformWithStateInPandas(Leases(ttl), "node string, owner string, event string, ms long, seq long", "Append", "EventTime")
