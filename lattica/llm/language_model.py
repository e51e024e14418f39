"""LM scoring: deleted interpolation of bigrams, words and a uniform share, mixed by how often the context occurs."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U

#: Bytes of text a chunk is meant to have, and bits of a bigram's key beyond those that number the tokens.
CHUNK, SPARE_BITS = 4 << 20, 14
#: Bytes of text whose keys a bucket is meant to have.
BUCKET = 8 << 20
#: Documents whose crc32 has these remainders mod 10: never learnt from; learnt from, and their counts deleted for the weights.
FOLDS, HELD_OUT, DELETED = 10, 0, 1
START, END = U(0x9B1D5A7E3C2F4E61), U(0x5F3A9C1D7E2B4680)
WORD, PAIR = 0, 1
#: Context-frequency buckets: none, then by powers of two; ratios to the uniform share by half powers of two.
BUCKETS, STEPS, LOWEST = 24, 96, -8


def remainder() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


class Chunk:
    """Tokens of some documents: each word and one end; unique keys of tokens and of pairs with the token before."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, bits: int):
        words, _, _, first = common.words_of(raw, offs, common.SPACED)
        n = len(offs) - 1
        self.bounds = first + np.arange(n + 1)  # with an end for each document
        ends = self.bounds[1:] - 1
        tokens = np.insert(words, first[1:], END) if n else words
        before = np.empty(len(tokens), np.uint64)
        before[1:] = tokens[:-1]
        before[self.bounds[:-1]] = START
        self.starts, self.ends = self.bounds[:-1], ends
        pairs = common.mix64(before * U(0xD6E8FEB86659FD93) + tokens) >> U(64 - bits)
        self.keys, self.at = [None, None], [None, None]
        for kind, x in ((WORD, tokens), (PAIR, pairs)):
            self.keys[kind], self.at[kind] = np.unique(x, return_inverse=True)

    def counts(self, kind: int, learnt: np.ndarray) -> np.ndarray:
        """Occurrences of each unique key in the documents that are ``learnt`` from."""
        weight = np.repeat(learnt, np.diff(self.bounds))
        return np.bincount(self.at[kind], weight, len(self.keys[kind])).astype(np.int64)


def _bucket_bits(buckets: int) -> int:
    return (buckets - 1).bit_length()


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes, as many as the largest needs, compressed."""
    wide = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)
    n = 8
    while n > 1 and not wide[:, n - 1].any():
        n -= 1
    return zlib.compress(bytes([n]) + np.ascontiguousarray(wide[:, :n].T).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    data = zlib.decompress(blob)
    n = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(n, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :n] = planes.T
    return wide.view("<u8").reshape(-1)


SENT = "bucket long, kind long, chunk long, keys binary, counts binary"


def _shift(kind: int, bits: int, buckets: int) -> int:
    return (64 if kind == WORD else bits) - _bucket_bits(buckets)


def _count(docs: DataFrame, bits: int, buckets: int) -> DataFrame:
    """Unique keys of each chunk with their counts, in buckets by their first bits.

    Rows of a chunk follow each other; where a split cuts a chunk, its keys come in two parts.
    """

    def run(batches):
        held, last = [], None

        def counted():
            raw = np.concatenate([p[0] for p in held])
            sizes = np.concatenate([np.diff(p[1]) for p in held])
            data = Chunk(raw, np.concatenate(([0], np.cumsum(sizes))), bits)
            learnt = np.concatenate([p[2] for p in held])
            held.clear()
            for kind in (WORD, PAIR):
                keys, counts = data.keys[kind], data.counts(kind, learnt)
                bucket = (keys >> U(_shift(kind, bits, buckets))).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(cuts))
                deltas = np.diff(keys, prepend=U(0))
                rows = []
                for b in some.tolist():
                    part = deltas[cuts[b] : cuts[b + 1]].copy()
                    part[0] = keys[cuts[b]] & U((1 << _shift(kind, bits, buckets)) - 1)
                    rows.append((b, kind, last, _pack(part), _pack(counts[cuts[b] : cuts[b + 1]])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.binary()] * 2, strict=True)], names=[f.split()[0] for f in SENT.split(", ")])

        for batch in batches:
            chunk = np.asarray(batch.column("chunk"))
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)] if len(chunk) else []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and chunk[i] != last:
                    yield from counted()
                last, some = int(chunk[i]), batch.slice(i, j - i)
                held.append((*common.text_buffers(some.column("text")), np.asarray(some.column("learnt").to_numpy(zero_copy_only=False), float)))
        if held:
            yield from counted()

    return docs.select("chunk", "learnt", "text").mapInArrow(run, SENT)


ANSWER = "chunk long, kind long, bucket long, counts binary, tokens long, types long"


def _answer(sent: DataFrame) -> DataFrame:
    """Corpus counts of each chunk's keys in their order; one more row a bucket has its tokens and types."""

    def run(batches):
        held, last = [], None

        def flush():
            parts: dict[int, list[np.ndarray]] = {}
            for c, k, _ in held:
                parts.setdefault(c, []).append(np.cumsum(_unpack(k)))
            counts = np.concatenate([_unpack(n) for _, _, n in held]).astype(np.int64)
            every = np.concatenate([np.cumsum(_unpack(k)) for _, k, _ in held])
            held.clear()
            unique, at = np.unique(every, return_inverse=True)
            total = np.zeros(len(unique), np.int64)
            np.add.at(total, at, counts)
            bucket, kind = last
            rows = []
            for c, keys in parts.items():
                mine = keys[0] if len(keys) == 1 else np.unique(np.concatenate(keys))
                rows.append((c, kind, bucket, _pack(total[np.searchsorted(unique, mine)]), None, None))
            rows.append((-1, kind, bucket, None, int(total.sum()), int((total > 0).sum())))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 2, strict=True)], names=[f.split()[0] for f in ANSWER.split(", ")])

        for batch in batches:
            for bucket, kind, chunk, keys, counts in zip(*(batch.column(k).to_pylist() for k in ("bucket", "kind", "chunk", "keys", "counts")), strict=True):
                if held and (bucket, kind) != last:
                    yield flush()
                last = (bucket, kind)
                held.append((chunk, keys, counts))
        if held:
            yield flush()

    return common.written(sent.repartition("bucket", "kind").sortWithinPartitions("bucket", "kind").mapInArrow(run, ANSWER))


class _Counted:
    """A chunk with corpus counts of its tokens, their contexts and their pairs."""

    def __init__(self, docs: pa.Table, answers: pa.Table, bits: int, n_docs: int):
        data = Chunk(*common.text_buffers(docs.column("text")), bits)
        rows = sorted(zip(*(answers.column(k).to_pylist() for k in ("kind", "bucket", "counts")), strict=True))
        of = [np.concatenate([_unpack(n) for k, _, n in rows if k == kind] or [np.empty(0, np.uint64)]).astype(np.int64) for kind in (WORD, PAIR)]
        if any(len(of[k]) != len(data.keys[k]) for k in (WORD, PAIR)):
            raise ValueError("a chunk has other documents than when it was counted: the input or its splits changed meanwhile")
        self.bounds = data.bounds
        self.word, self.pair = of[WORD][data.at[WORD]], of[PAIR][data.at[PAIR]]
        self.context = np.empty(len(self.word), np.int64)
        self.context[1:] = self.word[:-1]
        self.context[data.starts] = n_docs


def _context_bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _step(share: np.ndarray, uniform: float) -> np.ndarray:
    """Half powers of two of the ratio to the uniform share, from 1; 0 for nothing."""
    at = np.floor(2 * (np.log2(np.maximum(share, 1e-300) / uniform) - LOWEST)).astype(np.int64)
    return np.where(share > 0, np.clip(at, 1, STEPS - 1), 0)


def learn_weights(cells: dict[int, int], rounds: int = 60) -> np.ndarray:
    """Weights of pair, word and uniform share for each context bucket, by expectation-maximisation over deleted counts.

    ``cells``: how often each (bucket, step of the pair's share, step of the word's share) occurs.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]
    if not cells:
        return weights
    at, n = np.array(list(cells), np.int64), np.array(list(cells.values()), float)
    bucket, pair, word = at // STEPS**2, at // STEPS % STEPS, at % STEPS
    share = np.stack([np.where(x > 0, 2.0 ** ((x + 0.5) / 2 + LOWEST), 0) for x in (pair, word)] + [np.ones(len(at))], 1)
    for _ in range(rounds):
        part = weights[bucket] * share
        part *= (n / np.maximum(part.sum(1), 1e-300))[:, None]
        new = np.stack([np.bincount(bucket, part[:, k], BUCKETS) for k in range(3)], 1) + 1e-3 * weights
        weights = new / new.sum(1, keepdims=True)
        weights[0] = [0, weights[0, 1] + weights[0, 0] / 2, weights[0, 2] + weights[0, 0] / 2]
    return weights


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod 10 is not 0.

    A null or empty text is its end alone; a null doc_id counts as no text in the crc; repeated rows are scored, and
    learnt from, each; an empty table gives an empty result; further columns are left out, whatever their names. Rows
    are dealt to chunks of about ``chunk_bytes`` and written so, which holds whatever becomes of the splits. No table of
    words or pairs is held whole anywhere: each chunk asks for the counts of its own, by buckets of keys.
    """
    spark = docs.sparkSession
    docs = common.spread(common.keyed(docs))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.sum((remainder() != HELD_OUT).cast("long")), F.lit(0)).alias("learnt")).collect()[0]
    each = max(1, math.ceil(size["bytes"] / max(1, docs.rdd.getNumPartitions()) / chunk_bytes))
    few = -(-each // FOLDS)  # chunks of the deleted fold
    buckets = 1 << max((2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length(), (int(size["bytes"]) // BUCKET).bit_length())
    bits = min(64, max(32, _bucket_bits(buckets) + 8, int(size["bytes"] // 4 + 2).bit_length() + SPARE_BITS))
    hashed = F.xxhash64("doc_id", "text")
    part = F.when(remainder() == DELETED, F.pmod(hashed, F.lit(few))).otherwise(few + F.pmod(hashed, F.lit(each)))
    docs = docs.withColumn("learnt", remainder() != HELD_OUT).withColumn("chunk", F.spark_partition_id().cast("long") * (each + few) + part)
    docs = common.written(docs.sortWithinPartitions("chunk"), compression="zstd")
    answers = _answer(_count(docs, bits, buckets))
    totals = answers.where(f"chunk < 0 AND kind = {WORD}").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).collect()[0]
    n, v, n_docs = int(totals["n"]), int(totals["v"]), int(size["learnt"])
    uniform = 1 / (v + 1)
    asked = answers.where("chunk >= 0").select("chunk", "kind", "bucket", "counts")

    def deleted(left: pa.Table, right: pa.Table) -> pa.Table:
        cells = np.empty(0, np.int64)
        if left.num_rows:
            c = _Counted(left, right, bits, n_docs)
            pair = np.where(c.context > 1, (c.pair - 1) / np.maximum(c.context - 1, 1), 0)
            word = (c.word - 1) / max(1, n - 1)
            cells = (_context_bucket(c.context - 1) * STEPS + _step(pair, uniform)) * STEPS + _step(word, uniform)
        cell, count = np.unique(cells, return_counts=True)
        return pa.table({"cell": pa.array(cell), "n": pa.array(count.astype(np.int64))})

    fold = docs.where(remainder() == DELETED).select("chunk", "text").groupBy("chunk")
    cells = fold.cogroup(asked.where(F.col("chunk") % (each + few) < few).groupBy("chunk")).applyInArrow(deleted, "cell long, n long")
    found = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # at most BUCKETS * STEPS * STEPS
    weights = learn_weights(found)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        c = _Counted(left, right, bits, n_docs)
        mix = weights[_context_bucket(c.context)]
        p = mix[:, 0] * c.pair / np.maximum(c.context, 1) + mix[:, 1] * c.word / max(1, n) + mix[:, 2] * uniform
        base = np.log10((c.word + 0.1) / (n + 0.1 * (v + 1)))
        start = c.bounds[:-1]
        sums = [np.add.reduceat(x, start) if len(start) else np.empty(0) for x in (base, np.log10(p), (c.word > 0).astype(np.int64))]
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(np.diff(c.bounds)), "n_known": pa.array(sums[2], pa.int64()), "train_tokens": pa.array(np.full(len(start), n)), "base_score": pa.array(sums[0], pa.float64()), "score": pa.array(sums[1], pa.float64())})

    every = docs.select("chunk", "doc_id", (~F.col("learnt")).alias("held_out"), "text").groupBy("chunk")
    return every.cogroup(asked.groupBy("chunk")).applyInArrow(score, SCORES)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the interpolated model and by the base one; edge cases as in ``score_texts``."""
    return score_texts(common.table(spark, sf_dir, "documents"))
