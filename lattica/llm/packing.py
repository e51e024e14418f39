"""Packing: shortest-pack-first over the histogram of lengths, joined back to documents by rank."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, vocab

SEQUENCE = 1024


def pack_histogram(histogram: Mapping[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many packs have each; longest lengths go first, each into the shortest pack with room.

    At most ``size`` lengths and a few times as many patterns: small whatever the corpus.
    """
    packs: dict[int, Counter] = {}
    room: list[int] = []  # sorted keys of packs

    def put(left: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            if left not in packs:
                packs[left] = Counter()
                insort(room, left)
            packs[left][pattern] += n

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            if room and room[-1] >= length:
                left = room[-1]
                pattern = next(iter(packs[left]))
                have = packs[left].pop(pattern)
                if not packs[left]:
                    del packs[left], room[bisect_left(room, left)]
                each = min(left // length, max(1, n // have))  # as if one after another: the shortest takes the next too
                use = min(have, n // each)
                put(left - each * length, tuple(sorted(pattern + (length,) * each, reverse=True)), use)
                put(left, pattern, have - use)
                n -= use * each
            else:
                each = size // length
                put(size - each * length, (length,) * each, n // each)
                if n % each:
                    put(size - n % each * length, (length,) * (n % each), 1)
                n = 0
    return [(pattern, n) for left in room for pattern, n in packs[left].items()]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of ranks: first rank, pieces of that length a sequence, first sequence, offset of the first."""
    out: dict[int, list[tuple[int, ...]]] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length, times in sorted(Counter(pattern).items(), reverse=True):
            out.setdefault(length, []).append((used[length], times, sequence, offset))
            used[length] += n * times
            offset += length * times
        sequence += n
    return {length: tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) for length, runs in out.items()}


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, part_rank long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, with_ids: bool) -> DataFrame:
    """Documents cut into pieces of ``size`` ids and a rest; ``part_rank`` counts pieces of a length within a partition."""

    def run(batches):
        common.released()
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            names = batch.column("doc_id")
            for i, j, ids, bounds in vocab.encoded(batch, tokenizer, end_id):
                total = np.diff(bounds)
                per = -(-total // size)
                doc = np.repeat(np.arange(j - i), per)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * size
                length = np.minimum(size, total[doc] - start)
                at = bounds[doc] + start
                flat = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                by_length = length[order]
                new = np.concatenate(([True], by_length[1:] != by_length[:-1])) if len(order) else np.empty(0, bool)
                head = np.flatnonzero(new)
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order)))) + seen[by_length]
                seen += np.bincount(length, minlength=size + 1)
                cols = [start, length, np.array(sums, np.int64), total[doc], np.full(len(doc), part), rank]
                out = [names.take(pa.array(i + doc)), *(pa.array(c, pa.int64()) for c in cols)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids)

    return common.spread(common.keyed(docs)).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str = vocab.SPACED_WORDS, end_id: int = 0, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Packs the ids of all documents into sequences of at most ``size`` ids; one row a piece, with its ids if wanted.

    A null or empty text is a document of its end id alone; a null doc_id stays null. Every row of ``docs`` is packed,
    repeated ones too; ties in length are ranked by partition and place, which any rerun repeats from the written
    pieces. An empty table gives an empty result; further columns are left out, whatever their names. A sequence's rows
    fill it without gaps from offset 0.
    """
    cut = common.written(pieces(docs, tokenizer, end_id, size, with_ids))
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = common.written(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    runs = slots(pack_histogram(histogram, size))
    # a row for each partition and length: grows with the input, so it is never broadcast
    ranked = cut.join(counts.drop("n").hint("merge"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("part_rank"))
    names = [c.split()[0] for c in PLACED.split(", ")][:5] + ["ids"] * with_ids

    def place(batches):
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                mine = length == n
                first, times, where, begin = runs[n]
                k = np.searchsorted(first, rank[mine], "right") - 1
                inside = rank[mine] - first[k]
                sequence[mine] = where[k] + inside // times[k]
                offset[mine] = begin[k] + inside % times[k] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = PLACED.replace(", sequence_id", ", ids array<int>, sequence_id") if with_ids else PLACED
    return ranked.select(*names, "rank").mapInArrow(place, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids; nulls, repeated rows and empty tables as in ``pack``."""
    return pack(common.table(spark, sf_dir, "documents"))
