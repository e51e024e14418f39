"""N-gram Jaccard join: prefix-sharing families of shingle sets, searched by T-occurrence with DivideSkip."""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U
from .components import components

WORDS_EACH, CHUNK = 5, 1 << 18
#: Links need intersection * 100 >= 75 * union; so each shares at least 3/4 of either set.
PERCENT = 75
#: Cells of the count sketch, their slices, and a count of so many times the mean that makes a shingle heavy.
CELLS, SLICES, HEAVY = 1 << 20, 256, 64
#: Documents searched together at most; larger families are searched in blocks.
BLOCK = 256
#: Shingles that two sets of a large family must share to stay in one; pairs are listed for shingles in so many sets at most.
TOGETHER, LISTED = 3, 16
#: Bits of the filter for documents whose sets are needed: 16 to 32 each, 32 MB at most; when full it only lets more through.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
#: Postings that a task gathers before it sends them on.
GATHERED = 300_000
#: Candidates probed side by side; between such steps, those joined meanwhile are dropped.
PROBED = 64
#: Sets of one component whose links are counted together: so many, or so many bytes; larger components go in pairs of parts.
LINKED, LINKED_BYTES = 1024, 8 << 20
#: Shingles in more sets than this are counted by products of matrices, others by listing the pairs that share them.
DENSE, COLUMNS = 64, 4096
UNIT = ("rep", "part", "copies", "blob", "across")
#: Weight of a binary probe against a merge step in the choice of long lists.
MU = 0.0085


def shingle_sets(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles, sorted, one row after another, and bounds (one more than rows)."""
    words, _, _, first = common.words_of(raw, offs, common.SPACED)
    runs = common.run_hashes(words, WORDS_EACH)
    out, sizes = [], np.zeros(len(offs) - 1, np.int64)
    for k, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if j - i >= WORDS_EACH:
            x = np.sort(runs[i : j - WORDS_EACH + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
        elif j > i:
            x = common.run_hashes(words[i:j], j - i)
        else:
            continue
        out.append(x)
        sizes[k] = len(x)
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def _signatures(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set; equal sets have equal ones."""
    out = []
    for salt in (0x51ED270B7A1F3C55, 0x2545F4914F6CDD1D):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(common.mix64(flat ^ U(salt)), dtype=np.uint64)))
        out.append(common.mix64(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    return out[0], out[1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _needed(n):
    return -(-PERCENT * n // 100)


# ---- sums over slices of one array, made in tasks ----


def _sliced_rows(cells: np.ndarray) -> pa.RecordBatch:
    parts = cells.reshape(SLICES, -1)
    some = np.flatnonzero(parts.any(1))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in some.tolist()], pa.binary())], names=["slice", "cells"])


def _sum_slices(rows: DataFrame, dtype: str, combine) -> list:
    """One row a slice: a bounded array, whatever the input."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(blob), dtype)
                held[k] = combine(held[k], x) if k in held else x
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], names=["slice", "cells"])

    return rows.repartition("slice").mapInArrow(run, "slice long, cells binary").collect()


def _assembled(rows: list, size: int, dtype: str) -> np.ndarray:
    out = np.zeros((SLICES, size // SLICES), dtype)
    for r in rows:
        out[r["slice"]] = np.frombuffer(zlib.decompress(bytes(r["cells"])), dtype)
    return out.reshape(-1)


# ---- pass 1: signatures and the sketch ----

SIGNED = "doc_id long, row long, n long, s1 long, s2 long, slice long, cells binary"


def _sign(docs: DataFrame) -> DataFrame:
    def run(batches):
        cells, none = np.zeros(CELLS, np.uint64), pa.nulls
        for batch in batches:
            raw, offs = common.text_buffers(batch.column("text"))
            for i, j in common.doc_ranges(offs, CHUNK):
                flat, bounds = shingle_sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                cells += np.bincount((flat >> U(44)).astype(np.int64), minlength=CELLS).astype(np.uint64)
                s1, s2 = _signatures(flat, bounds)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("row").slice(i, j - i), pa.array(np.diff(bounds)), _signed(s1), _signed(s2), none(j - i, pa.int64()), none(j - i, pa.binary())], names=["doc_id", "row", "n", "s1", "s2", "slice", "cells"])
        rows = _sliced_rows(cells)
        m = rows.num_rows
        yield pa.RecordBatch.from_arrays([*(none(m, pa.int64()) for _ in range(5)), *rows.columns], names=["doc_id", "row", "n", "s1", "s2", "slice", "cells"])

    return common.written(docs.mapInArrow(run, SIGNED))


# ---- pass 2: shared prefix shingles ----


def _length_class(n: np.ndarray) -> np.ndarray:
    """Linked sets are in the same or neighbouring classes."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(100 / PERCENT) + 1e-9).astype(np.int64)


def _share(n):
    """How many of the first shingles of a set, by one order of all, a prefix has beyond n - needed."""
    return np.maximum(1, n // 8)


def _together(n):
    """Linked sets that differ have three shingles at least and share as many."""
    return np.minimum(TOGETHER, _needed(n))


def _one(n):
    return np.ones_like(n)


def _prefixes(flat: np.ndarray, bounds: np.ndarray, s1: np.ndarray, level_of: np.ndarray, beyond) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix shingles of each different set, rarest first, with its node and length class.

    Linked sets share k of their n - needed + k first ones: k is ``beyond`` of n, the smaller one of two sets. A node is 48
    bits of the set's signature: a chance collision only makes a family larger.
    """
    sizes = np.diff(bounds)
    _, once = np.unique(s1, return_index=True)
    once = once[sizes[once] > 0]
    rank = (level_of[(flat >> U(44)).astype(np.int64)].astype(np.uint64) << U(56)) | flat >> U(8)
    many = (sizes - _needed(sizes) + beyond(sizes))[once]
    picked = [np.empty(0, np.uint64)]
    for k, m in zip(once.tolist(), many.tolist(), strict=True):
        i, j = bounds[k], bounds[k + 1]
        picked.append(flat[i + np.argsort(rank[i:j], kind="stable")[:m]])
    return np.concatenate(picked), np.repeat((s1[once] >> U(16)).astype(np.int64), many), np.repeat(_length_class(sizes[once]), many)


class _Postings:
    """Prefix shingles gathered in a task and sent on by bucket, 12 bytes each: 40 bits of the shingle, its set's node and length class.

    Heavy shingles would make buckets hot, so they aren't sent: bucket -1 has edges to nodes of their own (one for each
    length class, shared with the next), bucket -2 how many of them each set has.
    """

    def __init__(self, level_of: np.ndarray, heavy: int, buckets: int, beyond):
        self.level_of, self.heavy, self.buckets, self.beyond = level_of, heavy, buckets, beyond
        self.held, self.size = [], 0

    def add(self, flat: np.ndarray, bounds: np.ndarray, s1: np.ndarray):
        self.held.append(_prefixes(flat, bounds, s1, self.level_of, self.beyond))
        self.size += len(self.held[-1][0])
        if self.size > GATHERED:
            yield from self.flush()

    def flush(self):
        if not self.size:
            return
        token, node, size_class = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        is_heavy = self.level_of[(token >> U(44)).astype(np.int64)] >= self.heavy
        rows: list[tuple[int, bytes]] = []
        if is_heavy.any():
            t, c, k = token[is_heavy], node[is_heavy], size_class[is_heavy]
            if self.beyond is _share:
                rows.append((-2, np.stack(np.unique(c, return_counts=True), 1).tobytes()))
            else:
                t, c, k = np.concatenate((t, t)), np.concatenate((c, c)), np.concatenate((k, k + 1))
                hub = -1 - (common.mix64(t + k.astype(np.uint64)) >> U(16)).astype(np.int64)
                rows.append((-1, np.unique(np.stack((hub, c), 1), axis=0).tobytes()))
            token, node, size_class = token[~is_heavy], node[~is_heavy], size_class[~is_heavy]
        bucket = (token % U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        packed = np.empty((len(order), 12), np.uint8)
        packed[:, :5] = token[order].view(np.uint8).reshape(-1, 8)[:, 3:]
        packed[:, 5:11] = node[order].view(np.uint8).reshape(-1, 8)[:, :6]
        packed[:, 11] = size_class[order]
        rows += [(k, packed[ends[k] : ends[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(ends)).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["bucket", "blob"])


def _from_texts(docs: DataFrame, sent, heavy: int, buckets: int) -> DataFrame:
    def run(batches):
        out = _Postings(sent.value, heavy, buckets, _share)
        for batch in batches:
            raw, offs = common.text_buffers(batch.column("text"))
            for i, j in common.doc_ranges(offs, CHUNK):
                flat, bounds = shingle_sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield from out.add(flat, bounds, _signatures(flat, bounds)[0])
        yield from out.flush()

    return docs.mapInArrow(run, "bucket long, blob binary")


def _from_sets(sets: DataFrame, sent, heavy: int, buckets: int, beyond=_one) -> DataFrame:
    def run(batches):
        out = _Postings(sent.value, heavy, buckets, beyond)
        for batch in batches:
            blobs = batch.column("blob").to_pylist()
            bounds = np.concatenate(([0], np.cumsum([len(b) // 8 for b in blobs]))).astype(np.int64)
            yield from out.add(np.frombuffer(b"".join(blobs), np.uint64), bounds, np.asarray(batch.column("s1")).view(np.uint64))
        yield from out.flush()

    return sets.select("s1", "blob").mapInArrow(run, "bucket long, blob binary")


def _runs(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order of shingle and length class, and where a run of one shingle and neighbouring classes begins."""
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, 1:6] = packed[:, :5]
    wide[:, 0] = packed[:, 11]
    key = wide.view(np.uint64).reshape(-1)
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, :6] = packed[:, 5:11]
    node = wide.view(np.int64).reshape(-1)
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])  # the same set from two tasks
    key, node = key[new], node[new]
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] >> U(8) != key[:-1] >> U(8)) | (np.diff((key & U(255)).astype(np.int64)) > 1)
    return node, head


def _bucket_edges(packed: np.ndarray) -> np.ndarray:
    """Edges from the first set to every other of a run."""
    node, head = _runs(packed)
    first = node[np.flatnonzero(head)[np.cumsum(head) - 1]]
    other = first != node
    return np.unique(np.stack((np.minimum(first, node)[other], np.maximum(first, node)[other]), 1), axis=0)


def _bucket_pairs(packed: np.ndarray) -> np.ndarray:
    """Pairs of sets and how many of the bucket's shingles both have; a run of many has edges from its first set that
    count as enough."""
    node, head = _runs(packed)
    begin = np.flatnonzero(head)
    size = np.diff(np.append(begin, len(node)))
    first, many = node[np.repeat(begin, size)], np.repeat(size > LISTED, size)
    found = [(first[many], node[many], TOGETHER)]
    for k in range(2, LISTED + 1):
        rows = node[begin[size == k, None] + np.arange(k)]
        found += [(rows[:, i], rows[:, j], 1) for i in range(k) for j in range(i + 1, k)]
    a, b = (np.concatenate([f[end] for f in found]) for end in (0, 1))
    times = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
    other = a != b
    a, b, times = np.minimum(a, b)[other], np.maximum(a, b)[other], times[other]
    order = np.lexsort((b, a))
    a, b, times = a[order], b[order], times[order]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    return np.stack((a[new], b[new], np.add.reduceat(times, new) if len(new) else times), 1)


def _bucket_counts(packed: np.ndarray) -> np.ndarray:
    """For each set, how many of its shingles others in a run have too."""
    node, head = _runs(packed)
    size = np.diff(np.append(np.flatnonzero(head), len(node)))
    return np.stack(np.unique(node[np.repeat(size > 1, size)], return_counts=True), 1)


def _reduced(buckets: DataFrame, each, times: bool = False) -> DataFrame:
    """Pairs (a, b) that ``each`` makes of a bucket's postings, or that a row of bucket -1 or -2 has already.

    With ``times``, pairs have a third number, which is ``TOGETHER`` for those of bucket -1.
    """
    names = ["a", "b", *["times"] * times]

    def run(batches):
        held: list[bytes] = []
        last = None

        def flush():
            pairs = np.frombuffer(held[0], np.int64).reshape(-1, 2) if last < 0 else each(np.frombuffer(b"".join(held), np.uint8).reshape(-1, 12))
            held.clear()
            if pairs.shape[1] < len(names):
                pairs = np.insert(pairs, 2, TOGETHER, 1)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pairs.T], names=names)

        for batch in batches:
            for k, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if held and (k != last or k < 0):
                    yield flush()
                last = k
                held.append(blob)
        if held:
            yield flush()

    return buckets.repartition("bucket", F.when(F.col("bucket") < 0, F.xxhash64("blob")).otherwise(F.lit(0))).sortWithinPartitions("bucket").mapInArrow(run, ", ".join(f"{x} long" for x in names))


# ---- pass 3: the families' sets, and the search ----


def _filter(wanted: DataFrame):
    """Whether numbers are among ``wanted`` (row), as a function for tasks: each has four bits of a filter that is sent to
    all, so nothing is shuffled to tell; of a hundred thousand others some tens pass.
    """
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * wanted.count()).bit_length()))

    def places(rows: np.ndarray) -> Iterator[np.ndarray]:
        for salt in PLACES:
            yield common.mix64(rows ^ U(salt)) % U(size)

    def mark(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for at in places(np.asarray(batch.column("row")).view(np.uint64)):
                np.bitwise_or.at(bits, (at >> U(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & U(7)).astype(np.uint8)))
        yield _sliced_rows(bits)

    rows = _sum_slices(wanted.mapInArrow(mark, "slice long, cells binary"), "u1", np.bitwise_or)
    sent = wanted.sparkSession.sparkContext.broadcast(_assembled(rows, size // 8, "u1"))

    def passes(rows: np.ndarray) -> np.ndarray:
        held = np.ones(len(rows), bool)
        for at in places(rows.view(np.uint64)):
            held &= (sent.value[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8) & 1).astype(bool)
        return held

    return passes


def _only(sets: DataFrame, wanted: DataFrame, shift: int = 0) -> DataFrame:
    """``sets`` (s1, blob) whose s1, without its last ``shift`` bits, is in ``wanted`` (row), and very few others."""
    passes = _filter(wanted)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(np.asarray(batch.column("s1")).view(np.uint64) >> U(shift))))

    return sets.select("s1", "blob").mapInArrow(run, "s1 long, blob binary")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shingle sets of the rows in ``wanted`` (row), and of very few others: (s1, blob)."""
    passes = _filter(wanted)

    def run(batches):
        seen: set[int] = set()  # equal sets of a task go once
        for batch in batches:
            hit = np.flatnonzero(passes(np.asarray(batch.column("row"))))
            if not len(hit):
                continue
            some = batch.take(pa.array(hit))
            raw, offs = common.text_buffers(some.column("text"))
            for i, j in common.doc_ranges(offs, CHUNK):
                flat, bounds = shingle_sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                s1, _ = _signatures(flat, bounds)
                new = [k for k, x in enumerate(s1.tolist()) if x not in seen and not seen.add(x)]
                yield pa.RecordBatch.from_arrays([_signed(s1[new]), pa.array([flat[bounds[k] : bounds[k + 1]].tobytes() for k in new], pa.binary())], names=["s1", "blob"])

    return docs.mapInArrow(run, "s1 long, blob binary")


def merge_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """Values that at least ``need`` of the sorted ``lists`` hold, and how many do: a heap of the lists' heads, with jumps."""
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    found = []
    while len(heap) >= need:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            found.append((value, len(popped)))
            for _, k, at in popped:
                if at + 1 < len(lists[k]):
                    heapq.heappush(heap, (lists[k][at + 1], k, at + 1))
            continue
        while heap and len(popped) < need - 1:
            popped.append(heapq.heappop(heap))
        if not heap:
            break
        goal = heap[0][0]
        for _, k, at in popped:
            at = bisect_left(lists[k], goal, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))
    return found


def divide_skip(sets: list[np.ndarray], labels: list[int], parts: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join all linked ``sets`` of different ``labels``; once two groups are joined, no more between them.

    Each set, shorter ones first, is a query against the inverted lists of those before it: values must occur in T
    lists. The longest L lists are left to binary probes; a heap merge of the others finds those with T - L. With two
    ``parts``, sets of the smaller are the queries against lists of the larger, and links within a part aren't sought.
    """
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    many = len(order)
    sizes = np.array([len(sets[k]) for k in order], np.int64)
    part = np.unique([parts[k] for k in order], return_inverse=True)[1] if parts else np.zeros(many, np.int64)
    across = part.any()
    indexed = part == np.argmax(np.bincount(part))
    tokens, at = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    owner = np.repeat(np.arange(many), sizes)
    shared = (np.bincount(at)[at] > 1) & indexed[owner]
    keys = np.sort(at[shared] * many + owner[shared])
    lists = keys % many
    df = np.bincount(at[shared], minlength=len(tokens))
    begin = np.cumsum(df) - df
    upto = df.copy() if across else np.zeros(len(tokens), np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    group = np.unique([labels[k] for k in order], return_inverse=True)[1]
    links: list[tuple[int, int]] = []

    def test(x: int, which: np.ndarray, ys: np.ndarray, known: np.ndarray) -> None:
        """Links of ``x`` with ``ys``: ``known`` of each overlap, the rest by binary probes of all lists ``which``."""
        step = max(1, min(PROBED, (1 << 20) // max(1, len(which))))
        for k in range(0, len(ys), step):
            some = np.flatnonzero(group[ys[k : k + step]] != group[x]) + k
            y = ys[some]
            probes = (y[:, None] + which[None, :] * many).reshape(-1)
            hit = keys[np.minimum(np.searchsorted(keys, probes), len(keys) - 1)] == probes
            overlap = known[some] + hit.reshape(len(y), len(which)).sum(1)
            for z in y[100 * overlap >= PERCENT * (sizes[x] + sizes[y] - overlap)].tolist():
                if group[z] != group[x]:
                    links.append((order[x], order[z]))
                    group[group == group[z]] = group[x]

    for x in range(many):
        mine = at[bounds[x] : bounds[x + 1]]
        t = int(_needed(sizes[x]))
        # shorter ones can't link, nor longer ones; without parts, these come later
        first, last = int(np.searchsorted(sizes, t)), int(np.searchsorted(sizes, 100 * sizes[x] // PERCENT, "right")) if across else x
        live = mine[upto[mine] > 0]
        if last > first and len(live) >= t and not (across and indexed[x]):
            if not across:
                near = np.array(sorted({first, x - 1}))
                test(x, live, near, np.zeros(len(near), np.int64))
            if (group[first:last][indexed[first:last]] != group[x]).any():
                live = live[np.argsort(upto[live], kind="stable")]
                n_long = min(t - 1, int(t / (MU * math.log2(max(2, int(upto[live[-1]]))) + 1)))
                short, long_ = live[: len(live) - n_long], live[len(live) - n_long :]
                starts = np.maximum(np.searchsorted(keys, short * many + first), begin[short])
                lengths = np.maximum(np.searchsorted(keys, short * many + last) - starts, 0)
                which = np.repeat(np.arange(len(short)), lengths)
                values = lists[np.arange(len(which)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)]
                open_ = group[values] != group[x]
                values, ends = values[open_].tolist(), np.cumsum(np.bincount(which[open_], minlength=len(short))).tolist()
                runs = [values[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True) if j > i]
                found = np.array(merge_skip(runs, t - n_long), np.int64).reshape(-1, 2)
                test(x, long_, found[:, 0], found[:, 1])
        if not across:
            upto[mine[df[mine] > 0]] += 1
    return links


def _search(rows: DataFrame) -> DataFrame:
    """Links within each ``work`` unit of (work, rep, label, part, blob); between its parts if it has two."""

    def run(batches):
        held: dict[int, tuple[int, int, np.ndarray]] = {}  # a row of the same document again counts once
        last, out = None, []

        def search():
            labels, parts, sets = zip(*held.values(), strict=True)
            reps = list(held)
            out.extend((reps[a], reps[b]) for a, b in divide_skip(sets, labels, parts))

        for batch in batches:
            for work, rep, label, part, blob in zip(*(batch.column(k).to_pylist() for k in ("work", "rep", "label", "part", "blob")), strict=True):
                if work != last:
                    if len(held) > 1:
                        search()
                    held.clear()
                    last = work
                held[rep] = (label, part, np.frombuffer(blob, np.uint64))
        if len(held) > 1:
            search()
        pairs = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

    return rows.select("work", "rep", "label", "part", "blob").repartition("work").sortWithinPartitions("work", "rep").mapInArrow(run, "a long, b long")


def _across(members: DataFrame, block: int) -> DataFrame:
    """Work units for families in more than one component after the search in blocks: pairs of blocks that may still link.

    Blocks hold one large component's members or those of several small ones; a pair within one component is done, and
    blocks whose lengths are apart can't link. A unit of two blocks searches one against the other only. So a family of
    one large component and some others costs as many units as it has blocks; only a family of very many unlinked sets
    costs more.
    """
    spread = members.groupBy("family").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).where(f"low <> high AND size > {block}").select("family")
    left = members.join(spread, "family", "left_semi")
    sizes = left.groupBy("family", "label").agg(F.count(F.lit(1)).alias("own"))
    total = sizes.where(F.col("own") <= block).groupBy("family").agg(F.sum("own").alias("small"))
    left = left.join(sizes, ["family", "label"]).join(total, "family", "left")
    large = F.col("own") > block
    part = F.when(large, F.xxhash64("label", F.pmod(F.xxhash64("rep"), F.ceil(F.col("own") / block)))).otherwise(F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("label"), F.ceil(F.col("small") / block))))
    left = common.written(left.withColumn("part", part).withColumn("pure", F.when(large, F.col("label"))).drop("own", "small"))
    parts = left.groupBy("family", "part").agg(F.first("pure").alias("pure"), F.min("n").alias("low"), F.max("n").alias("high"))
    a, b = parts.alias("a"), parts.alias("b")
    may = (F.col("a.part") <= F.col("b.part")) & (F.coalesce(F.col("a.pure") != F.col("b.pure"), F.lit(True))) & (100 * F.col("a.high") >= PERCENT * F.col("b.low")) & (100 * F.col("b.high") >= PERCENT * F.col("a.low"))
    pairs = a.join(b, F.col("a.family") == F.col("b.family")).where(may)
    pairs = pairs.select(F.col("a.family").alias("family"), F.xxhash64("a.family", "a.part", "b.part").alias("work"), F.explode(F.array_distinct(F.array("a.part", "b.part"))).alias("part"))
    return left.join(pairs, ["family", "part"]).select("work", "rep", "label", "part")


def overlaps(sets: list[np.ndarray], many: int) -> np.ndarray:
    """How many values each of the first ``many`` sets shares with each of the others, or, if that is all, with each other."""
    whole = many == len(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    tokens, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((many, many if whole else len(sets) - many), np.int32)
    order = np.argsort(at, kind="stable")
    owner, begin = owner[order], np.cumsum(df) - df
    wide = np.flatnonzero(df > DENSE)
    for k in range(0, len(wide), COLUMNS):
        some = wide[k : k + COLUMNS]
        x = np.zeros((len(sets), len(some)), np.float32)
        column = np.repeat(np.arange(len(some)), df[some])
        x[owner[np.repeat(begin[some] - (np.cumsum(df[some]) - df[some]), df[some]) + np.arange(len(column))], column] = 1
        out += (x[:many] @ (x if whole else x[many:]).T).astype(np.int32)  # whole numbers below 2^24 stay exact
    for size in range(2, DENSE + 1):
        some = np.flatnonzero(df == size)
        for k in range(0, len(some), 1 << 14):
            rows = owner[begin[some[k : k + (1 << 14)], None] + np.arange(size)]
            for i in range(size):
                for j in range(i + 1, size):
                    a, b = rows[:, i], rows[:, j]  # ascending
                    if whole:
                        np.add.at(out, (a, b), 1)
                        np.add.at(out, (b, a), 1)
                    else:
                        apart = (a < many) & (b >= many)
                        np.add.at(out, (a[apart], b[apart] - many), 1)
    return out


def _count_links(rows: DataFrame) -> DataFrame:
    """(rep, links) in each ``work`` unit of (work, rep, part, copies, blob, across): links of each set with those of the
    other part, or of its own if not ``across``, each as often as it has copies."""

    def count(held):
        parts, whole = sorted({h[1] for h in held}), not held[0][4]
        if len(parts) == 1 and not whole:
            return  # the other part is empty
        left, right = ([h for h in held if h[1] == part] for part in (parts[0], parts[-1]))
        sets = [np.frombuffer(h[3], np.uint64) for h in (left if whole else left + right)]
        shared = overlaps(sets, len(left))
        size = np.array([len(x) for x in sets], np.int64)
        other = size if whole else size[len(left) :]
        linked = 100 * shared >= PERCENT * (size[: len(left), None] + other[None, :] - shared)
        if whole:
            np.fill_diagonal(linked, False)
        yield from zip([h[0] for h in left], (linked @ np.array([h[2] for h in right], np.int64)).tolist(), strict=True)
        if not whole:
            yield from zip([h[0] for h in right], (linked.T @ np.array([h[2] for h in left], np.int64)).tolist(), strict=True)

    def run(batches):
        held, last = {}, None
        out: list[tuple[int, int]] = []
        for batch in batches:
            for work, *row in zip(*(batch.column(k).to_pylist() for k in ("work", *UNIT)), strict=True):
                if work != last:
                    if len(held) > 1:
                        out.extend(count(list(held.values())))
                    held, last = {}, work
                held[row[0]] = row
        if len(held) > 1:
            out.extend(count(list(held.values())))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["rep", "links"])

    dealt = rows.select("work", *UNIT).repartition("work").sortWithinPartitions("work", "rep")
    return dealt.mapInArrow(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def _blobs(sets: DataFrame, units: DataFrame) -> DataFrame:
    """(rep, blob) of the sets in ``units`` (rep), and of very few others."""
    return _only(sets, units.select(F.col("rep").alias("row"))).select(F.col("s1").alias("rep"), "blob")


def _links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, links) of ``members`` (rep, root, n, copies): how many documents with other sets each set links with.

    All links lie within a component. Its sets are dealt in parts, and each pair of parts is a unit: every two sets of a
    component meet once, and their overlap is counted exactly. A unit's rows are bounded by number and bytes.
    """
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("all")).where("size > 1")
    parts = F.greatest(F.ceil(F.col("size") / LINKED), F.ceil(F.col("all") * 8 / LINKED_BYTES))
    dealt = members.join(size.select("root", parts.alias("parts")), "root").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    units = each.select(F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("work"), "rep", "part", "copies", (F.col("part") != F.col("other")).alias("across"))
    units = common.written(units)
    return _count_links(units.join(_blobs(sets, units), "rep"))


def _crowds(alive: DataFrame, family: DataFrame) -> DataFrame:
    """(family, node, size) of the families of two sets or more; size is how many sets."""
    size = alive.join(family, "node").groupBy("family").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return common.written(family.join(size, "family"))


def _classes(docs: DataFrame, block: int, links: bool = False) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, row: a hash of both): doc_id, row, n, and root, which rows of one component share.

    With ``links``, also n_links: how many other rows with words it links with, those of an equal set included.

    Equal sets are one class; its id is 64 bits of the set's signature, as long as a shingle's hash. Without words
    (n = 0) ``root`` means nothing.
    """
    spark = docs.sparkSession
    signed = _sign(docs)
    cells = _assembled(_sum_slices(signed.where("slice IS NOT NULL").select("slice", "cells"), "u8", np.add), CELLS, "u8")
    scale = max(1.0, float(cells.mean()))
    sent = spark.sparkContext.broadcast(np.minimum(255, 4 * np.log2(1 + cells / scale)).astype(np.uint8))  # a megabyte
    heavy = int(4 * math.log2(1 + HEAVY))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    # rows without words all have one signature; they are spread, as they meet nothing
    signs = signed.where("slice IS NULL").select("doc_id", "row", "n", F.when(F.col("n") > 0, F.col("s1")).otherwise(F.col("row")).alias("s1"), "s2")
    classes = common.written(signs.where("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("row"), F.first("n").alias("n")))
    # a set that shares too few of its wide prefix with all others together links with none
    shared = _reduced(_from_texts(docs.drop("row"), sent, heavy, buckets), _bucket_counts).groupBy("a").agg(F.sum("b").alias("shared"))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PERCENT / 100) / 8))
    alive = classes.withColumn("node", F.shiftrightunsigned("s1", 16)).join(shared, F.col("node") == F.col("a")).where(F.col("shared") >= least).select("row", "n", "s1", "node")
    alive = common.written(alive)
    sets = common.written(_sets(docs.select("row", "text"), alive.select("row")))
    few = 1 + buckets // 4
    family = common.written(components(_reduced(_from_sets(sets, sent, heavy, few), _bucket_edges)).select("node", F.col("root").alias("family")))
    crowd = _crowds(alive, family)
    if crowd.where(F.col("size") > block).limit(1).count():
        # a family may be a chain of sets that share one shingle each with the next; in a large one pairs must share more
        large = common.written(crowd.where(F.col("size") > block).select("node"))
        again = _reduced(_from_sets(_only(sets, large.select(F.col("node").alias("row")), 16), sent, heavy, few, _together), _bucket_pairs, times=True)
        pairs = again.groupBy("a", "b").agg(F.sum("times").alias("times")).where(F.col("times") >= TOGETHER)
        within = components(pairs).select("node", F.col("root").alias("family"))
        crowd = _crowds(alive, common.written(crowd.where(F.col("size") <= block).select("node", "family").unionByName(within.join(large, "node", "left_semi"))))
    members = common.written(alive.join(crowd, "node").select("family", "size", F.col("s1").alias("rep"), "n"))
    blobs = sets.select(F.col("s1").alias("rep"), "blob")

    blocks = F.ceil(F.col("size") / block)
    twice = F.when(blocks == 1, F.array(F.xxhash64("family"))).otherwise(F.array(*(F.xxhash64("family", F.lit(salt), F.pmod(F.xxhash64("rep", F.lit(salt)), blocks)) for salt in (1, 2))))
    # units are written before they meet the sets: while their files are small, these are shuffled once, by unit
    units = common.written(members.select("rep", F.col("rep").alias("label"), F.lit(0).cast("long").alias("part"), F.explode(twice).alias("work")))
    joined = common.written(_search(units.join(blobs, "rep")))
    label = common.written(components(joined))
    if crowd.where(F.col("size") > block).limit(1).count():
        known = members.where(F.col("size") > block).join(label.select(F.col("node").alias("rep"), F.col("root").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        units = common.written(_across(known, block))
        more = common.written(_search(units.join(_blobs(sets, units), "rep")))
        if more.limit(1).count():
            label = common.written(components(joined.unionAll(more)))
    more = []
    if links:
        copies = common.written(signs.where("n > 0").groupBy(F.col("s1").alias("rep")).agg(F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")))
        inside = common.written(label.select(F.col("node").alias("rep"), "root").join(copies, "rep"))
        found = copies.join(_links(inside, sets), "rep", "left").select(F.col("rep").alias("s1"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        classes, more = classes.join(common.written(found), "s1", "left"), ["n_links"]
    classes = classes.join(label.select(F.col("node").alias("s1"), "root"), "s1", "left").select("s1", "s2", F.coalesce("root", "s1").alias("root"), *more)
    more = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []
    return signs.join(classes, ["s1", "s2"], "left").select("doc_id", "row", "n", F.coalesce("root", "row").alias("root"), *more)


def _with_row(docs: DataFrame) -> DataFrame:
    return common.spread(common.keyed(docs)).withColumn("row", F.xxhash64("doc_id", "text"))


def _looked_up(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` (root, row, ...) with the values of their root in ``table`` (root, size: how many rows have it, ...), or nulls.

    Roots with over a thousandth of all rows, fewer than a thousand, are sent to all tasks; only rows of others are
    shuffled by their root, the rest is spread by ``row``.
    """
    values = F.struct(*(c for c in table.columns if c not in ("root", "size")))
    total = table.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).collect()[0]["n"]
    hot = F.col("size") * 1000 > total
    near = rows.join(F.broadcast(table.where(hot).select("root", values.alias("hot"))), "root", "left")
    near = near.withColumn("key", F.when(F.col("hot").isNull(), F.col("root")).otherwise(F.col("row")))
    far = near.join(table.where(~hot).select(F.col("root").alias("key"), values.alias("cold")), "key", "left")
    return far.withColumn("found", F.coalesce("hot", "cold")).select(*rows.columns, "found.*")


def jaccard_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id it reaches by links, itself included), n_links (how many
    other rows it links with, equal texts included; every link between different texts is verified).

    Searched are only sets that share enough with all others together, in families that share prefix shingles.
    Rows without words, null or empty, are linked with nothing and have their own doc_id. Equal texts are one class
    and link whatever they are, and so do repeated rows; rows of one doc_id with different texts link by their texts.
    A null doc_id links like others, but names a component only where all its ids are null. An empty table gives an
    empty result; further columns are left out, whatever their names.
    """
    rows = common.written(_classes(_with_row(docs), block, links=True))
    names = common.written(rows.where("n > 0").groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("component")))
    return _looked_up(rows, names).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "n_links")


def one_each(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component kept, one of the smallest doc_id (a null one only if all are); all columns.

    Rows without words all stay, repeated ones too. Of several texts with the smallest doc_id that of the smallest hash
    stays. Texts are shuffled for rows that may go, or that are repeated, alone.
    """
    rows = common.written(_classes(_with_row(docs), block).where("n > 0"))
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")
    kept = rows.groupBy("root").agg(F.min(order).alias("kept"), F.count(F.lit(1)).alias("size")).where("size > 1").select("root", "size", F.col("kept.doc_id").alias("kept_id"), F.col("kept.row").alias("kept_row"))
    each = rows.groupBy("root", "doc_id", "row").agg(F.count(F.lit(1)).alias("times"))
    stays = (F.col("row") == F.col("kept_row")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    marks = common.written(_looked_up(each, common.written(kept)).where("kept_row IS NOT NULL").withColumn("stays", stays).where("NOT stays OR times > 1").select("doc_id", F.col("row").alias("k"), "stays"))
    row, name, k, mark = (common.fresh(docs, x) for x in ("row", "mark_id", "mark_row", "mark_stays"))
    own = F.col("doc_id").cast("long")
    keyed = docs.withColumn(row, F.xxhash64(own, F.coalesce(F.col("text").cast("string"), F.lit(""))))
    sure, rest = common.divided(keyed, F.col(row), marks.select("k"))
    rest = rest.join(marks.select(F.col("doc_id").alias(name), F.col("k").alias(k), F.col("stays").alias(mark)), (F.col(row) == F.col(k)) & own.eqNullSafe(F.col(name)), "left")
    first = rest.where(F.col(mark)).dropDuplicates(["doc_id", row])
    return sure.unionAll(rest.where(F.col(mark).isNull()).select(keyed.columns)).unionAll(first.select(keyed.columns)).select(docs.columns)


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents; nulls, ties, repeats and empty tables as in ``jaccard_groups``."""
    return jaccard_groups(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, coalesce(k.k, 0) AS n_links
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) k ON d.doc_id = k.a JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON d.doc_id = c.a
"""
