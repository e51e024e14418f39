"""Shared helpers: scratch tables, Arrow text access and vectorised word kernels."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.scratch import path as scratch_path  # noqa: F401
from lattica.scratch import written  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Inputs of less than so many bytes a core are dealt anew: a single row group of theirs would run in one task.
SMALL = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores; a small input is dealt by hash, as its splits may hold nothing (row groups aren't split)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores:
        return df
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores, *(F.xxhash64(c) for c in df.columns[:2])) if size < SMALL * cores else df


def released() -> None:
    """Gives memory that earlier tasks of this worker have freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """Only the columns an operator reads, so further columns can't clash; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filtered(docs: DataFrame, judge: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """The rows of ``docs`` whose text is kept, all columns as they are, in the same pass: nothing is shuffled.

    ``judge()`` is made once a task; it takes texts as bytes and offsets (null is empty) and gives a mask.
    """
    at, limit = docs.columns.index("text"), 1 << 18

    def run(batches):
        keeps = judge()
        for batch in batches:
            raw, offs = text_buffers(batch.column(at))
            masks = [keeps(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in doc_ranges(offs, limit)]
            yield batch.filter(pa.array(np.concatenate(masks) if masks else np.empty(0, bool)))

    return docs.mapInArrow(run, docs.schema)


#: Bits of one bitmap, and how many of these are sent to all tasks at most: 16 MB.
BITMAP, BITMAPS = 32768, 4096


def divided(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows whose ``key`` (long) is surely not in ``keys`` (long, ``k``), and the rest, with all that are.

    Only the rest has to be shuffled to meet a table by its key; beyond some eight million keys it grows until it is
    all. By bitmaps of hashes and SQL functions alone.
    """
    many = 1 << min(BITMAPS.bit_length() - 1, (16 * keys.count() // BITMAP).bit_length())
    b, bits, h = (fresh(docs, x) for x in ("bitmap_no", "bitmap", "bitmap_place"))
    place = F.pmod(F.xxhash64("k"), F.lit(many * BITMAP))
    held = keys.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias(b)).agg(F.bitmap_construct_agg(F.col("p") % BITMAP).alias(bits))
    placed = docs.withColumn(h, F.pmod(F.xxhash64(key), F.lit(many * BITMAP)))
    joined = placed.join(F.broadcast(held), F.shiftright(F.col(h), 15) == F.col(b), "left")  # at most BITMAPS rows of 4 KB
    inside = F.col(h) % BITMAP
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(inside, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << x) for x in range(8))), (inside % 8 + 1).cast("int"))) > 0, F.lit(False))
    return joined.where(~hit).select(docs.columns), joined.where(hit).select(docs.columns)


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (one more than rows) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(col) else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def doc_ranges(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row that alone is longer."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _byte_class(separators: list[int]) -> np.ndarray:
    word = np.ones(256, bool)
    word[separators] = False
    return word


#: Bytes that belong to words split at ASCII white space.
SPACED = _byte_class([0x20, *range(0x09, 0x0E)])
#: Bytes of words made of digits, letters (after lower-casing) and everything beyond ASCII.
LETTERS = _byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(0x9E3779B97F4A7C15)
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
U = np.uint64


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def word_bounds(raw: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``raw``, and for each row the index of its first word (one more than rows)."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    inside = member[raw]
    edge = offs[(offs > 0) & (offs < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offs)


#: Bytes of text whose words are found and hashed at once: what is held besides a text is some forty times this.
PIECE = 1 << 20


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running polynomial sum; longer ones than a piece from their parts' sums."""
    up, down = _power_tables(min(len(raw), PIECE) + 1)
    if len(raw) <= PIECE:
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends[i:], base + PIECE, "right")) + i
        if j > i:
            out[i:j] = span_hashes(raw[base : int(ends[j - 1])], starts[i:j] - base, ends[i:j] - base)
        else:
            total, stop, j = 0, int(ends[i]), i + 1
            for k in range(base, stop, PIECE):
                part = raw[k : min(k + PIECE, stop)]
                total += int((_BYTE[part] * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, k - base, 2**64)
            out[i] = mix64(np.array([(total + stop - base) % 2**64], np.uint64))[0]
        i = j
    return out


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes; the last k-1 entries are missing."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    m = len(words) - k + 1
    acc = words[:m].copy()
    for j in range(1, k):
        acc *= U(0xD6E8FEB86659FD93)
        acc += words[j : j + m]
    return mix64(acc + U(k))


def _cuts(raw: np.ndarray, offs: np.ndarray, member: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about ``PIECE`` bytes that end at a row's end or where no word goes on."""
    low, n = 0, len(raw)
    while low < n:
        high = min(low + PIECE, n)
        edge = int(offs[np.searchsorted(offs, high, "left")])  # the end of the row that the piece stops in
        while high < edge:
            gap = ~member[LOWER[raw[high : min(high + 4096, edge)]]]
            if gap.any():
                high += int(gap.argmax())
                break
            high += len(gap)
        yield low, high
        low = high


def words_of(raw: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes after lower-casing A-Z, with starts, ends and each row's first word.

    Long texts are read in pieces, so a text of any length takes little more than these four, 24 bytes a word.
    """
    columns: tuple[list[np.ndarray], ...] = ([np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)])
    for a, b in _cuts(raw, offs, member):
        low = LOWER[raw[a:b]]
        rows = offs[max(0, int(np.searchsorted(offs, a)) - 1) : int(np.searchsorted(offs, b, "right")) + 1]
        starts, ends, _ = word_bounds(low, np.clip(rows - a, 0, b - a), member)
        for column, values in zip(columns, (span_hashes(low, starts, ends), starts + a, ends + a), strict=True):
            column.append(values)
    out = []
    for column in columns:
        out.append(column[1] if len(column) == 2 else np.concatenate(column))
        column.clear()
    return *out, np.searchsorted(out[1], offs)
