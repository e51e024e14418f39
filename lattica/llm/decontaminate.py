"""Benchmark decontamination: suffix arrays over shards of the training words, searched for every benchmark suffix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of a window, bytes of a shard of documents and of a block of benchmark texts, pairs compared at once.
WINDOW, SHARD, BLOCK, PAIRS = 10, 1 << 20, 8 << 20, 1 << 20
#: Words that begin a suffix worth sorting: those of no window can't begin a match.
LEAD = 3
MATCH = "array<struct<start:long,length:long,item_id:long>>"
_MATCHES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item_id", pa.int64())]))


def _keys(words: np.ndarray, at: np.ndarray, n: int, wide: int, fill: int) -> np.ndarray:
    """The first ``n`` words from each place as bytes that sort as the words do, filled up to ``wide`` words."""
    out = np.full((len(at), 8 * wide), fill, np.uint8)
    for k in range(n):
        out[:, 8 * k : 8 * k + 8] = words[at + k].astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view(f"S{8 * wide}").reshape(-1)


class _Size:
    """The windows of one length: where each lies in the items' words, grouped by what it says."""

    def __init__(self, words: np.ndarray, at: np.ndarray, n: int):
        self.n, self.lead = n, min(n, LEAD)
        says = common.run_hashes(words, n)[at]
        _, first, self.kind, times = np.unique(says, return_index=True, return_inverse=True, return_counts=True)
        self.one = at[first]  # a place of each different window
        self.at = at[np.argsort(self.kind, kind="stable")]
        self.bounds = np.concatenate(([0], np.cumsum(times)))
        self.begins = common.run_hashes(words, self.lead)[self.one]


class Suffixes:
    """The suffixes of a block of benchmark items, each cut to a window; searched in suffix arrays of documents."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window, self.ids = window, np.array([i for i, _ in items], np.int64)
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        self.words, _, _, first = common.words_of(*common.text_buffers(texts), common.LETTERS)
        sizes = np.diff(first)
        self.item = np.repeat(np.arange(len(items)), sizes)
        self.sizes = []
        for n in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
            if n < window:
                at = first[:-1][sizes == n]
            else:
                at = np.flatnonzero(np.arange(len(self.words)) + window <= first[self.item + 1])
            self.sizes.append(_Size(self.words, at, n))
        #: what the window at a place of the items says, one place to the right so that none is before the first
        self.says = np.full(len(self.words) + 2, -1, np.int64)
        if self.sizes and self.sizes[-1].n == window:
            last = self.sizes[-1]
            self.says[last.at + 1] = np.repeat(np.arange(len(last.one)), np.diff(last.bounds))

    def occurrences(self, words: np.ndarray, first: np.ndarray) -> list[tuple[_Size, np.ndarray, np.ndarray]]:
        """For each length, where in the words of a shard a window stands whole within a document, and which."""
        runs = {lead: common.run_hashes(words, lead) for lead in {s.lead for s in self.sizes}}
        begins = {lead: np.unique(np.concatenate([s.begins for s in self.sizes if s.lead == lead])) for lead in runs}
        begin, asked = np.zeros(len(words), bool), {}
        for lead, known in begins.items():
            at = np.minimum(np.searchsorted(known, runs[lead]), len(known) - 1)
            hit = known[at] == runs[lead]
            begin[: len(hit)] |= hit
            asked[lead] = np.unique(runs[lead][hit])
        places = np.flatnonzero(begin)
        if not len(places):
            return []
        keys = _keys(np.concatenate((words, np.zeros(self.window, np.uint64))), places, self.window, self.window, 0)
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        out = []
        for s in self.sizes:
            some = np.flatnonzero(np.isin(s.begins, asked[s.lead]))
            low = np.searchsorted(keys, _keys(self.words, s.one[some], s.n, self.window, 0))
            high = np.searchsorted(keys, _keys(self.words, s.one[some], s.n, self.window, 255), "right")
            many = high - low
            which = np.repeat(some, many)
            p = places[np.arange(len(which)) + np.repeat(low - (np.cumsum(many) - many), many)]
            whole = p + s.n <= first[np.searchsorted(first, p, "right")]
            p, which = p[whole], which[whole]
            order = np.argsort(p)
            out.append((s, p[order], which[order]))
        return out

    def cover(self, found: list, n_words: int) -> np.ndarray:
        """Which words of a shard lie inside an occurrence."""
        marks = np.zeros(n_words + 1, np.int64)
        for s, p, _ in found:
            marks[p] += 1  # a place has one window of a length
            marks[p + s.n] -= 1
        return np.cumsum(marks[:-1]) > 0

    def matches(self, found: list, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Longest verbatim matches: document, first word in it, number of words, item, in that order.

        Windows that follow each other in text and item are one match, so only the first and last of each such run are
        kept; pairs of places are looked at in parts, as a text that repeats itself has many.
        """
        out = []
        for s, p, which in found:
            says = np.full(int(first[-1]) + 2, -1, np.int64)
            if s.n == self.window:
                says[p + 1] = which
            times = np.diff(s.bounds)[which]
            total = np.concatenate(([0], np.cumsum(times)))
            heads, tails = [], []
            i = 0
            while i < len(p):
                j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")) - 1)
                text = np.repeat(p[i:j], times[i:j])
                place = s.at[np.arange(len(text)) + np.repeat(s.bounds[which[i:j]] - (total[i:j] - total[i]), times[i:j])]
                for kept, step in ((heads, -1), (tails, 1)):
                    near = says[text + 1 + step]
                    end = (near < 0) | (self.says[place + 1 + step] != near) if s.n == self.window else np.ones(len(text), bool)
                    kept.append(np.stack((text[end] - place[end], text[end], place[end])))
                i = j
            if heads:
                a, b = (np.concatenate(x, 1) for x in (heads, tails))
                a, b = a[:, np.lexsort((a[1], a[0]))], b[:, np.lexsort((b[1], b[0]))]
                out.append(np.stack((a[1], b[1] - a[1] + s.n, self.item[a[2]])))
        start, length, item = np.concatenate(out, 1) if out else np.empty((3, 0), np.int64)
        doc = np.searchsorted(first, start, "right") - 1
        order = np.lexsort((length, item, start))
        return doc[order], (start - first[doc])[order], length[order], self.ids[item[order]]


def _summary(n_words: int, start: np.ndarray, length: np.ndarray, item: np.ndarray) -> tuple[int, list[int]]:
    marks = np.zeros(n_words + 1, np.int64)
    np.add.at(marks, start, 1)
    np.add.at(marks, start + length, -1)
    return int((np.cumsum(marks) > 0).sum()), np.unique(item).tolist()


FOUND = f"doc_id long, text_hash long, n_words long, n_hit long, items array<long>, matches {MATCH}"


def _scan(docs: DataFrame, items: list[tuple[int, str]], window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Suffixes(items, window))  # some hundred bytes for each word of a block

    def run(batches):
        block = sent.value
        for batch in batches:
            raw, offs = common.text_buffers(batch.column("text"))
            for i, j in common.doc_ranges(offs, SHARD):
                words, _, _, first = common.words_of(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], common.LETTERS)
                found = block.occurrences(words, first)
                doc, start, length, item = block.matches(found, first)
                n, bounds = j - i, np.searchsorted(doc, np.arange(j - i + 1))
                covered = np.concatenate(([0], np.cumsum(block.cover(found, len(words)))))
                items_of = [np.unique(item[a:b]).tolist() if b > a else [] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                matches = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(item)], fields=list(_MATCHES.value_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), batch.column("text_hash").slice(i, n), pa.array(np.diff(first)), pa.array(covered[first[1:]] - covered[first[:-1]]), pa.array(items_of, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), matches)],
                    names=["doc_id", "text_hash", "n_words", "n_hit", "items", "matches"],
                )

    return docs.mapInArrow(run, FOUND)


def _merge(batches):
    """Rows that several benchmark blocks gave for one document, made one."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            m = r["matches"]
            hit, items = _summary(r["n_words"], *(np.array([x[k] for x in m], np.int64) for k in ("start", "length", "item_id")))
            out.append(r | {"n_hit": hit, "items": items, "matches": sorted(m, key=lambda x: (x["start"], x["item_id"]))})
        yield pa.RecordBatch.from_pylist(out, schema=batch.schema)


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The items in blocks of about ``block_bytes`` of text, one after another."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    many = max(1, -(-total // block_bytes))
    if many == 1:
        return [lambda: items]
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(many))
    return [lambda b=b: items.where(block == b) for b in range(many)]


def _taken(items: DataFrame) -> list[tuple[int, str]]:
    return [tuple(r) for r in items.where("item_id IS NOT NULL").collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK) -> DataFrame:
    """Per document: words, words inside a benchmark window, items with such windows, and the longest verbatim matches.

    Words are runs of letters and digits after lower-casing A-Z. A window is ``window`` consecutive words of an item,
    or the whole of a shorter one. Every suffix of an item that begins with a window is searched, in suffix arrays of
    documents where they lie; these leave out suffixes that begin with no window's first three words. Null and empty
    texts have no words and are clean; items without words, or without an id, match nothing; items of one id are one;
    repeated rows are judged each and a null doc_id stays null; with an empty benchmark all is clean; further columns
    are left out, whatever their names. A benchmark beyond ``block_bytes`` is taken in blocks of about that size.
    """
    blocks = _blocks(benchmark, block_bytes)
    docs = common.spread(common.keyed(docs, F.lit(0).cast("long").alias("text_hash") if len(blocks) == 1 else F.xxhash64("text").alias("text_hash")))
    if len(blocks) == 1:
        return _scan(docs, _taken(blocks[0]()), window).drop("text_hash")
    parts = [common.written(_scan(docs, _taken(b()), window)) for b in blocks]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    merged = joined.groupBy("doc_id", "text_hash", "n_words").agg((F.count(F.lit(1)) / len(blocks)).cast("int").alias("copies"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<long>").alias("items"), F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))
    merged = merged.select("doc_id", "text_hash", "n_words", "n_hit", "items", "matches", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")
    return merged.mapInArrow(_merge, FOUND).drop("text_hash")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK) -> DataFrame:
    """``docs`` without the rows that hold any benchmark window, all columns kept; each row is judged by its own text."""
    blocks = _blocks(benchmark, block_bytes)
    for k, items in enumerate(blocks):
        sent = docs.sparkSession.sparkContext.broadcast(Suffixes(_taken(items()), window))

        def judge(sent=sent):
            def keeps(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
                words, _, _, first = common.words_of(raw, offs, common.LETTERS)
                hit = np.concatenate(([0], np.cumsum(sent.value.cover(sent.value.occurrences(words, first), len(words)))))
                return hit[first[1:]] == hit[first[:-1]]

            return keeps

        docs = common.filtered(docs, judge)
        docs = docs if k == len(blocks) - 1 else common.written(docs)  # one block's suffixes a worker
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item; nulls, ties, repeats and empty tables as in ``contamination``."""
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p : p + least(len(ws), 10) - 1], ' ') AS k FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM b WHERE len(ws) > 0)),
runs AS (SELECT doc_id, n, p, array_to_string(ws[p : p + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hits AS (SELECT doc_id, item_id, p, runs.n FROM runs JOIN win ON runs.k = win.k AND runs.n = win.n),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
