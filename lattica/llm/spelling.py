"""Spelling variants: words at edit distance one, found by running each word's Levenshtein automaton over a trie of all.

The vocabulary is cut by order into shards of bounded size, each a trie in arrays. Shards are sent to all tasks, as many
at a time as ``ROUND_BYTES`` hold, and every word meets every shard there; what a word finds in a shard is reduced to its
number of neighbours and the best of them before anything is shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Letters of a word in a trie's shard, and bytes of shards that are sent to all tasks at once (12 to 26 bytes a letter).
SHARD_CHARS, ROUND_BYTES = 1 << 20, 32 << 20
#: Bytes of text that are counted at once.
PIECE = 1 << 21
#: Words that search a shard side by side.
BLOCK = 4096

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_YES = np.array([False, True] + [False] * 254)
#: In UTF-8, the letters U+00C0 to U+00FF are this byte and one from 80 to BF.
LEAD = 0xC3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def members(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters A-Z, a-z and U+00C0 to U+00FF."""
    lead = raw == LEAD
    inside = _LETTER[raw] | lead
    inside[1:] |= lead[:-1]
    return inside


def pieces(raw: np.ndarray, offs: np.ndarray, limit: int):
    """(first row, bytes, offsets) of about ``limit`` bytes; a longer row is cut where no letter stands."""
    for i, j in common.doc_ranges(offs, limit):
        low, high = int(offs[i]), int(offs[j])
        if high - low <= limit:
            yield i, raw[low:high], offs[i : j + 1] - low
            continue
        while low < high:
            stop = min(low + limit, high)
            while stop < high:
                window = members(raw[stop - 1 : min(stop + 65536, high)])[1:]
                if not window.all():
                    stop += int(window.argmin())
                    break
                stop += len(window)
            yield i, raw[low:stop], np.array([0, stop - low])
            low = stop


def crc_of(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of byte spans, each carried on from the CRC-32 in ``state``."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, crc = starts[order], ~state[order]
    left = size[order]
    most = int(min(left[0], 64)) if len(left) else 0
    for j in range(most):
        n = int(np.searchsorted(-left, -j, "left"))  # spans longer than j
        crc[:n] = _CRC[(crc[:n] ^ raw[at[:n] + j]) & 255] ^ (crc[:n] >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    for k in np.flatnonzero(size > 64).tolist():
        out[k] = zlib.crc32(raw[starts[k] : ends[k]].tobytes(), int(state[k]))
    return out


def _strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as an Arrow array of strings."""
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    data = raw[np.repeat(starts - bounds[:-1], np.diff(bounds)) + np.arange(bounds[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)).cast(pa.string())


def word_counts(docs: DataFrame, shortest: int = 1, drop_every: int | None = None) -> DataFrame:
    """(word, n): maximal runs of letters A-Z, a-z, U+00C0 to U+00FF, A-Z lower-cased, and how often each occurs.

    Words of fewer than ``shortest`` code points are left out. With ``drop_every``, a run whose CRC-32 of ``<doc_id>:<run>``
    it divides loses one code point first, that of number CRC-32 mod length (a way to plant misspellings evenly). Null
    and empty texts have no words, repeated rows count each, a null doc_id is written as nothing, long texts are counted
    in pieces of two megabytes, further columns aren't read, an empty table has no words.
    """

    def run(batches):
        for batch in batches:
            raw_all, offs_all = common.text_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for first, raw, offs in pieces(raw_all, offs_all, PIECE):
                low = common.LOWER[raw]
                starts, ends, at = common.word_bounds(members(low).view(np.uint8), offs, _YES)
                leads = np.zeros(len(low) + 1, np.int64)
                np.cumsum(low == LEAD, out=leads[1:])
                size = ends - starts - (leads[ends] - leads[starts])
                row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
                long = size >= shortest
                starts, ends, row = starts[long], ends[long], row[long]
                dropped = np.zeros(len(starts), bool)
                if drop_every:
                    state = np.array([zlib.crc32(b":" if d is None else b"%d:" % d) for d in ids[first : first + len(offs) - 1]], np.uint32)
                    crc = crc_of(state[row], low, starts, ends)
                    dropped = crc % drop_every == 0
                    less = []
                    for k in np.flatnonzero(dropped).tolist():
                        text = low[starts[k] : ends[k]].tobytes().decode()
                        h = int(crc[k]) % len(text)
                        if len(text) > shortest:
                            less.append(text[:h] + text[h + 1 :])
                    yield pa.RecordBatch.from_arrays([pa.array(less, pa.string()), pa.array([1] * len(less), pa.int64())], names=["word", "n"])
                starts, ends = starts[~dropped], ends[~dropped]
                _, one, n = np.unique(common.span_hashes(low, starts, ends), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_strings(low, starts[one], ends[one]), pa.array(n.astype(np.int64))], names=["word", "n"])

    found = common.spread(common.keyed(docs)).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte a code point, and offsets, of words of the letters above."""
    raw, offs = common.text_buffers(column)
    lead = raw == LEAD
    out = raw.copy()
    out[1:][lead[:-1]] += 0x40
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    return out[~lead], offs - before[offs]


class Trie:
    """Words in ascending order as a trie in arrays: nodes by level, the children of a node side by side, by letter."""

    FIELDS = {"labels": np.uint8, "children": np.int32, "ends": np.int32, "chars": np.uint8, "bounds": np.int32, "counts": np.int64}

    def __init__(self, *arrays: np.ndarray):
        self.labels, self.children, self.ends, self.chars, self.bounds, self.counts = arrays
        parent = np.repeat(np.arange(len(self.labels)), np.diff(self.children))
        self.keys = parent * 256 + self.labels[1:]

    @classmethod
    def of(cls, chars: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> Trie:
        words, size = len(counts), np.diff(bounds)
        shared = np.zeros(words, np.int64)
        open_, d = np.arange(1, words), 0
        while len(open_):  # letters shared with the word before
            open_ = open_[(size[open_] > d) & (size[open_ - 1] > d)]
            open_ = open_[chars[bounds[open_] + d] == chars[bounds[open_ - 1] + d]]
            d += 1
            shared[open_] = d
        new = size - shared
        word = np.repeat(np.arange(words), new)
        depth = shared[word] + 1 + np.arange(len(word)) - np.repeat(np.cumsum(new) - new, new)
        key = depth * (words + 1) + word
        order = np.argsort(key, kind="stable")
        key, word, depth = key[order], word[order], depth[order]
        parent = np.where(depth > 1, np.searchsorted(key, (depth - 1) * (words + 1) + word, "right"), 0)  # 0 is the root
        labels = np.concatenate(([0], chars[bounds[word] + depth - 1]))
        children = np.searchsorted(parent, np.arange(len(labels) + 1)) + 1
        ends = np.concatenate(([-1], np.where(depth == size[word], word, -1)))
        arrays = (labels, children, ends, chars, bounds, counts)
        return cls(*(np.asarray(a).astype(kind) for a, kind in zip(arrays, cls.FIELDS.values(), strict=True)))

    @classmethod
    def read(cls, row) -> Trie:
        return cls(*(np.frombuffer(row[name], kind) for name, kind in cls.FIELDS.items()))

    def child(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The child of each node by a letter, and whether there is one."""
        key = node * 256 + letter
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return at + 1, self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)

    def near(self, chars: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for all words at distance exactly one of each query, each pair once.

        The automaton's state is the letters read and whether an edit was made. From each node that a query reaches
        without an edit, all branches with one are followed to their ends before the query goes a level deeper. Of
        equal letters side by side only the last is deleted, and none is inserted before its like, so no word is
        reached twice. Memory grows with the queries of a block and the children of a node, not with the trie's depth.
        """
        size = np.diff(offs)
        query, node, i = np.arange(len(size)), np.zeros(len(size), np.int64), 0
        hits = [np.empty((2, 0), np.int64)]
        while len(query):
            inside = i < size[query]
            letter = np.full(len(query), -1)
            letter[inside] = chars[offs[query[inside]] + i]
            last = np.full(len(query), -1)
            follows = i + 1 < size[query]
            last[follows] = chars[offs[query[follows]] + i + 1]
            deleted = inside & (letter != last)
            first, n = self.children[node], self.children[node + 1] - self.children[node]
            which = np.repeat(np.arange(len(node)), n)
            child = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]
            other = self.labels[child] != letter[which]
            which, child = which[other], child[other]
            replaced = inside[which]
            branch = [
                np.stack((query[deleted], node[deleted], np.full(deleted.sum(), i + 1))),
                np.stack((query[which], child, np.full(len(which), i))),
                np.stack((query[which[replaced]], child[replaced], np.full(replaced.sum(), i + 1))),
            ]
            q, at, place = np.concatenate(branch, 1)
            while len(q):
                done = place == size[q]
                ends = self.ends[at[done]]
                hits.append(np.stack((q[done][ends >= 0], ends[ends >= 0])))
                q, at, place = q[~done], at[~done], place[~done]
                at, there = self.child(at, chars[offs[q] + place])
                q, at, place = q[there], at[there], place[there] + 1
            query, node = query[inside], node[inside]
            node, there = self.child(node, letter[inside])
            query, node, i = query[there], node[there], i + 1
        return tuple(np.concatenate(hits, 1))


def _shards(words: DataFrame, shard_chars: int) -> DataFrame:
    """The vocabulary's tries: one row each of at most ``shard_chars`` letters (or one longer word), in order."""
    letters = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("n")).collect()[0]["n"]
    fields = list(Trie.FIELDS)

    def row(held):
        chars, bounds, counts = [], [0], []
        for c, b, n in held:
            chars.append(c)
            bounds.extend((b[1:] + bounds[-1]).tolist())
            counts.extend(n.tolist())
        trie = Trie.of(np.concatenate(chars), np.array(bounds), np.array(counts))
        parts = [pa.array([getattr(trie, name).tobytes()], pa.binary()) for name in fields]
        return pa.RecordBatch.from_arrays([*parts, pa.array([sum(getattr(trie, name).nbytes for name in fields)], pa.int64())], names=[*fields, "bytes"])

    def run(batches):
        held, full = [], 0
        for batch in batches:
            chars, offs = latin(batch.column("word"))
            n = np.asarray(batch.column("n"))
            i = 0
            while i < len(n):
                j = max(int(np.searchsorted(offs, offs[i] + shard_chars - full, "right")) - 1, i + (not held))
                if j > i:
                    held.append((chars[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n[i:j]))
                    full += int(offs[j] - offs[i])
                if j < len(n):
                    yield row(held)
                    held, full = [], 0
                i = j
        if held:
            yield row(held)

    ordered = words.repartitionByRange(max(1, -(-letters // shard_chars)), "word").sortWithinPartitions("word")
    tries = common.written(ordered.mapInArrow(run, ", ".join(f"{name} binary" for name in fields) + ", bytes long"))
    return tries.withColumn("shard", F.concat("_metadata.file_path", F.lit(":"), "_metadata.row_index"))


def neighbours(words: DataFrame, shard_chars: int = SHARD_CHARS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, n_near, best, best_n) for every row of ``words`` (word, n; distinct, not null, letters as above).

    Near words differ by exactly one inserted, deleted or replaced code point; the best is that of largest n, of equal
    ones the first by code points; without any, 0 and nulls. A shard has at most ``shard_chars`` letters, or one word
    that alone is longer; what is sent to all tasks at once is at most ``round_bytes`` or one shard. All words meet all
    shards, so the work grows with the vocabulary's size times the number of its shards.
    """
    shards = _shards(words, shard_chars)
    rounds, full = [[]], 0
    for r in shards.select("shard", "bytes").orderBy("shard").collect():  # one row for each million letters
        if rounds[-1] and full + r.bytes > round_bytes:
            rounds, full = [*rounds, []], 0
        rounds[-1].append(r.shard)
        full += r.bytes
    spark, paths = words.sparkSession, []
    for names in rounds:
        sent = spark.sparkContext.broadcast([r.asDict() for r in shards.where(F.col("shard").isin(names)).drop("shard", "bytes").collect()])

        def run(batches, sent=sent):
            tries = [Trie.read(row) for row in sent.value]
            for whole in batches:
                for k in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(k, BLOCK)
                    chars, offs = latin(batch.column("word"))
                    near, best_n = np.zeros((2, batch.num_rows), np.int64)
                    best = [None] * batch.num_rows
                    for trie in tries:
                        q, w = trie.near(chars, offs)
                        near += np.bincount(q, minlength=len(near))
                        order = np.lexsort((w, -trie.counts[w], q))
                        q, w = q[order], w[order]
                        lead = np.ones(len(q), bool)
                        lead[1:] = q[1:] != q[:-1]
                        for x, y in zip(q[lead].tolist(), w[lead].tolist(), strict=True):
                            n = int(trie.counts[y])
                            if n >= best_n[x]:
                                word = trie.chars[trie.bounds[y] : trie.bounds[y + 1]].tobytes().decode("latin-1")
                                if n > best_n[x] or word < best[x]:
                                    best[x], best_n[x] = word, n
                    yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(near), pa.array(best, pa.string()), pa.array(best_n)], names=["word", "n", "n_near", "best", "best_n"])

        where = common.scratch_path(spark)
        common.spread(words.select("word", "n")).mapInArrow(run, "word string, n long, n_near long, best string, best_n long").write.parquet(where)
        sent.destroy()
        paths.append(where)
    found = spark.read.schema("word string, n long, n_near long, best string, best_n long").parquet(*paths)
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    per = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return per.select("word", "n", "n_near", F.col("first.best").alias("best"), (-F.col("first.less")).alias("best_n"))


def variants(words: DataFrame, times: int = 5, shard_chars: int = SHARD_CHARS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word's best near word, if that occurs ``times`` as often, and the last
    word along such forms (itself without any).

    ``words``: word and n, distinct. Forms grow by ``times`` a step, so chains end after log(n) steps; they are followed
    from each distinct form, and a word is the form of no more words than are near to it.
    """
    found = neighbours(words, shard_chars, round_bytes)
    taken = F.col("best_n") >= times * F.col("n")
    forms = common.written(found.select("word", "n", "n_near", F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n")))
    links = forms.where("form IS NOT NULL").select(F.col("word").alias("from"), F.col("form").alias("to"))
    chase = links.select(F.col("to").alias("start"), F.col("to").alias("root"), F.lit(True).alias("open")).distinct()
    while True:
        step = chase.join(links, F.col("root") == F.col("from"), "left")
        chase = common.written(step.select("start", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("open")))
        if chase.where("open").isEmpty():
            break
    out = forms.join(chase, F.col("form") == F.col("start"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    words = common.written(word_counts(docs, shortest=6, drop_every=199).where("n >= 5"))
    return variants(words, 5)


ORACLE_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT 0 AS k, range(256)::UBIGINT[] AS t
  UNION ALL
  SELECT k + 1, list_transform(t, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) FROM steps WHERE k < 8
), crc AS (SELECT t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), counted AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS key, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(key, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [195::UBIGINT, unicode(c)::UBIGINT - 64] END)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h
  FROM counted, crc
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), cuts AS (
  SELECT DISTINCT word, n, i, word[:i] || word[i + 2:] AS less FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.less, a.word, a.n FROM cuts a JOIN words b ON a.less = b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.less = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chase AS (
  SELECT word, word AS root, 0 AS k FROM forms
  UNION ALL SELECT c.word, f.form, k + 1 FROM chase c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, k) AS root FROM chase GROUP BY word) USING (word)
"""
