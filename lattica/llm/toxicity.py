"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give document scores and offsets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK, THRESHOLD, FOLDS, HELD_OUT = 1 << 18, 0.3, 4, 2
#: Labelled documents that the model is fitted on at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 4000, 8 << 20
FIT_CHUNK = 512 << 10
#: Bytes of the prefixes and suffixes that are features beside the word itself.
PREFIXES, SUFFIXES, SEGMENT = (3, 4, 5, 6, 7, 8), (4, 6), 24


def _features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of each word's features: itself, prefixes and suffixes (those as long as the word count as the word)."""
    up, down = common._power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(common._BYTE[raw] * up[: len(raw)], out=sums[1:])
    length = ends - starts

    def hashed(a: np.ndarray, b: np.ndarray, kind: int, holds: np.ndarray) -> np.ndarray:
        h = common.mix64((sums[b] - sums[a]) * down[a] + common.U(1000 * kind) + (b - a).astype(np.uint64))
        return np.where(holds, h, common.U(0))

    cols = [hashed(starts, ends, 1, length > 0)]
    cols += [hashed(starts, np.minimum(starts + k, ends), 2, length > k) for k in PREFIXES]
    cols += [hashed(np.maximum(ends - k, starts), ends, 3, length > k) for k in SUFFIXES]
    return np.stack(cols, 1)


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray  # emission of the toxic state, beside the other's zero
    bias: float
    moves: np.ndarray  # transition weights, from and to (other, toxic)
    document: np.ndarray  # intercept, largest marginal, log of the sum, log of the sum per word
    spread: float = 1.0

    def emissions(self, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words with any known feature, and their emissions without the bias."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.keys, feats), len(self.keys) - 1)
        known = (self.keys[at] == feats) & (feats != 0)
        rows = np.flatnonzero(known.any(1))
        return rows, np.where(known[rows], self.weights[at[rows]], 0).sum(1)

    def marginals(self, doc: np.ndarray, place: np.ndarray, emission: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Forward-backward probabilities of the toxic state at the given words; runs of featureless words between them
        are powers of one matrix, in closed form."""
        if not len(doc):
            return np.empty(0)
        step = np.exp(self.moves)
        idle = step * np.array([1.0, np.exp(self.bias)])
        values, left = np.linalg.eig(idle)
        values, left = values.real, left.real
        if values[0] < values[1]:
            values, left = values[::-1], left[:, ::-1]
        right = np.linalg.inv(left)
        first, second, ratio = np.outer(left[:, 0], right[0]), np.outer(left[:, 1], right[1]), values[1] / values[0]

        def power(n: np.ndarray) -> np.ndarray:
            return first + second * (ratio ** n.astype(float))[:, None, None]

        head = np.searchsorted(doc, doc)
        rank = np.arange(len(doc)) - head
        count = np.bincount(doc, minlength=len(sizes))[doc]
        before = np.where(rank > 0, place - np.concatenate(([0], place[:-1])) - 1, place)
        after = np.where(rank + 1 < count, 0, sizes[doc] - place - 1)
        scale = np.stack((np.ones(len(doc)), np.exp(np.clip(emission + self.bias, -30, 30))), 1)
        enter = np.einsum("nij,jk->nik", power(before), step) * scale[:, None, :]
        ahead, behind = np.empty((len(doc), 2)), np.empty((len(doc), 2))
        order = np.argsort(rank, kind="stable")
        bounds = np.searchsorted(rank[order], np.arange(rank.max() + 2))
        for r in range(len(bounds) - 1):
            now = order[bounds[r] : bounds[r + 1]]
            last = ahead[now - 1] if r else np.tile([1.0, 0.0], (len(now), 1))
            a = np.einsum("ni,nij->nj", last, enter[now])
            ahead[now] = a / a.sum(1, keepdims=True)
        for r in range(len(bounds) - 2, -1, -1):
            now = order[bounds[r] : bounds[r + 1]]
            ends = rank[now] + 1 == count[now]
            follow = np.minimum(now + 1, len(doc) - 1)
            b = np.where(ends[:, None], power(after[now]).sum(2), np.einsum("nij,nj->ni", enter[follow], behind[follow]))
            behind[now] = b / b.sum(1, keepdims=True)
        joint = ahead * behind
        return joint[:, 1] / joint.sum(1)

    def score(self, doc: np.ndarray, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_document_features(doc, p, sizes) @ self.document))


def _document_features(doc: np.ndarray, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    most, total = np.zeros(len(sizes)), np.bincount(doc, p, len(sizes))
    np.maximum.at(most, doc, p)
    return np.stack((np.ones(len(sizes)), most, np.log1p(total), np.log1p(100 * total / np.maximum(sizes, 1))), 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, prior: float = 0.1) -> np.ndarray:
    """Weights drawn to those that give every text the share of toxic ones, as if one more text were toxic by ``prior``."""
    share = (y.sum() + prior) / (len(y) + 1)
    start = np.array([np.log(share / (1 - share)), *np.zeros(x.shape[1] - 1)])
    w = start.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(hessian, x.T @ (y - p) - ridge * (w - start))
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit(texts: list[str], labels: list[int], rounds: int = 150) -> Model:
    """A field fitted to labelled documents.

    Only documents are labelled, so words are first: in a toxic document those with a feature that toxic documents hold
    far more often than others (different texts count), nothing elsewhere. The field then learns by gradient ascent on
    the likelihood of those tags, and a logistic curve turns its marginals into document scores.
    """
    kept = list(dict(zip(texts, labels, strict=True)).items())
    kept.sort()
    y = np.array([b for _, b in kept], np.int64)
    raw, offs = common.text_buffers(pa.array([t for t, _ in kept], pa.large_string()))
    low = common.LOWER[raw]
    starts, ends, first = common.word_bounds(low, offs, common.LETTERS)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(kept), dtype=np.int32), sizes)

    def parts():
        """Features of some documents at a time: the first word, and a row a word."""
        for i, j in common.doc_ranges(offs, FIT_CHUNK):
            a, b = int(first[i]), int(first[j])
            yield a, _features(low[offs[i] : offs[j]], starts[a:b] - offs[i], ends[a:b] - offs[i])

    held = [(np.empty(0, np.uint64), np.empty(0, np.int8))]
    for begin, feats in parts():
        rows, cols = np.nonzero(feats)
        key, of = feats[rows, cols], doc[begin + rows]
        order = np.lexsort((of, key))
        key, of = key[order], of[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        held.append((key[new], y[of[new]].astype(np.int8)))
    found, bad = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    order = np.argsort(found)
    found, bad = found[order], bad[order]
    heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(found)), bool), found[1:] != found[:-1])))
    keys = found[heads]
    total = np.diff(np.append(heads, len(found)))
    toxic = np.add.reduceat(bad, heads, dtype=np.int64) if len(heads) else np.empty(0, np.int64)
    other = total - toxic
    del found, bad, order
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    rate1, rate0 = (toxic + 0.5) / (n1 + 1), (other + 0.5) / (n0 + 1)
    mean = (toxic + other + 1) / (n1 + n0 + 2)
    sure = (rate1 - rate0) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))
    chosen = (toxic >= 3) & (rate1 > 5 * rate0) & (sure > 5)
    model = Model(keys[chosen], np.zeros(int(chosen.sum())), -4.0, np.zeros((2, 2)), np.zeros(4))
    if len(model.keys):
        some = [(np.empty(0, np.int64), np.empty((0, 1 + len(PREFIXES) + len(SUFFIXES)), np.uint64))]
        for begin, feats in parts():
            rows, _ = model.emissions(feats)
            some.append((begin + rows, feats[rows]))
        events, feats = (np.concatenate(x) for x in zip(*some, strict=True))
        at = np.minimum(np.searchsorted(model.keys, feats), len(model.keys) - 1)
        known = (model.keys[at] == feats) & (feats != 0)
        tags = np.zeros(len(doc), np.int8)
        tags[events] = y[doc[events]] == 1
        _ascend(model, at, known, events, tags, first, rounds)
        emission = np.where(known, model.weights[at], 0).sum(1)
    else:
        events, emission = np.empty(0, np.int64), np.empty(0)
    p = model.marginals(doc[events], events - first[doc[events]], emission, sizes)
    model.document = _logistic(_document_features(doc[events], p, sizes), y)
    return model


def _ascend(model: Model, at: np.ndarray, known: np.ndarray, events: np.ndarray, tags: np.ndarray, first: np.ndarray, rounds: int) -> None:
    """Full-batch AdaGrad over segments: all that hold a known feature, and every tenth of the others at tenfold weight."""
    begin = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) if b > a])
    end = np.minimum(begin + SEGMENT, first[np.searchsorted(first, begin, "right")])
    row_of = np.full(len(tags), -1, np.int32)
    row_of[events] = np.arange(len(events))
    any_known = np.concatenate(([0], np.cumsum(row_of >= 0)))
    held = any_known[end] > any_known[begin]
    idle = np.flatnonzero(~held)[::10]
    pick = np.concatenate((np.flatnonzero(held), idle))
    weight = np.concatenate((np.ones(int(held.sum())), np.full(len(idle), 10.0)))
    begin, end = begin[pick], end[pick]
    index = np.minimum(begin[:, None] + np.arange(SEGMENT), len(tags) - 1)
    real = begin[:, None] + np.arange(SEGMENT) < end[:, None]
    y = tags[index].astype(np.int64)
    row, col = np.nonzero(real & (row_of[index] >= 0))
    word = row_of[index[row, col]]
    k_word, k_feat = np.nonzero(known[word])
    feature = at[word[k_word], k_feat]
    cell = (row * SEGMENT + col)[k_word]
    total = weight.sum()
    theta = np.concatenate((model.weights, [model.bias], model.moves.reshape(-1)))
    gathered = np.full(len(theta), 1e-8)
    n = len(model.keys)
    starts_at_other = np.zeros(len(begin), np.int64)
    for _ in range(rounds):
        emission = np.bincount(cell, theta[feature], index.size).reshape(index.shape) + theta[n]
        step = np.exp(theta[n + 1 :].reshape(2, 2))
        factor = np.stack((np.ones(index.shape), np.exp(np.clip(emission, -30, 30))), 2)
        ahead, behind = np.empty((*index.shape, 2)), np.ones((*index.shape, 2))
        last = np.tile([1.0, 0.0], (len(begin), 1))
        for t in range(SEGMENT):
            a = last @ step * factor[:, t]
            ahead[:, t] = last = np.where(real[:, t, None], a / a.sum(1, keepdims=True), last)
        for t in range(SEGMENT - 2, -1, -1):
            b = (factor[:, t + 1] * behind[:, t + 1]) @ step.T
            behind[:, t] = np.where(real[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
        joint = ahead * behind
        p = joint[:, :, 1] / joint.sum(2)
        error = np.where(real, y - p, 0) * weight[:, None]
        slope = np.bincount(feature, error.reshape(-1)[cell], len(theta))
        slope[n] = error.sum()
        for t in range(SEGMENT):
            source = ahead[:, t - 1] if t else np.tile([1.0, 0.0], (len(begin), 1))
            pair = source[:, :, None] * step * (factor[:, t] * behind[:, t])[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            w = np.where(real[:, t], weight, 0)
            slope[n + 1 :] -= (pair * w[:, None, None]).sum(0).reshape(-1)
            slope[n + 1 :] += np.bincount(2 * (y[:, t - 1] if t else starts_at_other) + y[:, t], w, 4)
        slope = slope / total - 1e-5 * theta
        gathered += slope**2
        theta += 0.3 * slope / np.sqrt(gathered)
    model.weights, model.bias, model.moves = theta[:n], float(theta[n]), theta[n + 1 :].reshape(2, 2)


SCORED = "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])


def _tagged(field: Model, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Scores of the texts, and the toxic words: their text, start and end in bytes, marginal."""
    low = common.LOWER[raw]
    starts, ends, first = common.word_bounds(low, bounds, common.LETTERS)
    sizes = np.diff(first)
    events, emission = field.emissions(_features(low, starts, ends))
    doc = np.searchsorted(first, events, "right") - 1
    p = field.marginals(doc, events - first[doc], emission, sizes)
    bad = np.flatnonzero(p >= 0.5)
    return field.score(doc, p, sizes), doc[bad], starts[events[bad]], ends[events[bad]], p[bad]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score of each document and the offsets (code points) of words whose toxic marginal is 0.5 or more.

    A null or empty text has no words and gets the score of a text without toxic marks; repeated rows get equal
    scores; a null doc_id stays null; an empty table gives an empty result; further columns are left out, whatever
    their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights of at most a few thousand features

    def run(batches):
        field = sent.value
        for batch in batches:
            raw, offs = common.text_buffers(batch.column("text"))
            for i, j in common.doc_ranges(offs, CHUNK):
                some, bounds = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                scores, doc, begin, end, p = _tagged(field, some, bounds)
                points = np.concatenate(([0], np.cumsum(some & 0xC0 != 0x80)))  # code points before each byte
                base = points[bounds[doc]]
                spans = pa.StructArray.from_arrays([pa.array(points[begin] - base), pa.array(points[end] - base), pa.array(p)], fields=list(_SPAN))
                cut = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(scores), pa.ListArray.from_arrays(pa.array(cut), spans)], names=["doc_id", "score", "spans"])

    return common.spread(common.keyed(docs)).mapInArrow(run, SCORED)


def drop(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``, all columns kept; each row is judged by its own text.

    Without labelled toxic rows the model calls nothing toxic, so all rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return common.filtered(docs, lambda: lambda raw, offs: _tagged(sent.value, raw, offs)[0] < threshold)


def held_out(doc_id: str) -> Column:
    """Whether a row is never learnt from; a null doc_id counts as no text in the crc."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the training fold's labelled rows, at most ``sample`` of them and ``sample_bytes`` of text, picked by hash.

    A text longer than the room left is passed over, and the walk goes on until there are ``sample`` rows, less room than an
    even share of the bytes, or no more rows. Sizes are looked at first; only the picked texts come to the driver.
    Rows without a label or doc_id are left out; without labelled rows every text scores 0.1, below the threshold.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).distinct()
    texts = common.keyed(docs).select("doc_id", "text", F.xxhash64("text").alias("t"))
    sizes = texts.select("doc_id", "t", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).where(F.col("n") <= sample_bytes).distinct()
    walk = known.join(sizes, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "t", "toxic")
    room, used = sample_bytes, []
    for r in walk.toLocalIterator():
        if r["n"] > room:
            continue
        room -= r["n"]
        used.append((r["doc_id"], r["t"], r["toxic"]))
        if len(used) >= sample or room < sample_bytes // sample:
            break
    picked = docs.sparkSession.createDataFrame([u[:2] for u in used], "doc_id long, t long").distinct()
    found = {(r["doc_id"], r["t"]): r["text"] for r in texts.join(F.broadcast(picked), ["doc_id", "t"]).toLocalIterator()}
    return fit([found[u[:2]] for u in used], [u[2] for u in used])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a field learnt from the labelled rows outside the held-out fold; edge cases as in ``score``."""
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))
