"""Token ids of whole texts by the tokenizers library, encoding each different piece of text once a worker.

Both tokenizers cut a text before they merge, and never across the end of a run of white space, so the ids of a text
are those of its pieces in a row.  Pieces repeat far more often than they are new.  Added tokens of the vocabulary, such
as one for the end of a text, are found in the raw text first, as the library does; what lies between is encoded alone.
"""

from __future__ import annotations

import itertools
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import common

WORDS, SPACED_WORDS = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Different pieces a worker keeps, those it has learnt lately, bytes of text it takes at once, and pieces that the
#: library encodes at once.
KEPT, LATELY, CHUNK, LEARNT = 1_200_000, 1 << 16, 1 << 19, 8192
_IS_SPACE = ~common.SPACED
_MAY_END_SPACE = np.zeros(256, bool)
_MAY_END_SPACE[0x80:0xC0] = True


#: ASCII letters, and punctuation that no pattern of either tokenizer keeps with the letters before it.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[ord(c) for c in ",.;:!?|)"]] = True


def _mark_cuts(raw: np.ndarray) -> np.ndarray:
    """Where punctuation follows a letter: a word has the same piece with and without it."""
    return np.flatnonzero(_MARK[raw[1:]] & _LETTER[raw[:-1]]) + 1


def _piece_starts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where white space follows something else, but for characters that may be white space beyond ASCII."""
    n = len(raw)
    space = _IS_SPACE[raw]
    cut = np.zeros(n, bool)
    cut[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(cut)
    last = raw[at - 1]
    odd = at[_MAY_END_SPACE[last]]
    two, three = raw[odd - 2], raw[np.maximum(odd - 3, 0)]
    cut[odd[(two == 0xC2) | np.isin(three, [0xE1, 0xE2, 0xE3])]] = False
    cut[offs[:-1][offs[:-1] < n]] = True
    return np.flatnonzero(cut)


class _Pieces:
    """Ids of pieces by hash: keys in order, where the ids of each begin, and how many they are."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, size: np.ndarray, ids: np.ndarray):
        """``keys`` in order."""
        self.keys, self.at, self.size, self.ids = keys, at.astype(np.uint32, copy=False), size.astype(np.uint32, copy=False), ids

    @classmethod
    def none(cls) -> _Pieces:
        return cls(np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.uint32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``keys``, and which are there."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def joined(self, other: _Pieces) -> _Pieces:
        """Both, column by column: nothing is sorted again, and one column at a time is held twice."""
        place = np.searchsorted(self.keys, other.keys)
        at = np.insert(self.at, place, other.at + np.uint32(len(self.ids)))
        size = np.insert(self.size, place, other.size)
        return _Pieces(np.insert(self.keys, place, other.keys), at, size, np.concatenate((self.ids, other.ids)))


class Encoder:
    def __init__(self, path: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.added = {t.content.encode(): k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that depend on what surrounds them aren't supported")
        self.tokenizer.encode_special_tokens = True  # for pieces: a lower-cased one may look like an added token, and isn't
        self.any_added = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or b"(?!)")
        self.old = self.late = _Pieces.none()

    def _age(self) -> None:
        """Moves what was learnt lately to the rest once it is much; the rest goes when it is too much."""
        if len(self.late.keys) > LATELY:
            self.old = self.old.joined(self.late) if len(self.old.keys) + len(self.late.keys) <= KEPT else self.late
            self.late = _Pieces.none()

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        sizes, ids = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for k in range(0, len(pieces), LEARNT):
            new = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[k : k + LEARNT], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, new), np.int64, len(new)))
            ids.append(np.fromiter(itertools.chain.from_iterable(new), np.uint32, int(sizes[-1].sum())))
        size = np.concatenate(sizes)
        self.late = self.late.joined(_Pieces(keys, np.cumsum(size) - size, size, np.concatenate(ids)))

    def encode(self, raw: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one after another, ``end`` behind each, and int64 offsets (one more than rows)."""
        found = list(self.any_added.finditer(memoryview(raw)))  # valid UTF-8: a match over a row's end is no match
        found = [m for m in found if np.searchsorted(offs, m.start(), "right") == np.searchsorted(offs, m.end() - 1, "right")]
        if not found:
            return self._segments(raw, offs, np.full(len(offs) - 1, end, np.uint32))
        # each added token ends a segment, as a row's end does; without their bytes the segments lie side by side
        begin, stop = np.array([m.start() for m in found], np.int64), np.array([m.end() for m in found], np.int64)
        keep = np.ones(len(raw), bool)
        for i, j in zip(begin.tolist(), stop.tolist(), strict=True):
            keep[i:j] = False
        kept = np.concatenate(([0], np.cumsum(keep)))
        where = np.concatenate((begin, offs[1:]))
        closing = np.concatenate((np.array([self.added[m[0]] for m in found], np.uint32), np.full(len(offs) - 1, end, np.uint32)))
        order = np.lexsort((np.arange(len(where)) < len(begin), where))
        ids, bounds = self._segments(raw[keep], np.concatenate(([0], kept[where[order]])), closing[order])
        return ids, bounds[np.concatenate(([0], 1 + np.flatnonzero(order >= len(begin))))]

    def _segments(self, raw: np.ndarray, offs: np.ndarray, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.by_word:
            raw = common.LOWER[raw]  # the tokenizer lower-cases anyway
            starts, ends, first = common.word_bounds(raw, offs, common.SPACED)
            cuts = np.setdiff1d(_mark_cuts(raw), offs)
            starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
            first = np.searchsorted(starts, offs)
        elif len(raw):
            starts = np.union1d(_piece_starts(raw, offs), _mark_cuts(raw))
            ends = np.append(starts[1:], len(raw))
            first = np.searchsorted(starts, offs)
        else:
            starts = ends = np.empty(0, np.int64)
            first = np.zeros(len(offs), np.int64)
        hashes = common.span_hashes(raw, starts, ends)
        unique, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        self._age()
        in_old, known = self.old.find(unique)
        new = np.flatnonzero(~known & ~self.late.find(unique)[1])
        if len(new):
            view, where = memoryview(raw), sample[new]
            self._learn(unique[new], [str(view[i:j], "utf-8") for i, j in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
        in_late = self.late.find(unique)[0]
        size, begin = np.empty(len(unique), np.int64), np.empty(len(unique), np.int64)
        for mine, held, at in ((known, self.old, in_old), (~known, self.late, in_late)):
            size[mine], begin[mine] = held.size[at[mine]], held.at[at[mine]]
        size, begin, known = size[which], begin[which], known[which]
        total = np.concatenate(([0], np.cumsum(size)))
        source = np.repeat(begin - total[:-1], size) + np.arange(total[-1])
        from_old = np.repeat(known, size)
        flat = np.empty(len(source), np.uint32)
        flat[from_old], flat[~from_old] = self.old.ids[source[from_old]], self.late.ids[source[~from_old]]
        bounds = total[first]
        return np.insert(flat, bounds[1:], closing).astype(np.uint32), bounds + np.arange(len(bounds))


@lru_cache(4)
def encoder(name: str) -> Encoder:
    """``name``: a file of the public tokenizers package, or a path."""
    import public_tokenizers

    path = name if os.path.sep in name else public_tokenizers.path(name)
    return Encoder(path, os.path.basename(path).startswith("word"))


def encoded(batch: pa.RecordBatch, name: str, end: int):
    """Row range, ids and offsets for each chunk of a batch with a column ``text``."""
    raw, offs = common.text_buffers(batch.column("text"))
    tool = encoder(name)
    for i, j in common.doc_ranges(offs, CHUNK):
        ids, bounds = tool.encode(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], end)
        yield i, j, ids, bounds
