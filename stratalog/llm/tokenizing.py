"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once by a worker.

The library's vocabulary file has a normalizer (NFC, white space, lower case), a splitting pattern and merges within a
split piece. White space always parts pieces. Inside a word of ASCII and the Latin letters U+00C0 to U+00FF, so do changes
between letters, single digits and other signs, because no normal form, contraction or special token reaches across.
Every other word (with an apostrophe, "<", control or other characters) goes to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from .textarrays import LOWER, hash_spans, runs, take_ranges

#: Distinct pieces a worker remembers; beyond it, it starts afresh. Only speed depends on it.
REMEMBERED = 1_500_000
#: Those it keeps at rest.
AT_REST = 600_000

_SPACE, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)
_KIND = np.full(256, _WHOLE, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
for _b in range(0x21, 0x7F):
    _KIND[_b] = _LETTER if chr(_b).isalpha() else _DIGIT if chr(_b).isdigit() else _SIGN
_KIND[[0xC3, *range(0x80, 0xC0)]] = _LETTER
_KIND[[ord("'"), ord("<")]] = _WHOLE


class Encoder:
    """Ids of texts given as UTF-8 bytes with offsets."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.path, self._library = path, None
        self.forget()

    @property
    def library(self):
        """The library's tokenizer, loaded where a piece is unknown."""
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def rest(self) -> None:
        """Drop the library's tokenizer, which takes far more memory than the known pieces, and these where they are many."""
        self._library = None
        if len(self.keys) > AT_REST:
            self.forget()

    @classmethod
    def at(cls, path: str) -> Encoder:
        """This worker's encoder of the file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def forget(self) -> None:
        self.keys, self.start, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes to encode, and starts and ends of the pieces."""
        kind = _KIND[data]
        timesign = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        kind[timesign] = _WHOLE
        start, end = runs(kind != _SPACE, offsets)
        if not len(start):
            return data, start, end
        odd = np.flatnonzero(np.add.reduceat(np.append(kind == _WHOLE, False), np.column_stack([start, end]).ravel())[::2])
        kind[take_ranges(start[odd], (end - start)[odd])] = _WHOLE
        data = np.where(kind == _WHOLE, data, LOWER[data])
        cut = np.ones(len(data), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cut[start] = True
        cut &= kind != _SPACE
        begin = np.flatnonzero(cut)
        word = np.searchsorted(start, begin, side="right") - 1
        stop = np.minimum(np.append(begin[1:], len(data)), end[word])
        return data, begin, stop

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the index of each text's first one, with the count at the end."""
        data, begin, stop = self.pieces(data, offsets)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys, at, index = np.unique(hash_spans(data, begin, stop), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        if not known.all():
            self._learn(keys[~known], [data[begin[k] : stop[k]].tobytes().decode() for k in at[~known]])
            place = np.searchsorted(self.keys, keys)
            if len(self.keys) < len(keys) or (self.keys[np.minimum(place, len(self.keys) - 1)] != keys).any():
                return self.encode(data, offsets)
        count = self.count[place][index]
        ids = self.ids[take_ranges(self.start[place][index], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[np.searchsorted(begin, offsets)]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) > REMEMBERED:
            self.forget()
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for f in found for i in f), np.uint32, int(count.sum()))
        start = len(self.ids) + np.cumsum(count) - count
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.count = np.insert(self.keys, at, keys), np.insert(self.start, at, start), np.insert(self.count, at, count)
        self.ids = np.concatenate([self.ids, ids])


def with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end` after each text."""
    n = len(first) - 1
    return np.insert(ids, first[1:], np.full(n, end, np.uint32)), first + np.arange(n + 1)


def blocks(offsets: np.ndarray, size: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of about `size` bytes each; a longer text is a range of its own."""
    out, low, n = [], 0, len(offsets) - 1
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1))
        out.append((low, high))
        low = high
    return out
