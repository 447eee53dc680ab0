"""Words and windows of many texts at once, as numpy arrays over Arrow string buffers.

A word of at most 64 bytes is hashed eight bytes at a time, with a mixer between; a longer one by BLAKE2b. Two different
words share their 64 bits with a chance of about 2**-64, whatever their length or structure. A window is a Rabin-Karp
polynomial of its words' hashes modulo 2**64. Windows of at most 13 words that hold the same words in another order can lose
9 of the 64 bits, so two windows share a hash with a chance of at most about 2**-55.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BLOCK_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1
#: Bytes up to which a span is hashed block by block.
_SHORT = 64
#: Keeps the lowest k bytes of a block.
_LOWEST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

#: Tables of the bytes that part words.
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALPHANUMERIC = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def release() -> None:
    """Give the memory that this worker no longer uses back to the system, at the end of a task: idle workers keep theirs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """run over a task's batches, and then release()."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return freed


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of h, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def salted(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of what h is a hash of."""
    return mix(h + np.uint64((salt * 0x9E3779B97F4A7C15) & _MASK))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts and the offsets of each text; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words(NamedTuple):
    """hash, start and end (byte positions) of every word; first: index of the first word of each text, and the count."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run ends where a text ends."""
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    starts[edges] |= inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] |= inside[edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each position on
    size = end - start
    out = mix(size.astype(np.uint64) + _BLOCK_FACTOR)
    rows, at, left = None, start, size
    for _ in range(_SHORT // 8):
        block = eight[at]
        block &= _LOWEST[np.minimum(left, 8)]
        block *= _BLOCK_FACTOR
        mixed = mix((out if rows is None else out[rows]) ^ block)
        if rows is None:
            out = mixed
        else:
            out[rows] = mixed
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > _SHORT):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray, lower: bool = False) -> Words:
    """The words of each text: the longest runs of bytes that `between` doesn't mark."""
    if lower:
        data = LOWER[data]
    start, end = runs(~between[data], offsets)
    return Words(hash_spans(data, start, end), start, end, np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words within one text, and each window's first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h *= _WORD_BASE
        h += hashes[k : k + n]
    last = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + width <= last)
    return mix(h[at]), at


def covered(n: int, at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Which of n words lie in a window that starts at one of `at`."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, at, 1)
    np.add.at(depth, np.minimum(at + width, n), -1)
    return np.cumsum(depth[:-1]) > 0


def take_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then the same for the next."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(total) + np.repeat(start - before, count)
