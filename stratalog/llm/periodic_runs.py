"""Runs of repeated words in texts, by bit-parallel lags.

The words of a text get small numbers, and each bit of these numbers a bit plane: one big integer with a bit for every word.
For a lag q, a plane XOR itself shifted by q marks the words that differ in that bit from the word q further on; the OR over
the planes marks all mismatches. Shifting and ANDing the matches with themselves, each time by twice as far, leaves the
places from which a long enough stretch matches. A text of n words takes n / 3 lags of a few operations on n bits each; most
lags end after two planes, as no long stretch matches in both.

Long texts are dealt over several tasks by blocks of lags, since their work grows with the square of their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import with_row_key
from .textarrays import freeing

_RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Run(NamedTuple):
    start: int
    length: int
    period: int


def bit_planes(words: list[bytes]) -> list[int]:
    """The words' numbers, in the order in which they first come, bit by bit; word k is bit k of each plane."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    return [int.from_bytes(np.packbits((ids >> b) & 1 != 0, bitorder="little").tobytes(), "little") for b in range(max(1, (len(numbers) - 1).bit_length()))]


def _long_stretches(bits: int, least: int) -> int:
    """The places from which at least `least` bits in a row are set."""
    width = 1
    while bits and 2 * width <= least:
        bits &= bits >> width
        width *= 2
    return bits & (bits >> (least - width)) if bits and width < least else bits


def _stretches(bits: int) -> Iterator[tuple[int, int]]:
    """First place and length of every stretch of set bits."""
    at = 0
    while bits:
        skip = (bits & -bits).bit_length() - 1
        bits >>= skip
        count = (~bits & (bits + 1)).bit_length() - 1
        yield at + skip, count
        bits >>= count
        at += skip + count


def find_runs(words: list[bytes], first: int = 1, last: int | None = None, least: int = 24, times: int = 3) -> list[Run]:
    """All runs with a period of first..last words (by default any), by start and then period.

    A run is a stretch in which words `period` apart are equal, of at least max(least, times * period) words, that can't be
    longer. A stretch with several such periods is listed with the smallest of those looked for: a run of 3 periods or more
    has no other periods than multiples of its smallest one.
    """
    n = len(words)
    last = min(n // times, n if last is None else last)
    if n < least or first > last:
        return []
    planes = bit_planes(words)
    found: dict[tuple[int, int], int] = {}
    whole = (1 << (n - first)) - 1
    for lag in range(first, last + 1):
        need = max(least, times * lag) - lag
        apart = starts = 0
        for k, plane in enumerate(planes):
            apart |= plane ^ (plane >> lag)
            if k == 1 or k == len(planes) - 1:
                starts = _long_stretches((apart & whole) ^ whole, need)
                if not starts:
                    break
        for start, count in _stretches(starts):
            found.setdefault((start, start + count - 1 + need + lag), lag)
        whole >>= 1
    return sorted(Run(start, end - start, lag) for (start, end), lag in found.items())


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that are in no run, or in the first period of every run that they are in."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        depth[r.start + r.period] += 1
        depth[r.start + r.length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, compared exactly (ties: smallest start, then period)."""
    best = None
    for r in runs:
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


def _merged(runs: list[dict]) -> list[Run]:
    """Runs found by several blocks of lags: of those of one stretch the smallest period."""
    least: dict[tuple[int, int], int] = {}
    for r in runs:
        span = (r["start"], r["length"])
        least[span] = min(r["period"], least.get(span, r["period"]))
    return sorted(Run(s, n, p) for (s, n), p in least.items())


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 24, times: int = 3, long_bytes: int = 2 << 20) -> DataFrame:
    """Per document: doc_id, n_words, runs (start, length, period; by start, then period), best (the strongest run, or null)
    and collapsed: the words that are left when each run keeps its first period, joined by one space.

    Words are parted by ASCII white space, start is a word's number from 0. A null text has no words, an empty `runs` and an
    empty `collapsed`; so has an empty one. Rows that share an id are taken apart; a null id stays null. An empty table gives
    an empty one. Other columns are ignored. Texts of more than `long_bytes` bytes get (bytes / long_bytes) squared tasks, each
    for a block of lags, and only their runs are gathered.
    """
    schema = f"doc_id {docs.schema[id_column].dataType.simpleString()}, n_words long, runs {_RUNS}, best struct<start: long, length: long, period: long>, collapsed string"
    id_type = pa.string() if docs.schema[id_column].dataType.simpleString() == "string" else pa.int64()
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0))

    def rows(batch: pa.RecordBatch, known: list | None) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for k, text in enumerate(batch.column("text")):
            words = (text.as_py() or b"").split()
            runs = find_runs(words, least=least, times=times) if known is None else _merged(known[k] or [])
            best = strongest(runs)
            out.append((len(words), [r._asdict() for r in runs], best and best._asdict(), b" ".join(collapsed(words, runs)).decode("utf-8", "replace")))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([
            batch.column("id").cast(id_type), pa.array(columns[0], pa.int64()), pa.array(columns[1], _RUN_TYPE), pa.array(columns[2], _RUN_TYPE.value_type), pa.array(columns[3], pa.string()),
        ], names=["doc_id", "n_words", "runs", "best", "collapsed"])

    def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield from rows(batch.slice(at, 500), None)

    def block_of_lags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column("text")[k].as_py().split()
                block, blocks, lags = batch.column("block")[k].as_py(), batch.column("blocks")[k].as_py(), len(words) // times
                runs = find_runs(words, 1 + lags * block // blocks, lags * (block + 1) // blocks, least, times)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(k, 1), pa.array([[r._asdict() for r in runs]], _RUN_TYPE)], names=["key", "runs"])

    def with_known_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from rows(batch.slice(k, 1), batch.column("runs").slice(k, 1).to_pylist())

    short = source.where(n_bytes <= long_bytes).mapInArrow(freeing(whole_texts), schema)
    large = with_row_key(docs, "_key").select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"), F.col("_key").alias("key")).where(n_bytes > long_bytes)
    blocks = F.ceil(F.pow(F.octet_length("text") / F.lit(long_bytes), 2)).cast("int")
    dealt = large.select("key", "text", blocks.alias("blocks")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).repartition("key", "block")
    found = dealt.mapInArrow(freeing(block_of_lags), f"key struct<file: long, row: long>, runs {_RUNS}").groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return short.unionByName(large.join(found, "key").mapInArrow(freeing(with_known_runs), schema))
