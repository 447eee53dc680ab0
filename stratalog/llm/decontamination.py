"""Words of documents that lie in a passage of a benchmark.

A prefix-filtered set join between item windows (item-sized, of at most `width` words) and documents. A window is the set of
its shingles of three words (fewer where the window is shorter). All must be in the document, so of a window's shingles,
ordered by rarity, the first one is a prefix that every match has. Spark counts in how many documents each shingle of the
benchmark lies; the rarest of each window is its only join token. A document's shingle that is a join token proposes a
window and, by the token's place, a position; those that would reach over either end of the document are dropped, and the
rest is verified word by word.

The benchmark is a query set: it is taken in blocks of bounded size, and each block's index goes to all tasks. One block
marks the rows as they pass; of several, each writes what it finds before the next one's index is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written
from .textarrays import NOT_ALPHANUMERIC, Words, covered, freeing, take_ranges, text_bytes, windows, words
from .tokenizing import blocks

#: Bytes of benchmark texts whose index is sent to the tasks at once.
BLOCK_BYTES = 2 << 20
_SHINGLE = 3
_HITS = "array<struct<start:long,end:long>>"


def _words(column: pa.Array | pa.ChunkedArray) -> Words:
    return words(*text_bytes(column), NOT_ALPHANUMERIC, lower=True)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about 1 MB of text, so that a worker's arrays stay small; a longer text is a part of its own."""
    for batch in batches:
        for low, high in blocks(text_bytes(batch.column("text"))[1]):
            yield batch.slice(low, high - low)


class _Windows(NamedTuple):
    """Distinct item windows by length: their words' hashes (a row each), and which items have which window."""

    length: int
    words: np.ndarray
    window: np.ndarray
    item: np.ndarray


def item_windows(texts: pa.Array, width: int) -> list[_Windows]:
    found = _words(texts)
    size = np.diff(found.first)
    out = []
    for length in np.unique(np.minimum(size, width)):
        if not length:
            continue
        mine = np.flatnonzero(np.minimum(size, width) == length)
        many = size[mine] - length + 1
        at = take_ranges(found.first[mine], many)
        rows, index = np.unique(found.hash[at[:, None] + np.arange(length)], axis=0, return_inverse=True)
        out.append(_Windows(int(length), rows, index.ravel(), np.repeat(mine, many)))
    return out


def _shingles(w: _Windows) -> tuple[int, np.ndarray]:
    """The shingles' width, and their hashes: a row for each window."""
    k = min(_SHINGLE, w.length)
    first = np.arange(len(w.words) + 1) * w.length
    return k, windows(w.words.ravel(), first, k)[0].reshape(len(w.words), w.length - k + 1)


def document_frequency(docs: DataFrame, tokens: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """In how many documents each shingle lies. tokens: sorted hashes by shingle width."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(len(v), np.int64) for k, v in tokens.items()}
        for batch in _slices(batches):
            found = _words(batch.column("text"))
            doc = found.doc
            for k, known in tokens.items():
                hashes, at = windows(found.hash, found.first, k)
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[place] == hashes
                pairs = np.unique(doc[at[hit]] * len(known) + place[hit])
                sums[k] += np.bincount(pairs % len(known), minlength=len(known))
        for k, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(s[at])], names=["k", "token", "n"])

    out = {k: np.zeros(len(v), np.int64) for k, v in tokens.items()}
    totals = docs.select("text").mapInArrow(freeing(count), "k int, token long, n long").groupBy("k", "token").agg(F.sum("n").alias("n"))
    for row in totals.collect():  # at most the shingles of one block of the benchmark
        out[row["k"]][row["token"]] = row["n"]
    return out


class _Index(NamedTuple):
    """Join tokens of windows of one length: sorted tokens, each with a window and the token's place in it."""

    width: int
    length: int
    token: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    words: np.ndarray
    items_from: np.ndarray
    items: np.ndarray


def build_index(docs: DataFrame, texts: pa.Array, width: int) -> list[_Index]:
    """The index of a block of items; windows with a shingle that no document has are left out."""
    groups = [(w, *_shingles(w)) for w in item_windows(texts, width)]
    tokens = {k: np.unique(np.concatenate([s.ravel() for _, j, s in groups if j == k])) for k in {k for _, k, _ in groups}}
    often = document_frequency(docs, tokens) if tokens else {}
    out = []
    for w, k, shingles in groups:
        n = often[k][np.searchsorted(tokens[k], shingles)]
        offset = n.argmin(axis=1)
        alive = n.min(axis=1) > 0
        row = np.flatnonzero(alive)
        token = shingles[row, offset[row]]
        order = np.argsort(token, kind="stable")
        pairs = np.unique(np.column_stack([w.window, w.item]), axis=0)
        out.append(_Index(k, w.length, token[order], row[order], offset[row][order], w.words, np.searchsorted(pairs[:, 0], np.arange(len(w.words) + 1)), pairs[:, 1]))
    return out


def probe(found: Words, index: list[_Index]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are hit, and pairs of text and item that share a window."""
    hit = np.zeros(len(found.hash), bool)
    docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    doc_of = found.doc
    for x in index:
        if not len(x.token):
            continue
        hashes, at = windows(found.hash, found.first, x.width)
        low, high = np.searchsorted(x.token, hashes, side="left"), np.searchsorted(x.token, hashes, side="right")
        some = np.flatnonzero(high > low)
        entry = take_ranges(low[some], (high - low)[some])
        place = np.repeat(at[some], (high - low)[some])
        start = place - x.offset[entry]
        doc = doc_of[place]
        fits = (start >= found.first[doc]) & (start + x.length <= found.first[doc + 1])
        start, window, doc = start[fits], x.window[entry[fits]], doc[fits]
        same = (found.hash[start[:, None] + np.arange(x.length)] == x.words[window]).all(axis=1)
        start, window, doc = start[same], window[same], doc[same]
        hit |= covered(len(hit), start, x.length)
        pairs = np.unique(np.column_stack([doc, window]), axis=0)
        many = x.items_from[pairs[:, 1] + 1] - x.items_from[pairs[:, 1]]
        docs.append(np.repeat(pairs[:, 0], many))
        items.append(x.items[take_ranges(x.items_from[pairs[:, 1]], many)])
    return hit, np.concatenate(docs), np.concatenate(items)


def _probed(source: DataFrame, benchmark: DataFrame, width: int, item_column: str, item_text: str, block_bytes: int) -> DataFrame:
    """source (doc_id, text) with hits, items and n_words. Hits of several blocks are kept by a row number until all are known."""
    bench = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    n_blocks = max(1, -(-(bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    if n_blocks > 1:
        return _merged(source, bench, n_blocks, width)
    return _probed_by(source, bench, width)


def _merged(source: DataFrame, bench: DataFrame, n_blocks: int, width: int) -> DataFrame:
    """What all blocks find, joined to the rows; runs of hits that touch or overlap become one."""
    keyed = written(source.select(F.struct("doc_id", F.monotonically_increasing_id().alias("key")).alias("doc_id"), "text"))
    parts = []
    for block in range(n_blocks):
        found = _probed_by(keyed, bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block), width)
        parts.append(written(found.where(F.size("hits") > 0).select(F.col("doc_id.key").alias("of"), "hits", "items")))
    every = reduce(DataFrame.unionByName, parts).groupBy("of").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    start, end, hits = F.col("runs")[0]["start"], F.col("runs")[0]["end"], F.array().cast(_HITS)
    first = F.struct(start.alias("start"), end.alias("end"), hits.alias("out"))
    put = lambda a: F.array_append(a["out"], F.struct(a["start"].alias("start"), a["end"].alias("end")))
    merge = lambda a, h: F.when(h["start"] <= a["end"], F.struct(a["start"].alias("start"), F.greatest(a["end"], h["end"]).alias("end"), a["out"].alias("out"))).otherwise(F.struct(h["start"].alias("start"), h["end"].alias("end"), put(a).alias("out")))
    every = every.select("of", F.aggregate("runs", first, merge, put).alias("hits"), "items")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long")
    joined = keyed.join(every, F.col("doc_id.key") == F.col("of"), "left")
    return joined.select(F.col("doc_id.doc_id").alias("doc_id"), "text", F.coalesce("hits", F.array().cast(_HITS)).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), words.alias("n_words"))


def _probed_by(source: DataFrame, bench: DataFrame, width: int) -> DataFrame:
    """source with the hits of one block of items, and their items."""
    schema = T.StructType([*source.schema.fields, T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType())])
    rows = bench.collect()  # one block of the query set, of bounded size
    names = np.array([r["item"] for r in rows], object)
    index = build_index(source, pa.array([r["text"] for r in rows], pa.string()), width)
    return source.mapInArrow(freeing(_prober(index, names)), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, hits (runs of words in a benchmark window), items (ids, sorted) and contaminated.

    Words are runs of letters, digits and all non-ASCII characters, A-Z in lower case. A null or empty text has none, nor
    has an item without words any window. A null item id is the empty string; items of one id are one item. Rows that share
    a document id are judged apart. An empty benchmark hits nothing. Other columns are ignored.
    """
    state = _probed(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), benchmark, width, item_column, item_text, block_bytes)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return state.select("doc_id", "n_words", n_hit.alias("n_hit"), "hits", F.array_sort(F.array_distinct("items")).alias("items"), (F.size("hits") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_column: str = "text") -> DataFrame:
    """The rows without a word in a benchmark window, with their columns as they were."""
    names = [c for c in docs.columns if c != text_column]
    others = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).alias("doc_id")
    found = _probed(docs.select(others, F.col(f"`{text_column}`").alias("text")), benchmark, width, "item_id", "text", BLOCK_BYTES).where(F.size("hits") == 0)
    return found.select(*[F.col("text").alias(c) if c == text_column else F.col("doc_id").getField(f"c{names.index(c)}").alias(c) for c in docs.columns])


def _prober(index: list[_Index], names: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = _words(batch.column("text"))
            hit, doc, item = probe(found, index)
            hits, items = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for d in np.unique(doc):
                mine = hit[found.first[d] : found.first[d + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]]))).reshape(-1, 2)
                hits[d] = [{"start": int(a), "end": int(b)} for a, b in edges]
            for d, k in zip(doc.tolist(), item.tolist(), strict=True):
                items[d].append(names[k])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string())), pa.array(np.diff(found.first))], names=["doc_id", "text", "hits", "items", "n_words"])

    return run
