"""Removal of passages that an earlier document already has.

Rabin-Karp hashes of every window of `width` words are compared over the whole corpus in Spark (chunks.py). A window that
also starts in a document with a smaller id is removed; removed windows that overlap or touch merge into maximal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Merge, answers, pack, read_answers, unpack, with_answers
from .textarrays import WHITESPACE, covered, freeing, text_bytes, windows, words

_NO_ID = -(1 << 63)


def _windows_of(table: pa.Table, width: int):
    data, offsets = text_bytes(table.column("text"))
    found = words(data, offsets, WHITESPACE)
    hashes, at = windows(found.hash, found.first, width)
    return found, hashes, at


def repeated_intervals(docs: DataFrame, width: int = 13, id_column: str = "doc_id", text_column: str = "text", with_text: bool = True) -> DataFrame:
    """Per document: id, n_words, n_removed, intervals (start and end word, end exclusive) to remove, kept text and its SHA-256.

    with_text=False leaves kept_text null, for callers that need only the figures.

    A document whose id is null counts as the smallest id. Rows that share an id are one document's: what they share among
    themselves stays. A null or empty text has no words. Texts shorter than a window are kept whole. An empty table gives
    an empty one. Other columns of the input are ignored.
    """
    source = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_column).alias("text"))
    chunks = pack(source, ["id"])

    def items(table: pa.Table):
        found, hashes, at = _windows_of(table, width)
        ids = table.column("id").to_numpy()
        owner = ids[found.doc[at]] if len(at) else np.zeros(0, np.int64)
        keys, index = np.unique(hashes, return_inverse=True)
        return keys, earliest(index, len(keys), {"id": owner})

    def earliest(index: np.ndarray, n: int, values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, index, values["id"])
        return {"id": least}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                table = unpack(batch.column("docs")[k])
                found, hashes, at = _windows_of(table, width)
                ids = table.column("id").to_numpy()
                gone = np.zeros(0, np.int64)
                if len(at):
                    keys, index = np.unique(hashes, return_inverse=True)
                    earlier = read_answers(batch.column("answers"), k)[0]
                    owner = ids[found.doc[at]]
                    least = earliest(index, len(keys), {"id": owner})["id"]
                    gone = at[earlier[index] | (owner > least[index])]
                removed = covered(len(found.hash), gone, width)
                yield from _results(table, ids, found.first, removed)

    def _results(table: pa.Table, ids: np.ndarray, first: np.ndarray, removed: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = 1000
        texts = table.column("text")
        for low in range(0, len(ids), step):
            out: dict[str, list] = {name: [] for name in schema.names}
            for d, text in enumerate(texts.slice(low, step).to_pylist(), low):
                a, b = first[d], first[d + 1]
                mask = removed[a:b]
                n_removed = int(mask.sum())
                parts = (text or "").encode().split()
                if n_removed:
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    parts = list(compress(parts, ~mask))
                else:
                    edges = np.zeros(0, np.int64)
                kept = b" ".join(parts)
                row = (None if ids[d] == _NO_ID else int(ids[d]), int(b - a), n_removed, [{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)], kept.decode() if with_text else None, hashlib.sha256(kept).hexdigest())
                for name, value in zip(schema.names, row, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("intervals", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string()), ("kept_sha256", pa.string())])
    replies = answers(chunks, items, Merge(earliest, lambda mine, whole: [mine["id"] > whole["id"]]))
    return with_answers(chunks, replies).mapInArrow(freeing(cut), "doc_id long, n_words long, n_removed long, intervals array<struct<start:long,end:long>>, kept_text string, kept_sha256 string")
