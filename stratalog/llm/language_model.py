"""Bigram language model by deleted interpolation, learnt from and applied to a whole corpus.

A token's probability after a context mixes the maximum-likelihood estimates of the bigram and of the word with a uniform
one. The weights depend on how often the context was seen (buckets by powers of two). They are learnt by expectation-
maximisation on one fold of the training documents, with that fold deleted from the counts; scoring then uses all counts.
Counts of all words and bigrams are summed in Spark over hash buckets and answered to the chunks that hold them (chunks.py).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import Merge, answers, pack, read_answers, summed, unpack, with_answers
from .tables import written
from .textarrays import WHITESPACE, freeing, mix, text_bytes, words

_END, _BEGIN = np.uint64(0x1D8E4E27C47D124F), np.uint64(0x3C6EF372FE94F82B)
_REST, _DELETED, _HELD_OUT = 0, 1, 2
_BUCKETS = 64


class _Tokens(NamedTuple):
    """Keys of the words, of their contexts, and of both, token by token; first: each document's first token, and the count.

    Even keys are words'; odd ones are bigrams' and that of a text's begin.
    """

    word: np.ndarray
    context: np.ndarray
    pair: np.ndarray
    first: np.ndarray


def _tokens(table: pa.Table) -> _Tokens:
    found = words(*text_bytes(table.column("text")), WHITESPACE, lower=True)
    n = len(found.first) - 1
    hashes = np.insert(found.hash, found.first[1:], np.full(n, _END))
    first = found.first + np.arange(n + 1)
    even = hashes & ~np.uint64(1)
    context = np.empty_like(even)
    context[1:] = even[:-1]
    context[first[:-1]] = _BEGIN | np.uint64(1)
    pair = mix(context * np.uint64(0x9FB21C651E98DF25) + even) | np.uint64(1)
    return _Tokens(even, context, pair, first)


def _keys(t: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """All keys with how often each comes; a context other than the begin is counted as a word."""
    begins = np.full(len(t.first) - 1, _BEGIN | np.uint64(1))
    return np.unique(np.concatenate([t.word, t.pair, begins]), return_counts=True)


def _shares(pair: np.ndarray, context: np.ndarray, word: np.ndarray, total: float, uniform: float) -> tuple[np.ndarray, np.ndarray]:
    """The three estimates (a row each token) and the bucket of the context's count."""
    estimates = np.column_stack([pair / np.maximum(context, 1), word / max(total, 1), np.full(len(word), uniform)])
    return estimates, np.floor(np.log2(context + 1.0)).astype(np.int64)


def score_texts(docs: DataFrame, remainder: Column | None = None, held_out: int = 2, deleted: int = 6, folds: int = 7, id_column: str = "doc_id", text_column: str = "text", rounds: int = 1000) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (Laplace unigram) and score, as log10.

    remainder: each document's fold; by default the CRC-32 of the id's text modulo `folds`. Documents of fold `held_out`
    teach nothing; those of fold `deleted` also serve the weights. A null text is empty: its one token is the end. A null id
    counts as an empty text. Rows of one id are scored apart. Where no document is in the deleted fold, the weights are
    equal. An empty table gives an empty one. Other columns are ignored. Weights are learnt until none moves by 1e-4; should `rounds`
    not do, that is an error.
    """
    fold = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds if remainder is None else remainder
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), fold.alias("fold"))
    part = F.when(F.col("fold") == held_out, _HELD_OUT).when(F.col("fold") == deleted, _DELETED).otherwise(_REST)
    parts = [pack(source.where(part == p).withColumn("part", F.lit(p)), ["id", "part"]).withColumn("part", F.lit(p)) for p in (_REST, _DELETED, _HELD_OUT)]
    chunks = parts[0].unionByName(parts[1]).unionByName(parts[2])

    def items(table: pa.Table):
        keys, counts = _keys(_tokens(table))
        part, counts = table.column("part")[0].as_py(), counts.astype(np.uint64)
        return keys, {"train": counts * (part != _HELD_OUT), "fold": counts * (part == _DELETED)}

    def report(keys: np.ndarray, whole: dict[str, np.ndarray]) -> list[float]:
        even = (keys & np.uint64(1)) == 0
        return [(even & (whole["train"] > 0)).sum(), whole["train"][even].sum(), whole["fold"][even].sum()]

    replies = written(answers(chunks.drop("part"), items, Merge(summed, lambda mine, whole: [whole["train"], np.where(mine["fold"] > 0, whole["fold"], 0)], report)))
    sums = replies.where(F.size("extra") > 0).agg(*[F.sum(F.col("extra")[k]) for k in range(3)]).first()
    n_words, n_train, n_deleted = (float(x or 0) for x in sums)
    weights = _learn(with_answers(parts[_DELETED], replies.join(parts[_DELETED].select("chunk"), "chunk", "left_semi")), n_train - n_deleted, 1 / (n_words + 1), rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                table = unpack(batch.column("docs")[k])
                tokens = _tokens(table)
                keys, _ = _keys(tokens)
                total = read_answers(batch.column("answers"), k)[0].astype(np.float64)
                word, context, pair = (total[np.searchsorted(keys, x)] for x in (tokens.word, tokens.context, tokens.pair))
                estimates, bucket = _shares(pair, context, word, n_train, 1 / (n_words + 1))
                logs = np.log10((estimates * weights[bucket]).sum(axis=1))
                base = np.log10((word + 1) / (n_train + n_words + 1))
                at = tokens.first[:-1]
                add = lambda x: pa.array(np.add.reduceat(x, at))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    table.column("id").combine_chunks(), pa.array(table.column("part").to_numpy() == _HELD_OUT), pa.array(np.diff(tokens.first)),
                    add((word > 0).astype(np.int64)), pa.array(np.full(len(at), int(n_train))), add(base), add(logs),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_answers(chunks, replies).mapInArrow(freeing(score), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _learn(deleted: DataFrame, total: float, uniform: float, rounds: int) -> np.ndarray:
    """The weights of the three estimates for each bucket, by expectation-maximisation over the deleted fold's counts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tokens = _tokens(unpack(batch.column("docs")[k]))
                keys, _ = _keys(tokens)
                every, fold = read_answers(batch.column("answers"), k)
                rest = every.astype(np.int64) - fold.astype(np.int64)
                rows = np.column_stack([rest[np.searchsorted(keys, x)] for x in (tokens.pair, tokens.context, tokens.word)])
                order = np.lexsort(rows.T)
                rows = rows[order]
                begins = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
                counts = np.diff(np.append(begins, len(rows)))
                table = np.column_stack([rows[begins], counts]).T.astype(np.uint32)
                yield pa.RecordBatch.from_pydict({"n": [len(begins)], "counts": pa.array([zstandard.compress(table.tobytes(), 1)], pa.binary())})

    held = written(deleted.mapInArrow(freeing(gather), "n long, counts binary"))
    weights = np.full((_BUCKETS, 3), 1 / 3)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((_BUCKETS, 3))
        for batch in batches:
            for k in range(batch.num_rows):
                pair, context, word, n = np.frombuffer(zstandard.decompress(batch.column("counts")[k].as_py()), np.uint32).reshape(4, -1).astype(np.float64)
                estimates, bucket = _shares(pair, context, word, total, uniform)
                share = estimates * weights[bucket]
                share *= (n / share.sum(axis=1))[:, None]
                for j in range(3):
                    sums[:, j] += np.bincount(bucket, weights=share[:, j], minlength=_BUCKETS)
        some = np.flatnonzero(sums.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(sums[some, j]) for j in range(3))], names=["bucket", "a", "b", "c"])

    for _ in range(rounds):
        moved = 0.0
        for row in held.mapInArrow(freeing(expect), "bucket long, a double, b double, c double").groupBy("bucket").agg(F.sum("a"), F.sum("b"), F.sum("c")).collect():  # at most 64 rows
            new = np.array(row[1:]) + 1e-3
            new /= new.sum()
            moved = max(moved, float(np.abs(new - weights[row[0]]).max()))
            weights[row[0]] = new
        if moved < 1e-4:
            return weights
    raise RuntimeError(f"the weights still move after {rounds} rounds")
