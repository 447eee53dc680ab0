"""The shared parts at sizes that small tables don't reach: many buckets, long words, hot tokens."""

import random

import edge
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalog.llm import chunks, jaccard_join
from stratalog.llm.decontamination import decontaminate
from stratalog.llm.jaccard_join import near_duplicates
from stratalog.llm.language_model import score_texts
from stratalog.llm.substring_dedup import repeated_intervals
from stratalog.llm.textarrays import WHITESPACE, text_bytes, words


def rows(df, *columns):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=edge.key)


@pytest.mark.parametrize(("entries", "fan"), [(1, 12), (40, 3)])
def test_more_buckets_than_a_chunk_sends_to(spark, monkeypatch, tmp_path, entries, fan):
    r = random.Random(4)
    more = [(1000 + k % 70, " ".join(r.choices([*edge.WORDS, "éa", "x1"], k=75))) for k in range(110)]
    few = edge.documents(spark, extra=False).where("length(text) < 1000 or text is null")
    docs = few.unionByName(spark.createDataFrame(more, few.schema)).repartition(7)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert docs.selectExpr("sum(octet_length(text)) div 5").first()[0] > 4096
    every = (
        lambda: rows(repeated_intervals(docs), "doc_id", "n_words", "n_removed", "kept_sha256"),
        lambda: rows(near_duplicates(docs, 4, 85), "doc_id", "n_shingles", "component_id"),
        lambda: rows(score_texts(docs), "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"),
    )[: 1 if fan == 12 else 3]
    want = [f() for f in every]
    monkeypatch.setattr(chunks, "BUCKET_ENTRIES", entries)
    monkeypatch.setattr(chunks, "FAN_BITS", fan)
    assert [f() for f in every] == want


def test_values_keep_their_bytes():
    r = np.random.default_rng(1)
    for v in (np.zeros(0, np.uint64), np.full(9, 7, np.uint64), np.full(3, 1 << 60, np.uint64), r.integers(0, 300, 99).astype(np.uint64), np.where(r.random(999) < 0.01, 1 << 40, 3).astype(np.uint64)):
        assert (chunks._grow(chunks._shrink(v)).astype(np.uint64) == v).all() and len(chunks._grow(chunks._shrink(v))) == len(v)
    keys = np.unique(r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    for bits, bucket in ((0, 0), (3, 5), (12, 77), (17, 9), (24, 70_000)):
        part = (keys >> np.uint64(bits)) | np.uint64((bucket << (64 - bits)) if bits else 0)
        for kept in (64, 48):
            mask = np.uint64(((1 << 64) - 1) ^ ((1 << (64 - kept)) - 1))
            assert (chunks._decode(memoryview(chunks._encode(part, bits, kept)), bucket, bits, kept) == part & mask).all()


def thue_morse(n, one, two):
    return "".join(two if bin(k).count("1") % 2 else one for k in range(n))


def test_words_of_one_structure_differ(spark):
    pairs = [(thue_morse(n, "a", "b"), thue_morse(n, "b", "a")) for n in (4, 64, 65, 1024, 4096)]
    texts = [w for p in pairs for w in p] + ["", "a", "a\0", "aaaaaaaa", "aaaaaaaa\0", "a" * 64, "a" * 65]
    found = words(*text_bytes(pa.array(texts)), WHITESPACE)
    assert len(set(found.hash.tolist())) == len(texts) - 1
    tail = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(k, f"{w} {tail}") for k, w in enumerate(w for p in pairs for w in p)], "doc_id long, text string")
    assert {r.n_removed for r in repeated_intervals(docs).collect()} == {0}
    bench = spark.createDataFrame([(1, f"{pairs[3][0]} {tail}")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate(docs, bench, width=13).collect()} == {k: 13 if k == 6 else 0 for k in range(10)}
    short = docs.selectExpr("doc_id", "substring_index(text, ' ', 4) as text")
    assert all(r.component_id == r.doc_id for r in near_duplicates(short, 4, 85).collect())
    alone = docs.selectExpr("7 as doc_id", "substring_index(text, ' ', 1) as text").where("text like 'abba%'")
    other = docs.selectExpr("-1 as doc_id", "substring_index(text, ' ', 1) as text").where("text like 'baab%'")
    both = score_texts(alone.unionByName(other), remainder=F.expr("case when doc_id = 7 then 2 else 1 end"))
    assert {r.n_known for r in both.where("held_out").collect()} == {1}


def test_hot_tokens_are_dealt_over_blocks(spark, monkeypatch):
    docs = edge.documents(spark)
    want = rows(near_duplicates(docs, 2, 50), "doc_id", "n_shingles", "component_id")
    monkeypatch.setattr(jaccard_join, "_BLOCK", 1)
    monkeypatch.setattr(jaccard_join, "_CLASS_BLOCK", 1)
    assert rows(near_duplicates(docs, 2, 50), "doc_id", "n_shingles", "component_id") == want
