"""The corpus pipeline: each stage against a brute-force version, on a table of awkward cases, and all of them in a row."""

import collections
import re
import zlib

import edge
import numpy as np
import public_tokenizers
import pytest
from test_pages_and_pii import FORMS
from tokenizers import Tokenizer

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"p{k}" for k in range(12))


def kept_by_rules(text):
    w, t = edge.space_words(text), text or ""
    seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {i for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for i in range(k, k + 5)}
    lines = [x for x in t.split("\n") if edge.space_words(x)]
    chars = sum(map(len, w))
    return not (
        len(w) < 10 or 100 * len(again) > 20 * len(w) or 10 * len(re.findall(r"[#*$%&|<>]", t)) > len(w) or 100 * (len(lines) - len(set(lines))) > 35 * len(lines)
        or 100 * sum(c.isupper() for c in t) > 40 * chars or 2 * t.count("!") > len(w)
    )


def without_copies(rows):
    """Of each group linked by five-word shingles of similarity 0.8, the row with the least id, null being the greatest."""
    sets = []
    for r in rows:
        w = edge.space_words(r[1], True)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    return [rows[min((k for k in range(len(rows)) if group[k] == g), key=order)] for g in dict.fromkeys(group)]


def clean_of_passage(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(edge.LOWER))
    want = PASSAGE.split()
    windows = [want[k : k + 10] for k in range(3)]
    return not any(words[k : k + 10] in windows for k in range(len(words)))


def redacted(text):
    spans = sorted((m.start(), m.end(), k) for k, (p, ok) in FORMS.items() for m in re.finditer(p, text) if ok(m.group()))
    out, at = "", 0
    for start, end, kind in spans:
        if start >= at:
            out += text[at:start] + f"<{kind.upper()}>"
        at = max(at, end)
    return out + text[at:]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    rows = [(d, t, "en", "web" if k % 3 else None, len(t or "")) for k, (d, t) in enumerate(edge.rows_of(edge.documents(spark)))]
    more = "the quick brown fox jumps over one lazy dog and sees it run far away from home today"
    rows += [(500, f"{more} mail a@b.cd now", "en", "web", 1), (501, f"call +1 (803) 555-5351 when {more[4:]} or 1.2.3.4 then", "en", "web", 2), (502, f"{PASSAGE} {more[::-1]}", "de", "web", 3)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_stages_and_all_of_them(spark, tables):
    folder, rows = tables
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "decontamination", "pii", "packing"]

    def after(name, rows, tag):
        spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/{tag}")
        out = stages[name](spark, spark.read.parquet(f"{folder}/{tag}"), folder)
        assert name == "packing" or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        return [tuple(r) for r in out.collect()]

    want = [r for r in rows if kept_by_rules(r[1])]
    got = after("quality_rules", rows, "a")
    assert sorted(got, key=edge.key) == sorted(want, key=edge.key) and 10 < len(want) < len(rows)
    kept = without_copies(want)
    assert sorted(after("near_duplicates", want, "b"), key=edge.key) == sorted(kept, key=edge.key) and len(kept) < len(want)
    clean = [r for r in kept if clean_of_passage(r[1])]
    assert sorted(after("decontamination", kept, "c"), key=edge.key) == sorted(clean, key=edge.key) and len(clean) < len(kept)
    bare = [(d, redacted(t), lang, source, len(redacted(t))) for d, t, lang, source, _ in clean]
    assert sorted(after("pii", clean, "d"), key=edge.key) == sorted(bare, key=edge.key) and [r[1] for r in bare] != [r[1] for r in clean]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for d, t, *_ in bare:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        pieces += [(d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted((r[:5] for r in after("packing", bare, "e")), key=edge.key) == sorted(pieces, key=edge.key)
    assert sorted((tuple(r)[:5] for r in corpus_pipeline.run(spark, folder).collect()), key=edge.key) == sorted(pieces, key=edge.key)
