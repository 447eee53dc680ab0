"""Operators over documents against brute force, on a table of awkward cases and on an empty one."""

import collections
import hashlib
import math
import random
import re
import zlib

import edge
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratalog.llm.decontamination import clean_documents, decontaminate
from stratalog.llm.jaccard_join import near_duplicates, without_near_duplicates
from stratalog.llm.language_model import score_texts
from stratalog.llm.packing import lower_bound, pack, search
from stratalog.llm.quality import RULES, Rule, cascade, kept_documents, measured, needed, ordered_rules, words_of
from stratalog.llm.sharding import shard_records
from stratalog.llm.substring_dedup import repeated_intervals
from stratalog.llm.token_files import compress, expand, read_shards, rule_sizes, slice_of_document, write_shards
from stratalog.llm.tokenizing import Encoder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_decontamination(spark):
    docs = edge.documents(spark)
    bench = spark.createDataFrame([(1, " ".join(f"P{k}" for k in range(5, 20))), (2, "one!"), (3, None), (4, "..."), (10, "the THE"), (10, "two words"), (None, "tail")], "item_id long, text string")
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: cut.findall((t or "").translate(edge.LOWER))
    items = [("" if i is None else str(i), tuple(w[k : k + min(10, len(w))])) for i, t in bench.collect() for w in [words(t)] if w for k in range(len(w) - min(10, len(w)) + 1)]
    want = []
    for d, t in edge.rows_of(docs):
        w, hit, ids = words(t), set(), set()
        for i, g in items:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    ids.add(i)
        want.append((d, len(w), len(hit), sorted(ids), bool(hit)))
    for size in (1 << 20, 20):  # one block, and several
        got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate(docs, bench, block_bytes=size).collect()]
        assert sorted(got, key=edge.key) == sorted(want, key=edge.key)
    clean = clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[4] for x in want)
    assert decontaminate(edge.nothing(spark), bench).count() == 0
    assert decontaminate(docs, bench.where("false")).where("contaminated").count() == 0


def test_sharding(spark):
    docs = edge.documents(spark)
    out = shard_records(docs, [1.0] * 40).collect()
    for r in out:
        k = "" if r.doc_id is None else str(r.doc_id)
        h = [int(hashlib.md5(f"{k}:{s}".encode()).hexdigest()[:13], 16) for s in range(41)]
        assert r.shard == h[:40].index(max(h[:40])) and r.grown_shard == (40 if h[40] > max(h[:40]) else r.shard)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in edge.rows_of(docs)), key=edge.key)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=edge.key) == want
    assert shard_records(edge.nothing(spark), [1.0] * 3).count() == 0
    heavy = shard_records(spark.range(4000).selectExpr("id as doc_id", "'' as text"), [1.0, 3.0], grown=None)
    assert abs(heavy.where("shard = 1").count() / 4000 - 0.75) < 0.04 and heavy.where("grown_shard is not null").count() == 0


def test_language_model(spark):
    docs = edge.documents(spark)
    rows = edge.rows_of(docs)
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7
    count = collections.Counter(w for d, t in rows if fold(d) != 2 for w in [*edge.space_words(t, True), None])
    n, v = sum(count.values()), len(count)
    want = [(d, fold(d) == 2, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for d, t in rows for w in [[*edge.space_words(t, True), None]]]
    out = score_texts(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=edge.key) == sorted(want, key=edge.key)
    assert all(r.score < 0 for r in out)
    assert score_texts(edge.nothing(spark)).count() == 0


def brute_scores(rows, rounds=1000):
    """Scores by plain counting: estimates of the pair, the word and any word, mixed by weights learnt on the deleted fold."""
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7
    tokens = [(fold(d), list(zip(["<begin>", *w], [*w, "<end>"], strict=True))) for d, t in rows for w in [edge.space_words(t, True)]]

    def counted(folds):
        word, context, pair = collections.Counter(), collections.Counter(), collections.Counter()
        for f, pairs in tokens:
            if f in folds:
                word.update(w for _, w in pairs)
                context["<begin>"] += 1
                pair.update(pairs)
        for w, n in word.items():
            context[w] = n
        return word, context, pair

    whole, rest = counted({0, 1, 3, 4, 5, 6}), counted({0, 1, 3, 4, 5})
    uniform = 1 / (len(whole[0]) + 1)

    def shares(counts, c, w):
        word, context, pair = counts
        return (pair[c, w] / max(context[c], 1), word[w] / max(sum(word.values()), 1), uniform), int(math.log2(context[c] + 1))

    weights = collections.defaultdict(lambda: [1 / 3] * 3)
    held = [shares(rest, c, w) for f, pairs in tokens if f == 6 for c, w in pairs]
    for _ in range(rounds):
        sums = collections.defaultdict(lambda: [1e-3] * 3)
        for estimates, bucket in held:
            mixed = [a * b for a, b in zip(estimates, weights[bucket], strict=True)]
            sums[bucket] = [s + m / sum(mixed) for s, m in zip(sums[bucket], mixed, strict=True)]
        new = {b: [x / sum(v) for x in v] for b, v in sums.items()}
        moved = max((abs(x - y) for b, v in new.items() for x, y in zip(v, weights[b], strict=True)), default=0)
        weights.update(new)
        if moved < 1e-4:
            break
    out = []
    for (d, _), (_, pairs) in zip(rows, tokens, strict=True):
        found = [shares(whole, c, w) for c, w in pairs]
        out.append((d, round(sum(math.log10(sum(a * b for a, b in zip(e, weights[k], strict=True))) for e, k in found), 5)))
    return out


def test_language_model_scores(spark):
    docs = edge.documents(spark).where("length(text) < 3000 or text is null")
    got = [(r.doc_id, round(r.score, 5)) for r in score_texts(docs).collect()]
    assert sorted(got, key=edge.key) == sorted(brute_scores(edge.rows_of(docs)), key=edge.key)


def test_language_model_beats_its_base_on_held_out_texts(spark):
    r = random.Random(3)
    follow = {w: r.choices(edge.WORDS, k=3) for w in edge.WORDS}
    rows = []
    for k in range(400):
        w = [r.choice(edge.WORDS)]
        while len(w) < 40:
            w.append(r.choice(follow[w[-1]]))
        rows.append((k, " ".join(w)))
    held = score_texts(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(x.score for x in held) > 0.6 * sum(x.base_score for x in held)


def test_tokens_are_the_library_s(spark):
    r = random.Random(1)
    signs = "aAbB''s t're 12 .,!<|>÷×éÉßİΣσ̸́=“”ﬁ\x00\x1c\x85\xa0 ªº_~-@#'ll'S \U0001f600"
    texts = [t or "" for t in edge.texts()] + ["".join(r.choices(signs, k=r.randint(0, 60))) for _ in range(1500)]
    import pyarrow as pa

    from stratalog.llm.textarrays import text_bytes

    encoder = Encoder(TOKENIZER)
    for _ in range(2):  # unknown pieces, then known ones
        ids, first = encoder.encode(*text_bytes(pa.array(texts)))
        for k, e in enumerate(encoder.library.encode_batch(texts, add_special_tokens=False)):
            assert ids[first[k] : first[k + 1]].tolist() == e.ids, texts[k]


def test_grammar_round_trip():
    r = random.Random(2)
    lengths = [r.choice([1, 2, 50, 400]) for _ in range(60)]
    ids = np.array([r.choice([7, 7, 7, 8, 9, 40_000]) for _ in range(sum(lengths))], np.uint32)
    first = np.cumsum(lengths) - lengths
    symbols, starts, left, right = compress(ids, first, 1 << 16, least=4)
    assert (expand(symbols, left, right, 1 << 16) == ids).all() and len(symbols) < len(ids) / 2
    row = {"symbols": symbols, "doc_symbols": np.diff(starts).astype(np.uint32), "left": left, "right": right, "base": 1 << 16, "rule_tokens": rule_sizes(left, right, 1 << 16).astype(np.uint32)}
    for _ in range(300):
        d = r.randrange(60)
        a = r.randrange(lengths[d])
        b = r.randint(a + 1, lengths[d])
        assert (slice_of_document(row, d, a, b) == ids[first[d] + a : first[d] + b]).all()
    assert len(compress(np.zeros(0, np.uint32), np.zeros(0, np.int64), 9)[0]) == 0


def test_token_files(spark, tmp_path):
    docs = edge.documents(spark)
    write_shards(docs, f"{tmp_path}/shards", TOKENIZER, end=2, base=1 << 16, partition_bytes=4000)
    got = read_shards(spark.read.parquet(f"{tmp_path}/shards")).collect()
    library = Tokenizer.from_file(TOKENIZER)
    rows = sorted(edge.rows_of(docs), key=lambda x: (x[0] is not None, x[0], x[1] is not None, x[1] or ""))
    want, start = [], 0
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=edge.key) == sorted(want, key=edge.key)
    write_shards(edge.nothing(spark), f"{tmp_path}/none", TOKENIZER, end=2, base=1 << 16)
    assert read_shards(spark.read.parquet(f"{tmp_path}/none")).count() == 0


def test_quality(spark):
    docs = edge.documents(spark)
    want = []
    for d, t in edge.rows_of(docs):
        w, t = edge.space_words(t), t or ""
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {i for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for i in range(k, k + 5)}
        lines = [x for x in t.split("\n") if edge.space_words(x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = measured(docs, names).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out), key=edge.key) == sorted(want, key=edge.key)
    kept = kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.rejected_by is None for r in out) > 0
    assert kept_documents(edge.nothing(spark)).count() == 0 and len({r.name for r in RULES}) == len(RULES)
    clash = docs.withColumnsRenamed({"n": "n_words", "label": "n_upper", "row": "_words", "left": "m", "token": "rejected_by"})
    assert kept_documents(clash).count() == kept.count() and sorted(map(repr, measured(clash, names).collect())) == sorted(map(repr, out))


def test_later_rules_see_survivors_only(spark):
    docs = spark.createDataFrame([(k, "x" * (k % 7)) for k in range(200)] + [(900, None)], "doc_id long, text string")
    cheap = Rule("cheap", lambda m: m("n_words") < 1)
    picky = Rule("picky", lambda m: F.when(m("n_words") < 1, F.raise_error(F.lit("asked of a rejected row")).cast("boolean")).otherwise(m("word_chars") > 3))
    t = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", cascade([cheap, picky], t, words_of(t), {}).alias("by")).collect()
    assert all(r.by == ("cheap" if r.doc_id % 7 == 0 or r.doc_id == 900 else "picky" if r.doc_id % 7 > 3 else None) for r in found)
    with pytest.raises(Exception, match="asked of a rejected row"):
        docs.select(cascade([picky, cheap], t, words_of(t), {}).alias("by")).collect()


def test_rules_are_ordered_by_what_they_reject(spark):
    docs = spark.createDataFrame([(k, "a b c" if k % 2 else "A! B! C!") for k in range(400)], "doc_id long, text string")
    none, half, same = Rule("none", lambda m: m("n_words") < 0), Rule("half", lambda m: m("n_exclaims") > 0), Rule("same", lambda m: m("n_upper") > 0)
    slow = Rule("slow", lambda m: m("n_repeat_words") > 9**9)
    assert needed(slow) == {"n_repeat_words"} and needed(half) == {"n_exclaims"}
    # What every row has costs nothing: so its rule comes first; a slow one that rejects nothing comes last.
    assert [r.name for r in ordered_rules(docs, (slow, same, half), sample_rows=400, known=("n_upper",))][0] == "same"
    assert [r.name for r in ordered_rules(docs, (slow, half), sample_rows=400)] == ["half", "slow"]
    names = [r.name for r in ordered_rules(docs, (none, half, same), sample_rows=400)]
    assert names[0] in ("half", "same") and names[1] == "none"  # the third rejects none of what is left


def test_substring_dedup(spark):
    docs = edge.documents(spark)
    rows = edge.rows_of(docs)
    number = lambda d: -math.inf if d is None else d
    least = {}
    for d, t in rows:
        w = edge.space_words(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(least.get(g, math.inf), number(d))
    want = []
    for d, t in rows:
        w = edge.space_words(t)
        gone = {i for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < number(d) for i in range(k, k + 13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    got = repeated_intervals(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in got), key=edge.key) == sorted(want, key=edge.key)
    assert all(r.n_removed == sum(x.end - x.start for x in r.intervals) for r in got)
    assert repeated_intervals(edge.nothing(spark)).count() == 0


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_near_duplicates(spark, width, percent):
    docs = edge.documents(spark)
    rows = [(math.inf if d is None else d, t) for d, t in edge.rows_of(docs)]
    sets = []
    for _, t in rows:
        w = edge.space_words(t, True)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    number = lambda x: -math.inf if x == math.inf else x
    first = {g: min(number(rows[k][0]) for k in range(len(rows)) if group[k] == g) for g in group}
    want = [(number(d), len(s), first[g]) for (d, _), s, g in zip(rows, sets, group, strict=True)]
    got = [(-math.inf if r.doc_id is None else r.doc_id, r.n_shingles, -math.inf if r.component_id is None else r.component_id) for r in near_duplicates(docs, width, percent).collect()]
    assert sorted(got) == sorted(want)


def test_one_of_each_group_stays(spark, tmp_path):
    docs = edge.documents(spark)
    groups = len({(r["class"], r.component_id) if not r.n_shingles else r.component_id for r in near_duplicates(docs.where("doc_id not in (0, 12)")).collect() if r.n_shingles})
    empty = sum(not edge.space_words(t) for d, t in edge.rows_of(docs) if d not in (0, 12, None))
    out = without_near_duplicates(docs.where("doc_id not in (0, 12)"))
    assert out.columns == docs.columns and out.count() == groups + empty
    docs.write.parquet(f"{tmp_path}/docs")
    assert without_near_duplicates(spark.read.parquet(f"{tmp_path}/docs")).count() == without_near_duplicates(docs).count()
    assert without_near_duplicates(edge.nothing(spark)).count() == 0


def test_packing(spark):
    docs = edge.documents(spark)
    out = pack(docs, TOKENIZER, capacity=64).collect()
    library = Tokenizer.from_file(TOKENIZER)
    want = []
    for d, t in edge.rows_of(docs):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    assert sorted((tuple(r)[:5] for r in out), key=edge.key) == sorted(want, key=edge.key)
    place = collections.defaultdict(list)
    for r in out:
        place[r.sequence_id].append((r.offset, r.length))
    for spans in place.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 64
    assert pack(edge.nothing(spark), TOKENIZER).count() == 0


def test_packing_search():
    r = random.Random(8)
    for _ in range(20):
        counts = collections.Counter(r.randint(1, 40) for _ in range(r.randint(0, 60)))
        plan = search(dict(counts), 40)
        used = collections.Counter()
        for filling, times in plan:
            assert sum(filling) <= 40
            for k in filling:
                used[k] += times
        assert used == counts
    assert sum(n for _, n in search({6: 2, 5: 2, 4: 2, 3: 2}, 9)) == 4


def test_packing_fills_sequences_with_short_pieces():
    for counts, capacity in (({1: 1_000_000}, 4096), ({1: 5000, 2: 40_000, 3: 7}, 4096), ({4000: 3, 1: 100_000}, 4096)):
        total = sum(k * n for k, n in counts.items())
        plan = search(counts, capacity)
        assert sum(n for _, n in plan) == -(-total // capacity)
        assert sum(n * sum(f) for f, n in plan) == total


def fewest_by_exhaustion(items, capacity):
    best = [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= items[k] and rooms[j] not in rooms[:j]:
                place(k + 1, [*rooms[:j], rooms[j] - items[k], *rooms[j + 1 :]])
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best[0]


def test_packing_is_the_best_on_small_tables():
    r = random.Random(1)
    for _ in range(600):
        capacity = r.choice([9, 10, 17, 30, 100])
        items = [r.randint(1, capacity) if r.random() < 0.3 else r.randint(max(1, capacity // 6), capacity * 2 // 3) for _ in range(r.randint(0, 9))]
        want = fewest_by_exhaustion(sorted(items, reverse=True), capacity)
        counts = dict(collections.Counter(items))
        assert lower_bound(counts, capacity) <= want == sum(n for _, n in search(counts, capacity)), (capacity, items)


def test_short_documents_share_sequences(spark):
    out = pack(spark.range(5000).selectExpr("id as doc_id", "cast(null as string) as text"), TOKENIZER)
    assert out.select("sequence_id").distinct().count() == 2
