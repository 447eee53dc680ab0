"""Periodic runs, conversations and languages against brute force, on tables of awkward cases and on empty ones."""

import hashlib
import heapq
import random
import re
import zlib

import edge
import numpy as np
from pyspark.sql import functions as F

from stratalog.llm.conversations import repair_conversations, repaired_turns
from stratalog.llm.language_id import distinct, fit, grams, identify_languages, kernel, scores
from stratalog.llm.periodic_runs import find_runs, periodic_runs
from stratalog.llm.queries import damaged_turns, op11_language_id, op12_periodic_runs, op13_conversation_repair


def plain_runs(words, least=24, times=3):
    """Every maximal stretch by comparing words, lag by lag."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def run_row(doc_id, words):
    runs = plain_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-1000003 * r[1] / r[2], r[0], r[2]), default=None)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(text), sha(kept))


def repetitive(r):
    """Words with runs side by side, inside one another, overlapping, broken, and just too short."""
    words = r.choices("abcdefgh", k=r.randrange(30))
    for _ in range(r.randrange(1, 5)):
        part = r.choices("abcdefghijkl"[: r.choice([1, 2, 12])], k=r.randrange(1, 14))
        words += (part * 40)[: r.randrange(10, 90)] + r.choices("abcxyz", k=r.choice([0, 0, 1, 9]))
    if r.random() < 0.3:
        words += words[-30:] * 3
    return words


def test_runs_of_words():
    r = random.Random(7)
    for _ in range(400):
        words = repetitive(r)
        want = plain_runs(words)
        assert [tuple(x) for x in find_runs([w.encode() for w in words])] == want
    assert find_runs([]) == [] and find_runs([b"a"] * 23) == []
    assert find_runs([b"a"] * 24) == [(0, 24, 1)] and find_runs([b"a", b"b"] * 12) == [(0, 24, 2)]
    assert find_runs(list(map(str.encode, "abcdefghi" * 3))) == [(0, 27, 9)] and find_runs(list(map(str.encode, ("abcdefghi" * 3)[:-1]))) == []


def test_periodic_runs_of_documents(spark, tmp_path):
    r = random.Random(11)
    docs = edge.documents(spark)
    texts = [(k * 7, " ".join(repetitive(r)), 1, "c", "t", "l", None, 0, "r", "x") for k in range(150)]
    texts += [(5000, "\tword " * 3000, 1, "c", "t", "l", None, 0, "r", "x")]
    docs = docs.unionByName(spark.createDataFrame(texts, edge.SCHEMA))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in edge.rows_of(docs):
        words = edge.space_words(text)
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        want.append(run_row(doc_id, words))
    got = [tuple(x) for x in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=edge.key) == sorted(want, key=edge.key)
    assert sum(w[1] > 0 for w in want) > 100


def test_long_texts_are_dealt_by_lags(spark):
    r = random.Random(3)
    docs = edge.documents(spark).unionByName(spark.createDataFrame([(k, " ".join(repetitive(r)), 1, "c", "t", "l", None, 0, "r", "x") for k in range(30)], edge.SCHEMA))
    one, many = (sorted((tuple(x) for x in periodic_runs(docs, long_bytes=size).collect()), key=edge.key) for size in (1 << 20, 100))
    assert one == many and any(x[2] for x in one)
    assert periodic_runs(edge.nothing(spark)).count() == 0


def cheapest(turns, found):
    """(cost, letters, repaired turns) by searching all edits in the order of cost and letters."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, at, roles, left = heapq.heappop(heap)
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, left
        if (at, roles[-2:]) in seen or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add((at, roles[-2:]))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, letters + "I", at, roles + role[0], (*left, (role, ""))))
        if at < len(turns):
            role, text = turns[at]
            heapq.heappush(heap, (cost + 2, letters + "D", at + 1, roles, left))
            if found[at] in ("", "truncated"):
                more = cost + 5 * (found[at] == "truncated")
                heapq.heappush(heap, (more, letters + "K", at + 1, roles + (role[:1] or "x"), (*left, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (more + 1, letters + "R", at + 1, roles + new[0], (*left, (new, text))))


def conversation(rows):
    """The contract's figures for (turn, role, text) in order."""
    turns, found, seen = [r[1:] for r in rows], [], set()
    for role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    cost, letters, left = cheapest(turns, found)
    known = {r[0] for r in rows if r[0] is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    text = "\n".join(f"{role}:{text}" for role, text in left)
    return (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), bad, cost, letters, hashlib.sha256(text.encode()).hexdigest()), left


def talks(seed=5):
    """Rows of awkward conversations; numbers may be null, repeated or far apart."""
    r = random.Random(seed)
    texts = ["One.", "Two!", "Three?", "four", "five ", "", " \t", "Six. \n", None, "\u00e9t\u00e9\u3002", "long " * 3000 + "end."]
    rows = []
    for conv in [*range(60), None]:
        number = 0
        for _ in range(r.choice([1, 2, 3, 5, 8, 13])):
            number += r.choice([1, 1, 1, 2, 40])
            rows.append((conv, r.choice([number, number, number, None]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), r.choice(texts) if r.random() < 0.5 else f"Text {r.randrange(99)}.", 1, "x"))
    rows += [rows[3], rows[3], (900, 1, "user", "Hello.", 1, "x"), (901, None, None, None, 1, "x")]
    return rows


TALKS = "conv_id long, turn long, role string, text string, there int, digest string"


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: sorted(x, key=lambda t: (t[0] is not None, t[0], t[1].encode(), t[2].encode())) for c, x in out.items()}


def test_repair_of_conversations(spark):
    rows = talks()
    df = spark.createDataFrame(rows, TALKS)
    want = {c: conversation(x) for c, x in by_conversation([x[:4] for x in rows]).items()}
    for limit in ({}, {"max_rows": 3}, {"max_bytes": 30, "max_rows": 100}):  # as a whole, in pieces, all of them in one piece
        got = {x[0]: tuple(x[1:]) for x in repair_conversations(df, **limit).collect()}
        assert {c: x[0] for c, x in want.items()} == got
        left = {}
        for x in repaired_turns(df, **limit).orderBy("turn").collect():
            left.setdefault(x.conv_id, []).append((x.turn, x.role, x.text))
        assert left == {c: [(k, *t) for k, t in enumerate(x[1])] for c, x in want.items() if x[1]}
    assert repair_conversations(spark.createDataFrame([], TALKS)).count() == repaired_turns(spark.createDataFrame([], TALKS)).count() == 0


def test_a_long_conversation_in_pieces_is_repaired_as_in_one(spark):
    r = random.Random(9)
    rows = [(1, k, r.choice(["user", "assistant"]), r.choice(["Same.", f"T{k}.", f"t{k}", ""])) for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, pieces = (repair_conversations(df, max_rows=n).collect() for n in (5000, 64))
    assert [tuple(x) for x in whole] == [tuple(x) for x in pieces]


def test_conversations_damaged_and_repaired(spark, tmp_path):
    rows = talks(8)
    spark.createDataFrame(rows, TALKS).write.parquet(f"{tmp_path}/conversations.parquet")
    left, ids = [], {x[0] for x in rows}
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        left += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    by = by_conversation(left)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    got = {x[0]: tuple(x[1:]) for x in op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: conversation(by[c])[0] if c in by else nothing for c in ids}
    dropped = damaged_turns(spark.createDataFrame(rows, TALKS)).where("NOT there").select("conv_id").subtract(damaged_turns(spark.createDataFrame(rows, TALKS)).where("there").select("conv_id"))
    assert all(got[x.conv_id] == nothing for x in dropped.collect())
    assert [tuple(x)[1:] for x in repair_conversations(damaged_turns(spark.createDataFrame(rows, TALKS)).withColumn("there", F.lit(False)), F.col("there"), max_rows=2).collect()] == [nothing] * len(ids)


SYLLABLES = {"en": "the ing th er ed of and", "de": "sch ein ung der keit \u00fc ver", "fr": "eau ou que \u00e9 ment la", "ru": "\u043f\u0440 \u043e\u0441\u0442 \u043d\u0430 \u0441\u0442 \u043e\u0432"}


def prose(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang].split(), k=r.choice([1, 2, 3]))) for _ in range(n)).capitalize() + "."


def test_string_kernel():
    r = random.Random(2)
    text = " Ab, 1-ab!\u00c9 "
    plain = " ab ab\u00e9 "
    want = {plain[i : i + n] for n in (1, 2, 3, 4) for i in range(len(plain) - n + 1)}
    slots = np.zeros(1 << 18, np.int32)
    found = distinct(grams(text), slots)
    assert len(found) == len(set(found)) == len(want) and set(found) == set(grams(text))
    sets = [np.unique(grams(prose(r, lang, 30))) for lang in ("en", "de", "fr") * 12]
    labels = ["en", "de", "fr"] * 12
    whole = kernel(sets, sets)
    assert all(abs(whole[i, j] - len(np.intersect1d(sets[i], sets[j])) / np.sqrt(len(sets[i]) * len(sets[j]))) < 1e-6 for i in range(36) for j in range(36))
    # With every text a landmark, Nystr\u00f6m's map is exact: the same as kernel ridge regression with a free constant.
    model = fit(sets, labels, 12, ridge=1e-2)
    new = [np.unique(grams(prose(r, lang, 8))) for lang in ("en", "de", "fr") * 3]
    n, target = len(sets), np.where(np.array(labels)[:, None] == np.array(["de", "en", "fr"]), 1.0, -1.0)
    system = np.block([[whole + 1e-2 * n * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    dual = np.linalg.solve(system, np.vstack([target, np.zeros((1, 3))]))
    assert np.allclose(scores(model, new), kernel(new, sets) @ dual[:-1] + dual[-1], atol=1e-3)


def test_languages_of_documents(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, prose(r, lang, r.choice([2, 9, 40, 400])), lang) for k, lang in enumerate(r.choices(list(SYLLABLES), weights=[8, 1, 1, 1], k=800))]
    odd = [(None, "the of the", "en"), (2001, None, "en"), (2002, "", "de"), (2003, " 12 \u00bd !?", "fr"), (2004, rows[0][1] * 2000, rows[0][2]), (2005, "Sche keit ung", None), (2005, "Sche keit ung", "de")]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows + odd], "doc_id long, text string, lang string, learn int, n_chars string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows + odd) and all(0 <= x.score <= 1 for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got if x.doc_id is not None)
    true = {k: lang for k, _, lang in rows}
    hit = [x.lang_pred == true[x.doc_id] for x in got if x.doc_id in true and x.held_out]
    assert len(hit) > 150 and sum(hit) >= 0.98 * len(hit)
    assert {x.lang_pred for x in got if x.doc_id in (2001, 2002, 2003)} == {"und"} and {x.lang_pred for x in got if x.doc_id == 2005} == {"de"}
    none = identify_languages(df, F.lit(False)).collect()
    assert {x.lang_pred for x in none} == {"und"} and all(x.held_out for x in none)
    other = df.withColumn("lang", F.when(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), "xx").otherwise(F.col("lang")))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 != 2
    key = lambda x: (str(x.doc_id), x.lang_pred, x.score)
    assert sorted(map(key, identify_languages(other, fold).collect())) == sorted(map(key, got))
    assert identify_languages(df.where("false"), F.lit(True)).count() == 0
