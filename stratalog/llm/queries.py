"""The registered query of each operator, with production parameters over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .conversations import repair_conversations
from .decontamination import decontaminate
from .html_text import main_text
from .jaccard_join import near_duplicates
from .language_id import identify_languages
from .language_model import score_texts
from .packing import pack
from .periodic_runs import periodic_runs
from .pii import KINDS, as_text, find_pii
from .quality import BASE, measured
from .sharding import shard_records
from .substring_dedup import repeated_intervals
from .tables import shared_folder
from .token_files import read_shards, write_shards


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(spark: SparkSession, name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies: in the folder of the setting spark.stratalog.tokenizers, else the installed ones."""
    folder = spark.conf.get("spark.stratalog.tokenizers", None)
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_records(_read(spark, sf_dir, "documents"), weights=[1.0] * 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_read(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(_read(spark, sf_dir, "documents"), path, tokenizer_file(spark), end=2, base=1 << 16)
    return read_shards(spark.read.parquet(path))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_read(spark, sf_dir, "pages"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = measured(_read(spark, sf_dir, "documents"), names)
    base_failed = reduce(Column.__or__, [r.rejects(F.col) for r in BASE])
    return found.select("doc_id", *names, base_failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_intervals(_read(spark, sf_dir, "documents"), width=13, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), tokenizer_file(spark), end=1, capacity=4096)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    return identify_languages(_read(spark, sf_dir, "documents"), learn=fold != 2)


def planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts (by the checksum h of the id) repeats p of its words from word a on, to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    ws, n, a, p, g = (F.col(c) for c in ("ws", "n", "a", "p", "g"))
    split = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), split.alias("ws")).withColumn("n", F.size("ws"))
    docs = docs.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    repeated = F.slice(F.flatten(F.array_repeat(F.slice(ws, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return docs.select("doc_id", F.when(n > 0, F.array_join(F.concat(F.slice(ws, F.lit(1), a), repeated), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted_repeats(_read(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, exponent.alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def damaged_turns(rows: DataFrame) -> DataFrame:
    """Conversations with a quarter of their rows damaged, by a checksum of conv_id and turn; `there` is false for dropped ones."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"), changed.alias("text"), (kind != 0).alias("there"), F.when(kind == 3, 2).otherwise(1).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", "there", F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("col")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged_turns(_read(spark, sf_dir, "conversations")), F.col("there"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_rendezvous_sharding": op2_rendezvous_sharding,
    "op3_deleted_interpolation": op3_deleted_interpolation,
    "op4_token_files": op4_token_files,
    "op5_html_main_text": op5_html_main_text,
    "op6_pii": op6_pii,
    "op7_quality_cascade": op7_quality_cascade,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_bin_packing": op10_bin_packing,
    "op11_language_id": op11_language_id,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, byte by byte and bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: {bits}), 4294967295)"


def _edits_sql(state: int, user: bool, kept: str, fits: int) -> str:
    """The least (cost, letters, turns) before a row for a state of the grammar, without inserted turns."""
    role = "user" if user else "assistant"
    keep = " ".join(f"WHEN role[1] = '{i}' THEN {{'c': v{to}.c + t, 'a': 'K' || v{to}.a, 'x': list_prepend(role || ':' || text, v{to}.x)}}" for i, to in (x.split(">") for x in kept.split()))
    return f"""least({{'c': v{state}.c + 2, 'a': 'D' || v{state}.a, 'x': v{state}.x}},
        CASE WHEN gone THEN NULL ELSE {{'c': v{fits}.c + t + 1, 'a': 'R' || v{fits}.a, 'x': list_prepend('{role}:' || text, v{fits}.x)}} END,
        CASE WHEN gone THEN NULL {keep} END)"""


def _inserts_sql(state: int) -> str:
    """The least for a state with up to two inserted turns."""
    add = lambda v, role: f"{{'c': {v}.c + 5, 'a': 'I' || {v}.a, 'x': list_prepend('{role}:', {v}.x)}}"
    two = lambda v, r, s: f"{{'c': {v}.c + 10, 'a': 'II' || {v}.a, 'x': list_concat(['{r}:', '{s}:'], {v}.x)}}"
    if state == 2:
        return f"least(p2, {add('p3', 'assistant')}, {two('p2', 'assistant', 'user')})"
    return f"least(p{state}, {add('p2', 'user')}, {two('p3', 'user', 'assistant')})"


SQL = {
    "op1_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
               FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
        lens AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
               FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(ws) >= n)),
        hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
        hit AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_quality_cascade": rf"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
        rep AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n_repeat FROM (
                  SELECT doc_id, unnest(range(i, i + 5)) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
        lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM w),
        m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                     len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                     coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '!')) AS n_exclaims
              FROM w LEFT JOIN rep USING (doc_id) JOIN lines USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 35 * n_lines
                    OR 100 * n_upper > 40 * word_chars OR 2 * n_exclaims > n_words) AS kept
        FROM m""",
    "op8_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
        bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE doc_id > least),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM bad),
        pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM w),
        kept AS (SELECT pos.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY k) AS t FROM pos ANTI JOIN gone USING (doc_id, k) GROUP BY pos.doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op12_periodic_runs": rf"""
        WITH h AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
        g AS (SELECT r, doc_id, ws, h, len(ws) AS n, h // 10 AS g FROM h),
        a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
        w AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) ELSE ws END AS ws FROM p),
        pos AS (SELECT r, n, unnest(range(n)) AS i, unnest(ws) AS word FROM w),
        same AS (SELECT x.r, y.i - x.i AS q, x.i AS i FROM pos x JOIN pos y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
        isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same),
        stretch AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM isle GROUP BY r, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
        run AS (SELECT r, s, l, min(q) AS q FROM stretch GROUP BY r, s, l),
        text AS (SELECT r, count(*)::BIGINT AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY r),
        best AS (SELECT r, s, l, q FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY l / q DESC, s, q) = 1),
        gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
               sha256(coalesce(text.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
        FROM w LEFT JOIN text USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)""",
    "op13_conversation_repair": rf"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
        d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM d),
        f AS (SELECT *, CASE WHEN s = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(s, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                     coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au'), false) AS bad FROM o),
        e AS (SELECT *, fault IN ('b', 'd') AS gone, CASE fault WHEN 't' THEN 5 ELSE 0 END AS t FROM f),
        go AS (SELECT DISTINCT conv_id, n AS i, {{'c': 0, 'a': '', 'x': []::VARCHAR[]}} AS v0, {{'c': 10, 'a': 'II', 'x': ['user:', 'assistant:']}} AS v1, {{'c': 5, 'a': 'I', 'x': ['assistant:']}} AS v2, {{'c': 0, 'a': '', 'x': []::VARCHAR[]}} AS v3 FROM e
               UNION ALL
               SELECT conv_id, i, {", ".join(f"{_inserts_sql(s)} AS v{s}" for s in range(4))}
               FROM (SELECT conv_id, i - 1 AS i, {_edits_sql(0, True, "s>1 u>2", 2)} AS p0, {_edits_sql(1, True, "u>2", 2)} AS p1, {_edits_sql(2, False, "a>3", 3)} AS p2, {_edits_sql(3, True, "u>2", 2)} AS p3
                     FROM go JOIN e USING (conv_id, i))),
        sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (bad) AS illegal FROM e GROUP BY conv_id)
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
               coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.x, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN sums USING (conv_id) LEFT JOIN go ON go.conv_id = sums.conv_id AND go.i = 0""",
}
