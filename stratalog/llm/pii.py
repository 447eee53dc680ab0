"""Personal data in texts: fixed forms, and identifiers that contexts learnt from them reveal. DataFrame functions only.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers by their forms. They are the seeds of a
bootstrap: the two words before a seed are a lexical pattern, and looser forms after any pattern are candidate instances.
Patterns and instances form a graph. In each round a pattern's confidence in a kind is the sum of the scores in that kind of
the known instances that follow it, over the number of times the pattern stands in the corpus (or before an instance, if more).
Both count every occurrence in every row, so copies weigh alike. Patterns of enough known instances and confidence make
their candidates known, with the best confidence of their patterns as score; these may induce new patterns in the next
round. The last round's patterns mark their candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

KINDS = ("email", "ip", "card", "phone")

# A match starts at the first character that could start one: at a run's first character, or where the last match ended.
# Possessive repeats change no match and keep the matcher from recursing on long runs.
_FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NEEDS = {"email": ["@"], "phone": ["+"], "ip": ["."], "card": []}
#: Looser forms of candidates, tried only after a learnt pattern.
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|@) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z+.-])[0-9](?:[ -]?[0-9]){12,18}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14}+(?![0-9A-Za-z])",
}
_LOOSE_NEEDS = {"email": ["@", "[at]", "(at)"], "phone": [], "ip": [], "card": []}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_SPAN = "struct<kind:string,start:long,end:long,value:string,left:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    parts = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.try_cast("int"))).otherwise(c.try_cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"),
        "card": n.between(16, 19) & _luhn(value),
        "phone": n.between(8, 15),
    }[kind]


def _spans(text: Column, kind: str, form: str, needs: list[str]) -> Column:
    """All matches of a form: what lies between matches gives their places. A text with a match holds one of `needs`, if any."""
    none = F.array().cast(f"array<{_SPAN}>")
    pieces = F.zip_with(F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    words = lambda g: F.filter(F.split(g, r"\s+"), lambda w: w != "")
    near = lambda g: words(F.substring(g, -100, 100))
    tail = lambda g: F.when(F.size(near(g)) > 2, near(g)).otherwise(words(g))  # of three words, the last two are whole
    two = lambda ws: F.lower(F.array_join(F.slice(ws, F.greatest(F.size(ws) - 1, F.lit(1)), 2), " "))

    def add(a: Column, p: Column) -> Column:
        start = a["pos"] + F.length(p["g"])
        end = start + F.length(p["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), p["m"].alias("value"), two(tail(p["g"])).alias("left"))
        return F.when(p["m"].isNull(), a).otherwise(F.struct(end.cast("long").alias("pos"), F.array_append(a["out"], span).alias("out")))

    found = F.aggregate(pieces, F.struct(F.lit(0).cast("long").alias("pos"), none.alias("out")), add, lambda a: a["out"])
    some = text.rlike(form)
    if needs:
        some = reduce(Column.__or__, [text.contains(n) for n in needs]) & some
    return F.when(some, found).otherwise(none)


def _occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, and candidate spans that touch no base span."""
    text = F.coalesce(F.col("text"), F.lit(""))
    passing = lambda k: lambda s: _passes(k, s["value"])
    base = F.concat(*[F.filter(_spans(text, k, _FORMS[k], _NEEDS[k]), passing(k)) for k in KINDS])
    digits = text.rlike("[0-9]")
    loose = F.concat(*[F.when(F.lit(True) if k == "email" else digits, _spans(text, k, _LOOSE[k], _LOOSE_NEEDS[k])).otherwise(F.array().cast(f"array<{_SPAN}>")) for k in KINDS])
    df = docs.select("doc_id", base.alias("base"), loose.alias("loose"))
    free = F.filter("loose", lambda c: (c["left"] != "") & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return df.select("doc_id", "base", free.alias("loose"))


def _standing(docs: DataFrame, patterns: DataFrame, slots: int = 1 << 16) -> DataFrame:
    """(left, standing): how often each pattern's words stand side by side in the corpus.

    Each pattern sets one of `slots` bytes, by a hash. Words whose byte isn't set are no pattern; all others are counted
    before they meet the patterns, so neither the patterns' number nor a frequent one weighs on a task.
    """
    slot = F.pmod(F.xxhash64("left"), F.lit(slots)).cast("int")
    taken = bytearray(slots)
    for r in patterns.select(slot.alias("slot")).distinct().collect():  # at most `slots` rows
        taken[r["slot"]] = 1
    words = F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"\s+"), lambda w: w != "")
    pairs = docs.select(words.alias("w")).select(F.explode(F.expr("transform(sequence(1, greatest(1, size(w) - 1)), i -> concat_ws(' ', try_element_at(w, i), try_element_at(w, i + 1)))")).alias("left"))
    # Inner joins: Spark would push a semi join below the count, onto every pair of words.
    some = pairs.where(F.substring(F.lit(taken), slot + 1, F.lit(1)) == F.lit(bytearray(b"\1")))
    return some.groupBy("left").agg(F.count(F.lit(1)).alias("standing")).join(patterns, "left")


def learnt_patterns(docs: DataFrame, occurrences: DataFrame, seeds: int = 3, confidence: float = 0.6) -> DataFrame:
    """(left, kind, confidence) of the patterns that mark candidates.

    Such a pattern stands before at least `seeds` distinct known instances of the kind and has the confidence. Base spans
    are known; each round, the accepted patterns make the instances after them known, with which further patterns are
    induced. The rounds end when they accept no new pattern: none is lost again, for scores only rise.
    """
    part = lambda spans, seed: F.transform(spans, lambda s: F.struct(s["left"].alias("left"), s["kind"].alias("kind"), F.lower(s["value"]).alias("instance"), F.lit(seed).alias("seed")))
    spans = occurrences.select(F.explode(F.concat(part("base", True), part("loose", False))).alias("s")).select("s.*")
    edges = written(spans.where("left != ''").groupBy("left", "kind", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")))
    rich = written(edges.groupBy("left", "kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= seeds).select("left").distinct())
    if rich.isEmpty():
        return edges.select("left", "kind", F.lit(1.0).alias("confidence")).limit(0)
    edges = edges.join(rich, "left")
    places = occurrences.select(F.explode(F.array_distinct(F.transform(F.concat("base", "loose"), lambda s: F.struct(s["left"].alias("left"), s["start"].alias("start"))))).alias("s"))
    size = places.groupBy("s.left").agg(F.count(F.lit(1)).alias("places")).join(rich, "left")
    size = size.join(_standing(docs, rich), "left", "left").select("left", F.greatest("places", F.coalesce("standing", F.lit(0))).alias("size"))
    graph = written(edges.join(size, "left"))
    first = graph.where("seed").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    scores, before = first, 0
    while True:
        scored = graph.join(scores, ["instance", "kind"])
        sums = scored.groupBy("left", "kind").agg((F.sum(F.col("score") * F.col("n")) / F.first("size")).alias("confidence"), F.count(F.lit(1)).alias("known"))
        patterns = written(sums.where((F.col("known") >= seeds) & (F.col("confidence") >= confidence)))
        if (now := patterns.count()) == before:
            return patterns.select("left", "kind", "confidence")
        before = now
        found = graph.where("not seed").join(patterns, ["left", "kind"]).groupBy("instance", "kind").agg(F.max("confidence").alias("score"))
        scores = first.unionByName(found.join(first, ["instance", "kind"], "left_anti"))


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, base spans and all spans (kind, start, end in code points, end exclusive), by kind, then start.

    A null or empty text has no spans. Rows that share an id are judged apart. New spans touch no base span. An empty table
    gives an empty one. Other columns are ignored.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = written(_occurrences(source).withColumn("key", F.monotonically_increasing_id()))
    learnt = written(learnt_patterns(source, found).select("left", "kind"))
    candidates = found.select("key", F.explode("loose").alias("s")).select("key", "s.left", "s.kind", "s.start", "s.end")
    marks = written(candidates.join(learnt, ["left", "kind"]).groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("new")))
    new = F.coalesce("new", F.array().cast("array<struct<kind:string,start:long,end:long>>"))
    short = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    by_kind = lambda c: F.transform(F.array_sort(F.transform(c, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), short)
    base = F.transform("base", short)
    return found.join(marks, "key", "left").select("doc_id", base.alias("base"), by_kind(F.concat(base, new)).alias("spans"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows with each span replaced by its kind in angle brackets; overlapping spans become one, of the first's kind.

    All columns stay as they were; a null text stays null. Rows travel with their spans; new spans join them by a
    row number, and Spark shuffles texts for that only where the new spans are too many to broadcast.
    """
    columns = docs.columns
    at = columns.index(text_column)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    found = find_pii(docs.select(row.alias("row"), F.col(f"`{text_column}`").alias("text")), "row")
    rows = found.select(F.col("doc_id").alias("row"), F.col(f"doc_id.c{at}").alias("text"), "spans")

    def put(a: Column, s: Column) -> Column:
        tagged = F.concat(a["out"], F.substring(F.col("text"), a["pos"] + 1, s["start"] - a["pos"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["start"] < a["pos"], F.struct(F.greatest(a["pos"], s["end"].cast("int")).alias("pos"), a["out"].alias("out"))).otherwise(F.struct(s["end"].cast("int").alias("pos"), tagged.alias("out")))

    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["kind"].alias("kind"))))
    clean = F.aggregate(ordered, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), put, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["pos"] + 1, F.length("text"))))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(clean)
    return rows.select(*[(text if k == at else F.col("row").getField(f"c{k}")).alias(c) for k, c in enumerate(columns)])
