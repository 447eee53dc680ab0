"""Quality rules in a short-circuit cascade, in DataFrame functions only.

A rule rejects on measures of a text. On a bounded sample, each rule's cost is taken from warm runs, less those of a run that
measures nothing, and one job counts which rules reject which rows. The next rule is always the one that rejects most of the
rows left to it for each second. The cascade asks the rules in that order, row by row: a rule that rejects a document ends
it, and no later rule's measures are taken. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

_SPACE = r"[\x20\x09-\x0D]"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often `use` names it, and wherever the optimizer moves the whole."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return _let(F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), _SPACE + "+"), lambda w: F.when(w[0] == "", F.array().cast("array<string>")).otherwise(w))


def _left(text: Column, pattern: str) -> Column:
    """How many characters of the text the (negated) pattern leaves."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _repeats(words: Column, width: int = 5) -> Column:
    """Words in windows of `width` words found at least twice in the text.

    Windows are 64-bit hashes. Only texts in which one repeats sort them, with their places; the places of repeated windows,
    sorted, give the words covered without a word counting twice.
    """
    zero = F.lit(0).cast("long")
    same = lambda s, x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    of_words = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    hashes = lambda w: _let(of_words(w), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))
    again = lambda s: F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1))
    gaps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
    words_in = lambda p: F.aggregate(gaps(p), zero, lambda a, b: a + b)
    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    counted = lambda h: _let(placed(h), lambda s: _let(F.sort_array(F.transform(again(s), lambda x: x["i"])), words_in))
    repeated = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(counted(h))
    return F.when(F.size(words) <= width, zero).otherwise(_let(hashes(words), repeated))


#: What a measure is of a text (never null) and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda t, w: _left(t, "[^#*$%&|<>]+"),
    "n_lines": lambda t, w: F.size(_lines(t)).cast("long"),
    "n_dup_lines": lambda t, w: _let(_lines(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    "n_repeat_words": lambda t, w: _repeats(w),
    "n_upper": lambda t, w: _left(t, r"[^\p{Lu}]+"),
    "n_exclaims": lambda t, w: _left(t, "[^!]+"),
}


class Rule(NamedTuple):
    """A name, and the condition on which it rejects (never null), from a function that gives a measure by its name."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


#: Rules of the base, then those of the method. Thresholds lie far from running prose.
BASE = (
    Rule("few_words", lambda m: m("n_words") < 10),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
)
RULES = (
    *BASE,
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 35 * m("n_lines")),
    Rule("shouting", lambda m: 100 * m("n_upper") > 40 * m("word_chars")),
    Rule("exclaiming", lambda m: 2 * m("n_exclaims") > m("n_words")),
)


def _given(text: Column, words: Column, known: dict[str, Column]) -> Callable[[str], Column]:
    return lambda name: known[name] if name in known else MEASURES[name](text, words)


def needed(rule: Rule) -> set[str]:
    """The measures that a rule asks for."""
    names: set[str] = set()
    rule.rejects(lambda name: names.add(name) or F.lit(0))
    return names


def cascade(order: list[Rule], text: Column, words: Column, known: dict[str, Column]) -> Column:
    """The name of the first rule that rejects, or null. known: measures taken before; others are only taken for rows that reach a rule."""
    found = F
    for rule in order:
        found = found.when(rule.rejects(_given(text, words, known)), F.lit(rule.name))
    return found.otherwise(F.lit(None).cast("string")) if order else F.lit(None).cast("string")


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text", sample_rows: int = 2000, seed: int = 7, known: tuple[str, ...] = ()) -> list[Rule]:
    """The rules by rejections of rows left for each second, on a sample of about sample_rows rows; ties keep the given order.

    known: measures that every row has before the first rule. A rule costs what its other measures take; one without any is free.
    """
    total = docs.count()
    if not total:
        return list(rules)
    text = F.col("text")
    sample = docs.select(F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text")).sample(min(1.0, sample_rows / total), seed)
    # Words that every row has before the first rule are taken with its known measures, else with the first rule that needs them.
    had = {name: F.col(name) for name in known}
    words = (lambda then: _let(F.col("words"), then)) if known else (lambda then: _let(words_of(text), then))
    sample = written(sample.withColumn("m", _let(words_of(text), lambda w: F.struct(w.alias("words"), *[MEASURES[n](text, w).alias(n) for n in known]))).select("text", "m.*") if known else sample)
    asking = lambda rule: lambda w: rule.rejects(_given(text, w, had))
    rejects = [words(asking(rule)) for rule in rules]

    def seconds(condition: Column) -> float:
        job, took = sample.agg(F.count_if(condition)), []
        for _ in range(2):  # the first run compiles
            began = time.monotonic()
            job.first()
            took.append(time.monotonic() - began)
        return took[-1]

    asked = [needed(rule) <= set(known) for rule in rules]
    nothing = 0.0 if all(asked) else seconds(text.isNull())
    cost = [1e-3 if free else max(seconds(c) - nothing, 1e-3) for free, c in zip(asked, rejects)]
    left = {r["which"]: r["n"] for r in sample.groupBy(F.concat(*[c.cast("int").cast("string") for c in rejects]).alias("which")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each set of rules
    out: list[int] = []
    while len(out) < len(rules):
        rate = {k: sum(n for which, n in left.items() if which[k] == "1") / cost[k] for k in range(len(rules)) if k not in out}
        out.append(max(rate, key=lambda k: rate[k]))
        left = {which: n for which, n in left.items() if which[out[-1]] == "0"}
    return [rules[k] for k in out]


def measured(docs: DataFrame, names: tuple[str, ...], rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, the named measures, and rejected_by, the first rule in cascade order that rejects (or null).

    The named measures are taken of every row, all others only of rows that reach a rule. A null or empty text has no words
    and is rejected by a rule on few words. Repeated rows are judged alike. An empty table gives an empty one. Other columns
    are ignored.
    """
    order = ordered_rules(docs, rules, text_column, known=names)
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    taken = lambda t, w: F.struct(*[MEASURES[n](t, w).alias(n) for n in names])
    verdict = lambda t, w: _let(taken(t, w), lambda m: F.struct(*[m[n].alias(n) for n in names], cascade(order, t, w, {n: m[n] for n in names}).alias("rejected_by")))
    found = docs.select(F.col(f"`{id_column}`").alias("doc_id"), _let(text, lambda t: _let(words_of(t), lambda w: verdict(t, w))).alias("m"))
    return found.select("doc_id", *[F.col("m")[n].alias(n) for n in (*names, "rejected_by")])


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """The rows that no rule rejects, with their columns as they were, whatever their names.

    Null and empty texts go (no words). Repeated rows are judged alike, each kept or not. An empty table stays empty.
    """
    order = ordered_rules(docs, rules, text_column)
    return docs.where(_let(F.coalesce(F.col(f"`{text_column}`"), F.lit("")), lambda t: _let(words_of(t), lambda w: cascade(order, t, w, {}))).isNull())
