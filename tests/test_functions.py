"""The rules for missing values, ties, fractions, texts and languages, each on a small table."""

from pyspark.sql import functions as F

from stratalog.functions import formats, predicates, statistics
from stratalog.functions.languages import language_of_name, language_of_path, ordinal


def column(spark, kind, values, expression):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(expression(F.col("v"))).collect()]


def test_thresholds_and_missing(spark):
    stars = [5, 10, None]
    assert column(spark, "long", stars, lambda v: predicates.at_least(v, 10)) == [False, True, True]
    assert column(spark, "long", stars, lambda v: predicates.more_than(v, 5)) == [False, True, True]
    assert column(spark, "long", stars, lambda v: predicates.at_least(v, 10, missing=False)) == [False, True, False]
    assert column(spark, "long", stars, lambda v: predicates.less_than(v, 10)) == [True, False, False]
    assert column(spark, "long", stars, lambda v: predicates.at_most(v, 10)) == [True, True, False]
    assert column(spark, "long", stars, lambda v: predicates.negated(v == 5)) == [False, True, True]


def test_arrays_empty_and_missing(spark):
    arrays = [[], None, [1], [1, None]]
    assert column(spark, "array<int>", arrays, lambda v: predicates.all_in(v, [1])) == [True, False, True, False]
    assert column(spark, "array<int>", arrays, lambda v: predicates.any_in(v, [2])) == [False] * 4
    assert column(spark, "array<int>", arrays, lambda v: predicates.within(v, 1)) == [False, False, True, True]
    assert column(spark, "array<int>", arrays, lambda v: predicates.all_within(v, [])) == [True] * 4
    assert column(spark, "array<int>", arrays, lambda v: predicates.all_within(v, [1])) == [False, False, True, True]
    assert column(spark, "array<int>", arrays, statistics.count) == [0, 0, 1, 2]
    assert column(spark, "array<int>", arrays, statistics.count_or_missing) == [0, None, 1, 2]


def test_median_and_mean(spark):
    arrays = [[], [7], [1, 2], [1, 2, 9], None]
    assert column(spark, "array<int>", arrays, statistics.median) == [None, (7, 1), (3, 2), (2, 1), None]
    assert column(spark, "array<int>", arrays, statistics.mean) == [None, (7, 1), (3, 2), (12, 3), None]


def test_fraction_text(spark):
    fractions = [(7, 2), (6, 4), (1, 2), (4, 2), (-7, 2), (3, 0)]
    assert column(spark, "struct<num: long, den: long>", fractions, statistics.fraction_text) == ["3+1/2", "1+2/4", "1/2", "2", "-3-1/2", "3/0"]
    assert column(spark, "struct<num: long, den: long>", fractions[-1:], statistics.fraction_value) == [None]


def test_texts(spark):
    assert column(spark, "string", ["héé", "", None], statistics.length) == [5, 0, None]
    assert column(spark, "string", ["a\nb\n", "", None], statistics.lines_of_code) == [2, 0, None]
    durations = [0, 61, 3600, 90_000, 8 * 86_400, 2_592_000, 31_536_000 + 2_592_000, None]
    assert column(spark, "long", durations, formats.format_duration) == ["0min 0sec", "1min 1sec", "1hr", "1d 1hr", "1wk 1d", "1mt", "1yr 1mt", None]
    assert formats.timestamp(2020, "December") == 1_606_780_800


def test_languages(spark):
    paths = ["a.c", "A.C", ".gitignore", "foo", "x/.b.py", "a.", "src.d/foo", "a.weird"]
    assert column(spark, "string", paths, language_of_path) == ["C", "Cpp", None, None, "Python", "Other", None, "Other"]
    assert column(spark, "string", ["C++", "PERL 6", "klingon", None], language_of_name) == ["Cpp", "Perl", None, None]
    assert column(spark, "string", ["ASM", "Other"], ordinal) == [0, 43]
