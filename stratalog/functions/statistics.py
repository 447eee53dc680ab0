"""Statistics of array columns, and exact unreduced fractions as struct(num, den). An empty array has no statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction(num: Column, den: Column | int) -> Column:
    return F.struct(num.cast("long").alias("num"), (F.lit(den) if isinstance(den, int) else den).cast("long").alias("den"))


def fraction_value(f: Column) -> Column:
    """As a double; null where the denominator is zero."""
    return F.try_divide(f["num"].cast("double"), f["den"].cast("double"))


def fraction_text(f: Column) -> Column:
    """Whole part, sign and remainder, not reduced: 3+1/2, 1+2/4, 1/2, 2, -3-1/2; num/0 where the denominator is zero."""
    num, den = f["num"], f["den"]
    whole = F.call_function("div", num, F.nullif(den, F.lit(0)))
    rest = num - whole * den
    both = F.concat(whole.cast("string"), F.when(rest < 0, "-").otherwise("+"), F.abs(rest).cast("string"), F.lit("/"), den.cast("string"))
    simple = F.concat(rest.cast("string"), F.lit("/"), den.cast("string"))
    return F.when(den == 0, F.concat(num.cast("string"), F.lit("/0"))).when(rest == 0, whole.cast("string")).when(whole == 0, simple).otherwise(both)


def present(array: Column) -> Column:
    return F.filter(array, lambda x: x.isNotNull())


def count(array: Column) -> Column:
    """The number of elements; 0 for a missing array."""
    return F.when(array.isNull(), 0).otherwise(F.size(array)).cast("long")


def count_or_missing(array: Column) -> Column:
    return F.when(array.isNotNull(), F.size(array)).cast("long")


def minimum(array: Column) -> Column:
    return F.array_min(array)


def maximum(array: Column) -> Column:
    return F.array_max(array)


def min_max(array: Column) -> Column:
    return F.when(F.array_min(array).isNotNull(), F.struct(F.array_min(array).alias("min"), F.array_max(array).alias("max")))


def total(array: Column) -> Column:
    return F.aggregate(present(array), F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))


def mean(array: Column) -> Column:
    """sum/count as a fraction."""
    n = F.size(present(array))
    return F.when(n > 0, fraction(total(array), n))


def median(array: Column) -> Column:
    """Middle/1 of an odd number of elements, the two middle ones' sum/2 of an even number."""
    s = F.array_sort(present(array))
    n = F.size(s)
    half = (n / 2).cast("int")
    return F.when(n > 0, F.when(n % 2 == 1, fraction(F.get(s, half), 1)).otherwise(fraction(F.get(s, half - 1) + F.get(s, half), 2)))


def ratio(part: Column, whole: Column) -> Column:
    """Of two arrays' sizes; missing when either is."""
    return F.when(part.isNotNull() & whole.isNotNull(), fraction(F.size(part), F.size(whole)))


def length(text: Column) -> Column:
    """Bytes of a text in UTF-8."""
    return F.octet_length(text).cast("long")


def lines_of_code(text: Column) -> Column:
    """Line ends in a text."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def bucket(value: Column, width: int) -> Column:
    """The number of the interval of this width that holds the value."""
    return F.floor(value / width).cast("long")
