"""Predicates over columns that may be missing. Every one is true or false, never null."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(condition: Column, missing: bool = False) -> Column:
    return F.coalesce(condition, F.lit(missing))


def less_than(a: Column, n: object) -> Column:
    return _total(a < n)


def at_most(a: Column, n: object) -> Column:
    return _total(a <= n)


def equal(a: Column, n: object) -> Column:
    return _total(a == n)


def at_least(a: Column, n: object, missing: bool = True) -> Column:
    """a >= n; a missing value passes unless `missing` is false."""
    return _total(a >= n, missing)


def more_than(a: Column, n: object, missing: bool = True) -> Column:
    """a > n; a missing value passes unless `missing` is false."""
    return _total(a > n, missing)


def negated(condition: Column) -> Column:
    return ~_total(condition)


def exists(a: Column) -> Column:
    return a.isNotNull()


def missing(a: Column) -> Column:
    return a.isNull()


def same(a: Column, text: str) -> Column:
    return _total(a == text)


def contains(a: Column, text: str) -> Column:
    return _total(a.contains(text))


def matches(a: Column, pattern: str) -> Column:
    """The (Java) pattern is found anywhere in a."""
    return _total(a.rlike(pattern))


def holds(a: Column) -> Column:
    """A boolean column as a predicate."""
    return _total(a)


def _literals(values: Iterable[object]) -> Column:
    return F.array(*map(F.lit, values))


def member(a: Column, values: Iterable[object]) -> Column:
    return _total(a.isin(list(values)))


def any_in(array: Column, values: Iterable[object]) -> Column:
    """Some element of the array is among the values."""
    values = list(values)
    return _total(F.exists(array, lambda x: _total(x.isin(values)))) if values else F.lit(False)


def all_in(array: Column, values: Iterable[object]) -> Column:
    """Every element is among the values; true for an empty array, false for a missing one."""
    values = list(values)
    return _total(F.forall(array, lambda x: _total(x.isin(values)))) if values else _total(F.size(array) == 0) & array.isNotNull()


def within(array: Column, value: object) -> Column:
    return _total(F.array_contains(array, value))


def any_within(array: Column, values: Iterable[object]) -> Column:
    """Some value is in the array."""
    return any_in(array, values)


def all_within(array: Column, values: Iterable[object]) -> Column:
    """Every value is in the array; true for no values, even on a missing array."""
    values = list(values)
    return _total(F.size(F.array_except(_literals(values), array)) == 0) if values else F.lit(True)
