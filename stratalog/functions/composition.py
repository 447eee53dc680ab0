"""Attributes of referenced entities, over array columns of structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_entity(entity: Column, field: str) -> Column:
    """A field of a struct column; missing where the entity is."""
    return entity[field]


def from_each(collection: Column, value: Callable[[Column], Column], keep_missing: bool = False) -> Column:
    """The value of each element; missing values are left out unless kept."""
    values = F.transform(collection, lambda x: value(x))
    return values if keep_missing else F.filter(values, lambda x: x.isNotNull())


def from_each_if(collection: Column, condition: Callable[[Column], Column]) -> Column:
    """The elements that pass; a missing collection stays missing."""
    return F.filter(collection, lambda x: F.coalesce(condition(x), F.lit(False)))


def select(**columns: Column) -> Column:
    """Several attributes as one struct."""
    return F.struct(*[c.alias(name) for name, c in columns.items()])
