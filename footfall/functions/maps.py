"""Reads of the two property maps; an absent key is '' or 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TRAITS = 50


def text_of(column: str | Column, key: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column[key], F.lit(""))


def number_of(column: str | Column, key: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column[key], F.lit(0.0))


def bounded(column: Column, most: int = MAX_TRAITS) -> Column:
    """The map's first ``most`` keys in order, with their values."""
    keys = F.slice(F.array_sort(F.map_keys(column)), 1, most)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: column[k]))


def rendered(column: Column) -> Column:
    """A map as 'k=v;k=v' with keys in order, the same in any engine."""
    keys = F.array_sort(F.map_keys(column))
    return F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), column[k].cast("string"))), ";")
