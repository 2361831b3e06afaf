"""Conditions of the query language as columns. No input is ever null."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.maps import number_of, text_of
from ..functions.time import instant
from ..schema import LATEST_FIELDS
from .ast import Behavior, Comparison, Context, Group, Lifecycle, Node, Not, Trait, Where, Window


def _literal(v) -> Column:
    return instant(v) if isinstance(v, datetime) else F.lit(v)


def compare(left: Column, test: Comparison, convert=lambda v: v) -> Column:
    """left operator value; between includes both ends, and is false if they are the wrong way round."""
    if test.operator == "between":
        low, high = (_literal(convert(v)) for v in test.value)
        return (left >= low) & (left <= high)
    right = _literal(convert(test.value))
    return {"=": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[test.operator]


def numeric(test: Comparison) -> bool:
    v = test.value[0] if isinstance(test.value, tuple) else test.value
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def text(v) -> str:
    return ("true" if v else "false") if isinstance(v, bool) else str(v)


def where(conditions: tuple[Where, ...]) -> Column:
    """Conditions on an event. The value's kind picks the map; an absent key is 0 or ''."""
    out = F.lit(True)
    for w in conditions:
        if w.source == "attribute":
            out = out & compare(F.col(w.name), w.test, text)
        elif numeric(w.test):
            out = out & compare(number_of("properties_num", w.name), w.test, float)
        else:
            out = out & compare(text_of("properties", w.name), w.test, text)
    return out


def event_is(name: str) -> Column:
    return F.lit(True) if name == "*" else F.col("event_name") == name


def window_start(window: Window, now: datetime) -> datetime | None:
    if window.kind == "last":
        return now - timedelta(**{window.unit: window.n})
    return window.begin


def in_window(window: Window, now: datetime) -> Column:
    """last: from its start on, without an end; absolute: both ends included."""
    begin = window_start(window, now)
    if begin is None:
        return F.lit(True)
    inside = F.col("timestamp") >= instant(begin)
    return inside & (F.col("timestamp") <= instant(window.end)) if window.end is not None else inside


def behavior_match(b: Behavior, now: datetime) -> Column:
    return event_is(b.event) & in_window(b.window, now) & where(b.where)


def behavior_value(b: Behavior, now: datetime) -> Column:
    """The behaviour's aggregate over a person's events, as a double; what isn't there counts 0 (or '' in distinct)."""
    match = behavior_match(b, now)
    if b.aggregate == "count":
        return F.count_if(match).cast("double")
    if b.aggregate == "distinct":
        return F.count_distinct(F.when(match, text_of("properties", b.property))).cast("double")
    value = F.when(match, number_of("properties_num", b.property))
    return F.coalesce({"sum": F.sum, "min": F.min, "max": F.max}[b.aggregate](value), F.lit(0.0))


def tree(node: Node, alias: dict[Behavior, str]) -> Column:
    """A filter tree over the columns of a person: base, trait maps, and behaviours under ``alias``."""
    if isinstance(node, Group):
        parts = [tree(c, alias) for c in node.children]
        return reduce((lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b), parts)
    if isinstance(node, Not):
        return ~tree(node.child, alias)
    if isinstance(node, Trait):
        if numeric(node.test):
            has = F.coalesce(F.col("traits_num")[node.key].isNotNull(), F.lit(False))
            return has & compare(number_of("traits_num", node.key), node.test, float)
        return compare(text_of("traits", node.key), node.test, text)
    if isinstance(node, Context):
        scope = "latest" if node.scope == "latest" and node.field in LATEST_FIELDS else "first"
        return compare(F.col(f"{scope}_{node.field}"), node.test, text)
    if isinstance(node, Lifecycle):
        return compare(F.col(node.field), node.test)
    return compare(F.coalesce(F.col(alias[node]), F.lit(0.0)), node.test, float)
