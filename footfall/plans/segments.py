"""Segments: the people that a filter tree holds of."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maps import bounded
from ..functions.time import instant
from ..operators.dedup import first_by_event_id
from ..operators.identity import resolve
from ..operators.rollups import device_index, person_traits
from ..operators.suppress import not_suppressed
from ..schema import CONTEXT_FIELDS, LATEST_FIELDS, Tables
from . import predicates as P
from .ast import Behavior, Node, Trait, behaviors, walk
from .validate import cost_warnings, validate_tree

PAGE, WALK = 100, 1000


def base(t: Tables, index: DataFrame | None = None) -> DataFrame:
    """One row for each person: first_seen, last_seen, and contexts of the first and the latest month.

    Each month of a device goes to who it belonged to at that month's last
    event. ``index`` is a stored device index, by default that of the tables;
    without one it is computed.
    """
    index = t.device_index if index is None else index
    rows = index if index is not None else device_index(t.events)
    rows = rows.where(F.col("project_id") == t.project_id)
    people = resolve(rows, t.bindings, t.aliases, "last_seen")
    merged = people.groupBy("project_id", "person_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("latest").alias("l"), F.min("first").alias("f"))
    return merged.select(
        "project_id", "person_id", "first_seen", "last_seen",
        *[F.col(f"l.{c}").alias(f"latest_{c}") for c in LATEST_FIELDS], *[F.col(f"f.{c}").alias(f"first_{c}") for c in CONTEXT_FIELDS],
    )


def traits(t: Tables, stored: DataFrame | None = None) -> DataFrame:
    """person_id, traits, traits_num: of each key the last value over all identities of a person."""
    stored = t.person_traits if stored is None else stored
    rows = stored if stored is not None else person_traits(t.events)
    rows = rows.where(F.col("project_id") == t.project_id).withColumn("_now", instant(t.now))
    people = resolve(rows, t.bindings, t.aliases, "_now")
    value = F.struct("updated_at", "event_id", "has_num", "value_str", "value_num")
    last = people.groupBy("person_id", "trait_key").agg(F.max(value).alias("v"))
    # One row for each key, so neither map has a key twice.
    texts = F.collect_list(F.when(F.col("v.has_num") == 0, F.struct("trait_key", "v.value_str")))
    numbers = F.collect_list(F.when(F.col("v.has_num") == 1, F.struct("trait_key", "v.value_num")))
    return last.groupBy("person_id").agg(F.map_from_entries(texts).alias("traits"), F.map_from_entries(numbers).alias("traits_num"))


def resolved_events(t: Tables, events: DataFrame) -> DataFrame:
    """A filtered scan with copies removed, people resolved, and what is suppressed hidden, in this order."""
    return not_suppressed(resolve(first_by_event_id(events), t.bindings, t.aliases), t.suppressed, "timestamp")


def behavior_pass(t: Tables, nodes: list[Behavior]) -> tuple[DataFrame, dict[Behavior, str]]:
    """person_id and b0, b1, ...: all behaviours of a tree in one scan and one aggregation."""
    starts = [P.window_start(b.window, t.now) for b in nodes]
    events = t.between(min(starts) if all(s is not None for s in starts) else None)
    alias = {b: f"b{i}" for i, b in enumerate(nodes)}
    people = resolved_events(t, events).groupBy("person_id")
    return people.agg(*[P.behavior_value(b, t.now).alias(a) for b, a in alias.items()]), alias


def persons(t: Tables, node: Node, index: DataFrame | None = None, stored_traits: DataFrame | None = None, with_traits: bool = False) -> DataFrame:
    """People of a segment with their columns; one row each.

    Traits are read only if the tree asks for one, or ``with_traits``. People without traits or matching events read as '' and 0, so that a
    negated condition holds of them.
    """
    validate_tree(node)
    rows = base(t, index)
    if with_traits or any(isinstance(n, Trait) for n, _, _ in walk(node)):
        none = F.create_map().cast("map<string,string>")
        none_num = F.create_map().cast("map<string,double>")
        rows = rows.join(traits(t, stored_traits), "person_id", "left")
        rows = rows.withColumns({"traits": F.coalesce("traits", none), "traits_num": F.coalesce("traits_num", none_num)})
    alias: dict[Behavior, str] = {}
    if nodes := behaviors(node):
        counted, alias = behavior_pass(t, nodes)
        rows = rows.join(counted, "person_id", "left")
    return not_suppressed(rows, t.suppressed, "last_seen").where(P.tree(node, alias))


def count(t: Tables, node: Node, **stored: DataFrame) -> DataFrame:
    """One row: person_count."""
    return persons(t, node, **stored).agg(F.count("*").alias("person_count"))


def member_columns() -> list[Column]:
    out = [F.col(c) for c in ("person_id", "first_seen", "last_seen")]
    out += [F.col(f"latest_{c}" if c in LATEST_FIELDS else f"first_{c}").alias(c) for c in CONTEXT_FIELDS]
    total = F.size("traits") + F.size("traits_num")
    return [*out, bounded(F.col("traits")).alias("traits"), bounded(F.col("traits_num")).alias("traits_num"), total.cast("long").alias("trait_total")]


def members(t: Tables, node: Node, after: tuple[datetime, str] | None = None, limit: int = PAGE, **stored: DataFrame) -> DataFrame:
    """A page of people: last seen first, then by id; after a (last_seen, person_id) if given."""
    rows = persons(t, node, with_traits=True, **stored)
    if after is not None:
        seen, person = instant(after[0]), F.lit(after[1])
        rows = rows.where((F.col("last_seen") < seen) | ((F.col("last_seen") == seen) & (F.col("person_id") > person)))
    return rows.select(*member_columns()).orderBy(F.col("last_seen").desc(), "person_id").limit(min(limit, PAGE))


def preview(t: Tables, node: Node) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """(count, first page, warnings)."""
    return count(t, node), members(t, node), cost_warnings(node)
