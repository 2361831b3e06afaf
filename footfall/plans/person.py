"""One person: the ids and device windows that are theirs, profile, and export."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import instant
from ..operators.dedup import first_by_event_id
from ..operators.identity import coalesce_tiles, exact_tiles
from ..operators.rollups import person_traits
from ..operators.suppress import boundary
from ..schema import Tables

MAX_WINDOWS = 200


class TooFragmented(ValueError):
    """A person whose devices changed hands more often than one read takes."""


@dataclass(frozen=True)
class DeviceWindow:
    """A time in which a device belongs to a person: from included, to excluded; None is without an end."""

    device: str
    begin: datetime | None
    end: datetime | None


@dataclass(frozen=True)
class Scope:
    """What is a person's: the canonical id, all ids of the group, device windows."""

    canonical: str
    group: tuple[str, ...]
    windows: tuple[DeviceWindow, ...]

    @property
    def devices(self) -> tuple[str, ...]:
        return tuple(sorted({w.device for w in self.windows}))


def scope(t: Tables, person: str, restrict_to: list[str] | None = None) -> Scope:
    """The scope of an id: a person's, a merged one's, or a device's (then its most recent owner's).

    ``restrict_to`` is a ceiling: ids that were not the person's when it was
    captured stay out. Reads the small identity tables by key.
    """
    bindings = t.bindings.where(F.col("project_id") == t.project_id)
    aliases = t.aliases.where(F.col("project_id") == t.project_id)

    def group_of(name: str) -> tuple[str, list[str]]:
        row = aliases.where(F.col("person_id") == name).select("canonical_id").first()
        root = row[0] if row else name
        merged = [r[0] for r in aliases.where(F.col("canonical_id") == root).select("person_id").collect()]
        return root, sorted({root, *merged})

    root, group = group_of(person)
    owned = bindings.where(F.col("person_id").isin(group)).select("anonymous_id").distinct()
    if not owned.take(1):
        last = bindings.where(F.col("anonymous_id") == person).orderBy(F.col("bound_at").desc(), "person_id").first()
        if last is not None:
            root, group = group_of(last["person_id"])
            owned = bindings.where(F.col("person_id").isin(group)).select("anonymous_id").distinct()
    if restrict_to is not None:
        group = [g for g in group if g in restrict_to]
    theirs = bindings.join(owned, "anonymous_id", "left_semi")
    known = F.when(F.col("person_id").isin(group), F.lit(root)).otherwise(F.concat(F.lit("\u0000"), "person_id"))
    exact = coalesce_tiles(exact_tiles(theirs.withColumn("person_id", known))).where(F.col("person_id") == root)
    windows = [DeviceWindow(r["anonymous_id"], r["valid_from"], r["valid_to"]) for r in exact.orderBy("anonymous_id", "valid_from").collect()]
    return Scope(root, tuple(group), tuple(windows))


def owns(s: Scope) -> Column:
    """Whether an event is the person's, by id or by device and time."""
    mine = F.col("user_id").isin(list(s.group)) if s.group else F.lit(False)
    windows = []
    for w in s.windows:
        c = F.col("anonymous_id") == w.device
        if w.begin is not None:
            c = c & (F.col("timestamp") >= instant(w.begin))
        if w.end is not None:
            c = c & (F.col("timestamp") < instant(w.end))
        windows.append(c)
    if not windows:
        return mine
    return mine | ((F.col("user_id") == "") & reduce(lambda a, b: a | b, windows))


def person_events(events: DataFrame, s: Scope, most: int | None = MAX_WINDOWS) -> DataFrame:
    """The person's events; more windows than ``most`` are refused, or joined if most is None."""
    if most is not None and len(s.windows) > most:
        raise TooFragmented(f"{len(s.windows)} device windows, above {most}")
    if len(s.windows) <= MAX_WINDOWS:
        return events.where(owns(s))
    spark = events.sparkSession
    rows = spark.createDataFrame([(w.device, w.begin, w.end) for w in s.windows], "_d string, _f timestamp, _t timestamp")
    inside = (F.col("user_id") == "") & (F.col("anonymous_id") == F.col("_d")) & (F.col("_f").isNull() | (F.col("timestamp") >= F.col("_f"))) & (F.col("_t").isNull() | (F.col("timestamp") < F.col("_t")))
    return events.where(F.col("user_id").isin(list(s.group))).unionByName(events.join(rows, inside, "left_semi"))


def _visible(t: Tables, s: Scope) -> DataFrame:
    rows = person_events(t.events.where(F.col("project_id") == t.project_id), s)
    until = boundary(t.suppressed, t.project_id, list(s.group)).first()[0]
    return rows if until is None else rows.where(F.col("timestamp") > instant(until))


def summary(t: Tables, s: Scope) -> DataFrame:
    """One row: first_seen, last_seen, events (distinct), of what isn't suppressed."""
    return _visible(t, s).agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count_distinct("event_id").alias("events"))


def profile(t: Tables, person: str) -> dict | None:
    """Ids, devices and summary of a person; None if nothing visible is theirs."""
    s = scope(t, person)
    row = summary(t, s).first()
    if not row["events"]:
        return None
    return {"person_id": s.canonical, "merged_ids": [g for g in s.group if g != s.canonical], "devices": list(s.devices), **row.asDict()}


def export_events(t: Tables, s: Scope) -> DataFrame:
    """The person's visible events in order of time, each once: of copies the earliest, received last."""
    return first_by_event_id(_visible(t, s)).orderBy("timestamp", "event_id")


def export_traits(t: Tables, s: Scope, stored: DataFrame | None = None) -> DataFrame:
    """trait_key, value_str, value_num, has_num: the last value of each key over all the person's raw identities."""
    stored = t.person_traits if stored is None else stored
    rows = stored if stored is not None else person_traits(t.events)
    mine = F.col("user_id").isin(list(s.group)) | ((F.col("user_id") == "") & F.col("anonymous_id").isin(list(s.devices)))
    value = F.struct("updated_at", "event_id", "has_num", "value_str", "value_num")
    last = rows.where((F.col("project_id") == t.project_id) & mine).groupBy("trait_key").agg(F.max(value).alias("v"))
    return last.select("trait_key", "v.value_str", "v.value_num", "v.has_num").orderBy("trait_key")
