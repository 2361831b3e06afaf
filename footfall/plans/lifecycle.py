"""Retention, deletion requests and their purge, and project removal.

Parquet has no transactions: a purge writes the tables anew and the caller
swaps them in. Every step only removes rows, so a purge that is run again
after a failure ends in the same state.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import instant, month, retention_boundary
from ..operators.suppress import upsert
from ..schema import SUPPRESSED, Tables
from .person import person_events, scope

DEAD_LETTER_DAYS = 30
MAX_SKEW = timedelta(hours=24)


def expired_months(events: DataFrame, projects: DataFrame, now: datetime, stored_now: datetime | None = None) -> DataFrame:
    """project_id, month, events of the months that retention drops whole: a dry run.

    ``stored_now`` is the storage's clock; a difference of over a day is refused.
    """
    if stored_now is not None and abs(stored_now - now) > MAX_SKEW:
        raise ValueError("the clocks differ by more than a day")
    kept = projects.where("retention_months BETWEEN 1 AND 120").select("project_id", month(F.add_months(F.date_trunc("month", instant(now)), -F.col("retention_months"))).alias("first_kept"))
    months = events.groupBy("project_id", month(F.col("timestamp")).alias("month")).agg(F.count("*").alias("events"))
    return months.join(kept, "project_id").where("month < first_kept").select("project_id", "month", "events")


def retained(rows: DataFrame, now: datetime, months: int, at: Column | None = None) -> DataFrame:
    """Rows of the months that are kept; traits and the event schema never expire."""
    first = retention_boundary(now, months)
    return rows.where((month(F.col("timestamp")) if at is None else at) >= first.year * 100 + first.month)


def dead_letter_retained(dead_letter: DataFrame, now: datetime) -> DataFrame:
    return dead_letter.where(F.col("received_at") >= instant(now - timedelta(days=DEAD_LETTER_DAYS)))


@dataclass(frozen=True)
class DeletionRequest:
    """A request to erase a person: the ids captured then (persons' and devices') are the ceiling of its purge."""

    request_id: str
    project_id: int
    person_id: str
    person_ids: tuple[str, ...]
    requested_at: datetime
    status: str = "pending"
    attempts: int = 0
    error: str | None = None
    completed_at: datetime | None = field(default=None)


class NotFound(LookupError):
    """No event was ever the person's."""


def request_deletion(t: Tables, person: str, request_id: str, open_requests: list[DeletionRequest] = ()) -> tuple[DeletionRequest, DataFrame]:
    """(request, suppression table with all ids at one instant).

    The person needs at least one event, suppressed or not; else a request
    that is still open for the same ids is returned, or NotFound raised.
    """
    s = scope(t, person)
    ids = tuple(sorted({*s.group, s.canonical, *s.devices}))
    if not person_events(t.events.where(F.col("project_id") == t.project_id), s, None).take(1):
        for r in open_requests:
            if r.status in ("pending", "in_progress") and set(r.person_ids) & set(ids):
                return r, t.suppressed
        raise NotFound(person)
    rows = t.spark.createDataFrame([(t.project_id, i, t.now) for i in ids], SUPPRESSED)
    return DeletionRequest(request_id, t.project_id, s.canonical, ids, t.now), upsert(t.suppressed, rows)


def deletion_status(r: DeletionRequest, leased: bool = False, max_attempts: int = 5) -> str:
    """completed, failed, in_progress or pending."""
    if r.completed_at is not None:
        return "completed"
    if r.error is not None and r.attempts >= max_attempts:
        return "failed"
    return "in_progress" if leased else "pending"


def mentions(payload: Column, ids: list[str]) -> Column:
    """Whether a rejected payload holds one of the ids in quotes."""
    return F.exists(F.array(*[F.lit(f'"{i}"') for i in ids]), lambda q: F.instr(payload, q) > 0) if ids else F.lit(False)


def owned_keys(events: DataFrame) -> DataFrame:
    """Distinct (event_name, property_key, value_kind) of events' own properties."""
    texts = events.select("event_name", F.explode(F.map_keys("properties")).alias("property_key"), F.lit("string").alias("value_kind"))
    numbers = events.select("event_name", F.explode(F.map_keys("properties_num")).alias("property_key"), F.lit("number").alias("value_kind"))
    return texts.unionByName(numbers).distinct()


@dataclass(frozen=True)
class Erased:
    """All tables after a purge."""

    events: DataFrame
    device_index: DataFrame
    person_traits: DataFrame
    dead_letter: DataFrame
    bindings: DataFrame
    aliases: DataFrame
    event_schema: DataFrame


def stale_names(schema: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of the event schema whose event no longer occurs."""
    return schema.join(events.select("project_id", "event_name").distinct(), ["project_id", "event_name"], "left_anti")


def purge(t: Tables, r: DeletionRequest, device_index: DataFrame, person_traits: DataFrame, dead_letter: DataFrame, event_schema: DataFrame) -> Erased:
    """All traces of the request's ids go, whenever they were left; suppression stays.

    In order: the keys that the person sent, events, rollups by raw identity,
    rejected payloads, bindings, aliases, names that no event has any more, and
    keys that no surviving event has. Other projects' rows are untouched.
    """
    s = scope(t, r.person_id, restrict_to=list(r.person_ids))
    project = F.col("project_id") == r.project_id
    theirs = person_events(t.events.where(project), s, None)
    sent = owned_keys(theirs)
    gone = theirs.select("project_id", "event_id", "timestamp", "received_at")
    events = t.events.join(gone, ["project_id", "event_id", "timestamp", "received_at"], "left_anti")
    ids, devices = list(s.group), list(s.devices)
    # Anonymous rollup rows of a shared device can't be split by time, so they go; its other owner's events stay.
    raw = project & (F.col("user_id").isin(ids) | ((F.col("user_id") == "") & F.col("anonymous_id").isin(devices)))
    bound = project & F.col("person_id").isin(ids)
    schema = event_schema.join(stale_names(event_schema.where(project), events).select("project_id", "event_name").distinct(), ["project_id", "event_name"], "left_anti")
    left = owned_keys(events.where(project).join(sent.select("event_name").distinct(), "event_name", "left_semi"))
    lost = sent.join(left, ["event_name", "property_key", "value_kind"], "left_anti").withColumn("project_id", F.lit(r.project_id).cast("long"))
    return Erased(
        events,
        device_index.where(~raw),
        person_traits.where(~raw),
        dead_letter.where(~(project & mentions(F.col("payload"), sorted({*ids, *devices})))),
        t.bindings.where(~bound),
        t.aliases.where(~(project & (F.col("person_id").isin(ids) | F.col("canonical_id").isin(ids)))),
        schema.join(lost, ["project_id", "event_name", "property_key", "value_kind"], "left_anti"),
    )


def purge_project(tables: dict[str, DataFrame], project_id: int) -> dict[str, DataFrame]:
    """All tables without a project's rows."""
    return {k: df.where(F.col("project_id") != project_id) for k, df in tables.items()}


def remaining(tables: dict[str, DataFrame], project_id: int) -> DataFrame:
    """table, rows that a project still has: none after a complete purge."""
    parts = [df.where(F.col("project_id") == project_id).agg(F.count("*").alias("rows")).select(F.lit(k).alias("table"), "rows") for k, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).where("rows > 0")


def accepts(state: str) -> str | None:
    """None if a project of this state takes events, else the code that refuses them."""
    return {"active": None, "archived": "project_archived", "deleting": "project_deleting"}[state]


def confirm_deletion(slug: str, typed: str) -> None:
    if slug != typed:
        raise ValueError("the slug doesn't match")


def advance(r: DeletionRequest, error: str | None = None, at: datetime | None = None) -> DeletionRequest:
    """A request after one attempt."""
    if error is None:
        return replace(r, status="completed", attempts=r.attempts + 1, error=None, completed_at=at or datetime.now(UTC))
    return replace(r, attempts=r.attempts + 1, error=error)
