"""The event feed, counts in time buckets, and rejected events."""

from __future__ import annotations

import base64
import json
import math
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import BUCKETS, bucket, instant
from ..schema import Tables
from .person import Scope, person_events
from .segments import resolved_events

FEED_DEFAULT, FEED_MAX = 50, 500
FEED_COLUMNS = (
    "event_id", "timestamp", "event_name", "anonymous_id", "user_id", "properties", "properties_num", "url", "path", "referrer", "utm_source",
    "utm_medium", "utm_campaign", "utm_term", "utm_content", "device_type", "os", "browser", "country", "region", "city",
)
MAX_BUCKETS = 1000
DEFAULT_WINDOWS = {"1m": timedelta(minutes=60), "1h": timedelta(hours=24), "1d": timedelta(days=7)}
REJECTIONS_MAX, OFFSET_MAX = 500, 100_000

Cursor = tuple[datetime, str]


def encode_cursor(at: str, event_id: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([at, event_id], separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> Cursor:
    """The instant and event id of a cursor; ValueError for anything else."""
    try:
        at, event_id = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        if not isinstance(at, str) or not isinstance(event_id, str):
            raise ValueError
        return datetime.fromisoformat(at), event_id
    except (ValueError, TypeError):
        raise ValueError("not a cursor") from None


def _limit(n: int, most: int) -> int:
    if not 1 <= n <= most:
        raise ValueError(f"limit is 1 to {most}")
    return n


def _utc(at: datetime) -> datetime:
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at


def feed(t: Tables, since: datetime | None = None, until: datetime | None = None, event: str | None = None, person: Scope | None = None, cursor: Cursor | None = None, limit: int = FEED_DEFAULT) -> DataFrame:
    """A page of events, oldest first.

    Without a cursor the most recent ``limit``, by default of the last 24
    hours; after a cursor the next ones. Filters come before the removal of
    copies, suppression after it.
    """
    if since is None and cursor is None:
        since = t.now - timedelta(hours=24)
    starts = [x for x in (since, cursor and cursor[0]) if x is not None]
    rows = t.between(max(starts, key=_utc), until, closed=True)
    if event is not None:
        rows = rows.where(F.col("event_name") == event)
    if person is not None:
        rows = person_events(rows, person)
    if cursor is not None:
        at, event_id = instant(cursor[0]), F.lit(cursor[1])
        rows = rows.where((F.col("timestamp") > at) | ((F.col("timestamp") == at) & (F.col("event_id") > event_id)))
    shown = resolved_events(t, rows).select(*FEED_COLUMNS)
    up, n = [F.col("timestamp").asc(), F.col("event_id").asc()], _limit(limit, FEED_MAX)
    if cursor is not None:
        return shown.orderBy(*up).limit(n)
    return shown.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(n).orderBy(*up)


def stats(t: Tables, interval: str, since: datetime | None = None, until: datetime | None = None, by_event: bool = False) -> DataFrame:
    """bucket, (event_name,) events: distinct events in each interval that has any."""
    until = t.now if until is None else until
    since = until - DEFAULT_WINDOWS[interval] if since is None else since
    if math.ceil((until - since).total_seconds() / BUCKETS[interval][1]) > MAX_BUCKETS:
        raise ValueError(f"at most {MAX_BUCKETS} buckets")
    rows = t.between(since, until, closed=True)
    rows = rows.select("project_id", "event_id", "timestamp", "received_at", "event_name", "anonymous_id", "user_id")
    keys = [bucket(F.col("timestamp"), interval).alias("bucket"), *(["event_name"] if by_event else [])]
    # Copies are gone, so a plain count is one of distinct events.
    return resolved_events(t, rows).groupBy(*keys).agg(F.count("*").alias("events")).orderBy("bucket", *(["event_name"] if by_event else []))


def filled(counted: DataFrame, interval: str, since: datetime, until: datetime) -> DataFrame:
    """bucket, events with zeros for the intervals from since's to until's without any."""
    unit, _ = BUCKETS[interval]
    ends = counted.sparkSession.range(1).select(F.date_trunc(unit, instant(since)).alias("a"), F.date_trunc(unit, instant(until)).alias("b"))
    every = ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL 1 {unit}"))).alias("bucket"))
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("events", F.lit(0)).alias("events")).orderBy("bucket")


def peak(series: DataFrame) -> DataFrame:
    """One row: peak, total."""
    return series.agg(F.coalesce(F.max("events"), F.lit(0)).alias("peak"), F.coalesce(F.sum("events"), F.lit(0)).alias("total"))


def rejections(dead_letter: DataFrame, project_id: int, since: datetime | None = None, until: datetime | None = None, reason: str | None = None, limit: int = FEED_DEFAULT, offset: int = 0) -> DataFrame:
    """A page of rejected events, newest first; those of one instant by all else that a row has, so that pages agree."""
    if not 0 <= offset <= OFFSET_MAX:
        raise ValueError(f"offset is 0 to {OFFSET_MAX}")
    rows = dead_letter.where(F.col("project_id") == project_id)
    if since is not None:
        rows = rows.where(F.col("received_at") >= instant(since))
    if until is not None:
        rows = rows.where(F.col("received_at") <= instant(until))
    if reason is not None:
        rows = rows.where(F.col("reason") == reason)
    page = rows.select("received_at", "reason", "detail", "payload").orderBy(F.col("received_at").desc(), "reason", "payload", "detail")
    return page.offset(offset).limit(_limit(limit, REJECTIONS_MAX))


def rejections_has_more(rows: int, limit: int, next_offset: int) -> bool:
    """Whether another page may follow: this one is full, and the next offset is allowed."""
    return rows == limit and next_offset <= OFFSET_MAX


def event_totals(t: Tables, names: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """event_name, events: counts of the span, and 0 for the other names of the catalog."""
    counted = stats(t, "1d", since, until, by_event=True).groupBy("event_name").agg(F.sum("events").alias("events"))
    both = counted.join(names.select("event_name").distinct(), "event_name", "full_outer")
    return both.select("event_name", F.coalesce("events", F.lit(0)).alias("events")).orderBy(F.col("events").desc(), "event_name")
