"""Instants: clamping, buckets, retention boundaries, and parsing of bounds."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SKEW = timedelta(hours=24)
UNITS = {"m": "minutes", "h": "hours", "d": "days"}
BUCKETS = {"1m": ("minute", 60), "1h": ("hour", 3600), "1d": ("day", 86400)}


def instant(at: datetime) -> Column:
    """A literal instant; a datetime without a zone means UTC."""
    return F.lit(at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC))


def millis(column: Column) -> Column:
    return F.date_trunc("MILLISECOND", column)


def seconds(column: Column) -> Column:
    return F.date_trunc("SECOND", column)


def clamp(client: Column, now: Column) -> Column:
    """The client's time within 24 hours of now; now where it is missing or unreadable."""
    day = F.expr("INTERVAL 24 HOURS")
    parsed = F.try_to_timestamp(client)
    return millis(F.when(parsed.isNull(), now).otherwise(F.least(F.greatest(parsed, now - day), now + day)))


def bucket(column: Column, interval: str) -> Column:
    """The start of the column's interval: 1m, 1h or 1d."""
    if interval not in BUCKETS:
        raise ValueError(f"interval is one of {', '.join(BUCKETS)}")
    return F.date_trunc(BUCKETS[interval][0], column)


def month(column: Column) -> Column:
    """yyyyMM as an integer, the partition key of facts."""
    return F.date_format(column, "yyyyMM").cast("int")


def month_of(at: datetime) -> int:
    """The month of an instant of Python, as ``month`` gives it of a column."""
    at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
    return at.year * 100 + at.month


def within(rows: DataFrame, since: datetime | None, until: datetime | None, closed: bool = False) -> DataFrame:
    """Rows from ``since`` on and before ``until`` (``closed``: and at it); a column month is bounded too, which prunes partitions."""
    monthly = "month" in rows.columns
    if since is not None:
        rows = rows.where(F.col("timestamp") >= instant(since))
        rows = rows.where(F.col("month") >= month_of(since)) if monthly else rows
    if until is not None:
        rows = rows.where(F.col("timestamp") <= instant(until) if closed else F.col("timestamp") < instant(until))
        rows = rows.where(F.col("month") <= month_of(until)) if monthly else rows
    return rows


def retention_boundary(now: datetime, months: int) -> datetime:
    """The first instant kept: the start of the current month less ``months``."""
    if not 1 <= months <= 120:
        raise ValueError("retention is 1 to 120 months")
    count = now.year * 12 + now.month - 1 - months
    return datetime(count // 12, count % 12 + 1, 1, tzinfo=UTC)


def parse_bound(value: str) -> datetime:
    """A lifecycle bound: a date is its UTC midnight, a time without a zone is UTC."""
    at = datetime.fromisoformat(value)
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)


def parse_since(value: str, now: datetime) -> datetime:
    """'15m', '24h', '7d' before now, or an ISO instant."""
    if m := re.fullmatch(r"(\d+)([mhd])", value):
        return now - timedelta(**{UNITS[m[2]]: int(m[1])})
    return parse_bound(value)
