"""Schemas of all tables, and the bundle of tables that queries work on.

No column of the fact table is null: a missing string is '', a missing map key
reads as '' or 0. Instants are UTC with millisecond precision.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.time import within

# The columns of an event that describe its context.
CONTEXT_FIELDS = ("country", "region", "city", "device_type", "os", "browser", "referrer", "utm_source", "utm_medium", "utm_campaign")
EVENT_COLUMN_FIELDS = (*CONTEXT_FIELDS, "path", "url", "utm_term", "utm_content")
LIFECYCLE_FIELDS = ("first_seen", "last_seen")
#: Context that has a latest value; the others only have that of the first touch.
LATEST_FIELDS = ("country", "region", "city", "device_type", "os", "browser")


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

EVENTS = _struct(
    project_id=_L, event_id=_S, anonymous_id=_S, user_id=_S, event_name=_S, timestamp=_TS, received_at=_TS, trusted=T.ByteType(),
    properties=T.MapType(_S, _S), properties_num=T.MapType(_S, _D),
    url=_S, path=_S, referrer=_S, utm_source=_S, utm_medium=_S, utm_campaign=_S, utm_term=_S, utm_content=_S,
    device_type=_S, os=_S, browser=_S, country=_S, region=_S, city=_S,
)
BINDINGS = _struct(project_id=_L, anonymous_id=_S, person_id=_S, bound_at=_TS)
ALIASES = _struct(project_id=_L, person_id=_S, canonical_id=_S)
SUPPRESSED = _struct(project_id=_L, person_id=_S, suppressed_at=_TS)
DEAD_LETTER = _struct(project_id=_L, received_at=_TS, reason=_S, detail=_S, payload=_S)
EVENT_SCHEMA = _struct(project_id=_L, event_name=_S, property_key=_S, value_kind=_S, last_seen=_TS)
PERSON_TRAITS = _struct(project_id=_L, anonymous_id=_S, user_id=_S, trait_key=_S, value_str=_S, value_num=_D, has_num=T.ByteType(), updated_at=_TS, event_id=_S)
INGEST_COUNTERS = _struct(project_id=_L, month=T.DateType(), accepted=_L, rejected=_L, throttled=_L, over_quota=_L, bot=_L)
PROJECTS = _struct(project_id=_L, slug=_S, retention_months=T.IntegerType(), monthly_event_quota=_L, state=_S)


@dataclass(frozen=True)
class Tables:
    """What a query reads: facts, the identity tables, and the instant it is asked at.

    Stored rollups are read where they are given, and computed from all events
    where they aren't. ``monthly`` is the events with the column month that
    they are stored by; with it, bounds of time prune partitions.
    """

    events: DataFrame
    bindings: DataFrame
    aliases: DataFrame
    suppressed: DataFrame
    now: datetime
    project_id: int = 1
    device_index: DataFrame | None = None
    person_traits: DataFrame | None = None
    event_schema: DataFrame | None = None
    monthly: DataFrame | None = None

    def at(self, **changes) -> Tables:
        """Other tables in their place; what is stored of events goes with them."""
        derived = ("device_index", "person_traits", "event_schema", "monthly")
        return replace(self, **(dict.fromkeys(derived) if "events" in changes else {}) | changes)

    def between(self, since: datetime | None = None, until: datetime | None = None, closed: bool = False) -> DataFrame:
        """The project's events from ``since`` on and before ``until`` (``closed``: and at it)."""
        rows = self.events if self.monthly is None else self.monthly
        return within(rows.where(F.col("project_id") == self.project_id), since, until, closed).select(*self.events.columns)

    @property
    def spark(self) -> SparkSession:
        return self.events.sparkSession


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def tables(spark: SparkSession, events: DataFrame, now: datetime, bindings: DataFrame | None = None, aliases: DataFrame | None = None, suppressed: DataFrame | None = None, project_id: int = 1) -> Tables:
    """A bundle in which absent side tables are empty."""
    return Tables(
        events,
        bindings if bindings is not None else empty(spark, BINDINGS),
        aliases if aliases is not None else empty(spark, ALIASES),
        suppressed if suppressed is not None else empty(spark, SUPPRESSED),
        now,
        project_id,
    )
