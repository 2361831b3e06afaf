"""Rollups of events, in a form that partial ones can be merged into whole ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import month
from ..schema import CONTEXT_FIELDS, LATEST_FIELDS

DEVICE_KEY = ("project_id", "anonymous_id", "user_id", "month")
TRAIT_KEY = ("project_id", "anonymous_id", "user_id", "trait_key")
SCHEMA_KEY = ("project_id", "event_name", "property_key", "value_kind")


def _context(fields: tuple[str, ...], t: str = "timestamp", i: str = "event_id") -> Column:
    """An orderable struct: the instant, then the event id to decide ties, then values."""
    return F.struct(F.col(t).alias("at"), F.col(i).alias("id"), *[F.col(f) for f in fields])


def device_index(events: DataFrame) -> DataFrame:
    """Per device, user and month: first and last instant, count, and the contexts at both.

    ``latest`` and ``first`` are structs that begin with instant and event id,
    so that max and min of them merge partial rollups. Copies of an event
    count each in event_count.
    """
    return events.groupBy("project_id", "anonymous_id", "user_id", month(F.col("timestamp")).alias("month")).agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("event_count"),
        F.max(_context(LATEST_FIELDS)).alias("latest"), F.min(_context(CONTEXT_FIELDS)).alias("first"),
    )


def merge_device_index(*parts: DataFrame) -> DataFrame:
    return _union(parts).groupBy(*DEVICE_KEY).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("event_count").alias("event_count"),
        F.max("latest").alias("latest"), F.min("first").alias("first"),
    )


def person_traits(events: DataFrame) -> DataFrame:
    """Per raw identity and key, the last value an identify event gave: the last write of a key wins."""
    identify = events.where("event_name = '$identify'")
    base = ("project_id", "anonymous_id", "user_id", "timestamp", "event_id")
    texts = identify.select(*base, F.explode("properties").alias("trait_key", "value_str")).select(*base, "trait_key", "value_str", F.lit(0.0).alias("value_num"), F.lit(0).cast("byte").alias("has_num"))
    numbers = identify.select(*base, F.explode("properties_num").alias("trait_key", "value_num")).select(*base, "trait_key", F.lit("").alias("value_str"), "value_num", F.lit(1).cast("byte").alias("has_num"))
    rows = texts.unionByName(numbers).withColumnsRenamed({"timestamp": "updated_at"})
    return merge_person_traits(rows)


def merge_person_traits(*parts: DataFrame) -> DataFrame:
    value = F.struct("updated_at", "event_id", "has_num", "value_str", "value_num")
    return _union(parts).groupBy(*TRAIT_KEY).agg(F.max(value).alias("v")).select(*TRAIT_KEY, "v.value_str", "v.value_num", "v.has_num", "v.updated_at", "v.event_id")


def event_schema(events: DataFrame) -> DataFrame:
    """Observed (event, key, kind) with the last instant; a key of '' stands for the event itself."""
    base = ("project_id", "event_name", "timestamp")
    texts = events.select(*base, F.explode(F.map_keys("properties")).alias("property_key"), F.lit("string").alias("value_kind"))
    numbers = events.select(*base, F.explode(F.map_keys("properties_num")).alias("property_key"), F.lit("number").alias("value_kind"))
    names = events.select(*base, F.lit("").alias("property_key"), F.lit("").alias("value_kind"))
    return merge_event_schema(texts.unionByName(numbers).unionByName(names).withColumnRenamed("timestamp", "last_seen"))


def merge_event_schema(*parts: DataFrame) -> DataFrame:
    return _union(parts).groupBy(*SCHEMA_KEY).agg(F.max("last_seen").alias("last_seen"))


def _union(parts: tuple[DataFrame, ...]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
