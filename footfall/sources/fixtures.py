"""The plain ``events`` test table as canonical events with identities, traits and retries."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import bind
from ..schema import EVENTS, Tables

NOW = datetime(2024, 1, 31, tzinfo=UTC)
SUPPRESSED_AT = datetime(2024, 1, 15, tzinfo=UTC)


def _pick(i: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def canonical_events(spark: SparkSession, sf_dir: str, number: str | None = None) -> DataFrame:
    """Every column of an event, by arithmetic on ids; every 97th event is delivered again 7 seconds later.

    An event's id holds twelve digits of its number; ``number`` names a column for the whole of it.
    """
    e, u = F.col("event_id"), F.col("user_id")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    identify = (F.col("event_type") == "signup") & (e % 2 == 0)
    plain = e % 4 != 0
    at = F.date_trunc("MILLISECOND", F.col("ts").cast("timestamp"))
    none, none_num = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,double>")
    path = _pick(e % 6, "/", "/pricing", "/docs", "/changelog", "/signup", "")
    rows = raw.select(
        F.lit(1).cast("long").alias("project_id"),
        F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(e.cast("string"), 12, "0")).alias("event_id"),
        F.when(u % 10 < 2, F.concat(F.lit("dev-shared-"), (u - u % 10).cast("string"))).otherwise(F.concat(F.lit("dev-"), (u * 2 + e % 2).cast("string"))).alias("anonymous_id"),
        F.when((e % 3 == 0) | identify, F.concat(F.lit("user-"), u.cast("string"))).otherwise("").alias("user_id"),
        F.when(identify, "$identify").otherwise(F.col("event_type")).alias("event_name"),
        at.alias("timestamp"),
        F.timestamp_millis(F.unix_millis(at) + (e % 5) * 1000).alias("received_at"),
        F.lit(0).cast("byte").alias("trusted"),
        F.when(identify, F.create_map(F.lit("plan"), _pick(u % 3, "free", "pro", "enterprise"))).when(plain, F.create_map(F.lit("kind"), F.concat(F.lit("k"), (k % 7).cast("string")))).otherwise(none).alias("properties"),
        F.when(identify, F.create_map(F.lit("seats"), k.cast("double"))).when(plain, F.create_map(F.lit("value"), F.col("value"), F.lit("k"), k.cast("double"))).otherwise(F.create_map(F.lit("value"), F.col("value"))).cast("map<string,double>").alias("properties_num"),
        F.when(path == "", "").otherwise(F.concat(F.lit("https://example.com"), path)).alias("url"),
        path.alias("path"),
        _pick(u % 4, "https://search.example", "", "https://news.example", "").alias("referrer"),
        _pick(u % 4, "google", "", "newsletter", "twitter").alias("utm_source"),
        _pick(u % 4, "cpc", "", "email", "social").alias("utm_medium"),
        _pick(u % 4, "spring", "", "summer", "").alias("utm_campaign"),
        F.lit("").alias("utm_term"), F.lit("").alias("utm_content"),
        _pick(u % 3, "desktop", "mobile", "tablet").alias("device_type"),
        _pick(u % 4, "windows", "macos", "ios", "android").alias("os"),
        _pick(e % 3, "chrome", "firefox", "safari").alias("browser"),
        _pick(e % 5, "US", "DE", "FR", "JP", "").alias("country"),
        F.lit("").alias("region"), F.lit("").alias("city"),
        (e % 97 == 0).alias("_again"), *([e.alias(number)] if number else []),
    )
    # One row or two by a generator: the scan isn't read twice.
    copies = F.explode(F.when(F.col("_again"), F.array(F.lit(0), F.lit(7000))).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("_later", copies)
    for c in ("timestamp", "received_at"):
        rows = rows.withColumn(c, F.timestamp_millis(F.unix_millis(c) + F.col("_later")))
    return rows.select(*EVENTS.names, *([number] if number else []))


def bindings_of(events: DataFrame) -> DataFrame:
    """What identify events bind."""
    named = events.where("event_name = '$identify' AND anonymous_id <> '' AND user_id <> ''")
    return bind(named.select("project_id", "anonymous_id", F.col("user_id").alias("person_id"), F.col("timestamp").alias("bound_at")))


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """Canonical events and side tables of a test folder."""
    events = canonical_events(spark, sf_dir)
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("u")).distinct()
    name = lambda c: F.concat(F.lit("user-"), c.cast("string"))
    one = F.lit(1).cast("long").alias("project_id")
    aliases = users.where("u % 10 = 9").select(one, name(F.col("u")).alias("person_id"), name(F.col("u") - 1).alias("canonical_id"))
    suppressed = users.where("u % 25 = 3").select(one, name(F.col("u")).alias("person_id"), F.lit(SUPPRESSED_AT).alias("suppressed_at"))
    return Tables(events, bindings_of(events), aliases, suppressed, NOW)
