"""A made-up cohort of visitors, the same for a seed at any number of partitions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import instant
from ..schema import BINDINGS, EVENTS
from .store import Store

MOST_PERSONS, MOST_EVENTS, MOST_DAYS = 200_000, 2_000_000, 3650
# The steps of the made-up funnel and the share that takes each.
FUNNEL = (("$page", 1.0), ("signup_started", 0.8), ("signup_completed", 0.875), ("checkout_started", 0.55), ("purchase", 0.62))
FILLER = ("$page", "feature_used", "docs_search", "invite_sent")
PLANS, COUNTRIES, SOURCES = ("free", "pro", "enterprise"), ("US", "DE", "FR", "JP", "BR"), ("google", "newsletter", "twitter", "")


def _draw(seed: int, *what: Column | str) -> Column:
    """A number in [0, 1) from a hash of the seed and what it is for."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.lit(w) if isinstance(w, str) else w for w in what]), F.lit(1 << 30)) / float(1 << 30)


def _choose(draw: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(draw * len(values)) + 1).cast("int"))


def generate(spark: SparkSession, now: datetime, persons: int = 400, events: int = 5000, days: int = 90, seed: int = 1, project_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """(events, bindings) of ``persons`` over the ``days`` before now."""
    if not (1 <= persons <= MOST_PERSONS and 1 <= events <= MOST_EVENTS and 1 <= days <= MOST_DAYS):
        raise ValueError("beyond the limits of the generator")
    who = F.col("person")
    people = spark.range(persons).withColumnRenamed("id", "person")
    begin = F.unix_millis(instant(now - timedelta(days=days)))
    people = people.withColumn("start", (begin + _draw(seed, "start", who) * (days * 86_400_000 * 0.9)).cast("long"))
    reached, steps = F.lit(True), []
    for i, (name, share) in enumerate(FUNNEL):
        reached = reached & (_draw(seed, "step", F.lit(i), who) < share)
        steps.append(F.when(reached, F.struct(F.lit(name).alias("event_name"), (F.col("start") + i * 60_000 + (_draw(seed, "lag", F.lit(i), who) * 50_000)).cast("long").alias("ms"), F.lit(i).alias("n"))))
    funnel = people.select("person", F.explode(F.filter(F.array(*steps), lambda x: x.isNotNull())).alias("e")).select("person", "e.*")
    named = people.where(_draw(seed, "step", F.lit(0), who) < 1).where((_draw(seed, "step", F.lit(1), who) < FUNNEL[1][1]) & (_draw(seed, "step", F.lit(2), who) < FUNNEL[2][1]))
    identify = named.select("person", F.lit("$identify").alias("event_name"), (F.col("start") + 150_000).cast("long").alias("ms"), F.lit(90).alias("n"))
    each = max(0, events // persons - 3)
    span = instant(now)
    filler = people.select("person", "start", F.explode(F.sequence(F.lit(100), F.lit(99 + max(1, each)))).alias("n")) if each else None
    rows = funnel.unionByName(identify)
    if filler is not None:
        room = F.unix_millis(span) - F.col("start")
        rows = rows.unionByName(filler.select("person", _choose(_draw(seed, "filler", who, F.col("n")), FILLER).alias("event_name"), (F.col("start") + _draw(seed, "at", who, F.col("n")) * room).cast("long").alias("ms"), "n"))
    none, none_num = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,double>")
    is_identify = F.col("event_name") == "$identify"
    user, device = F.concat(F.lit("demo-user-"), who.cast("string")), F.concat(F.lit("demo-device-"), who.cast("string"))
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), who.cast("string"), F.col("n").cast("string"), "event_name"))
    at = F.timestamp_millis("ms")
    values = {
        "project_id": F.lit(project_id).cast("long"),
        "event_id": F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("4"), F.substring(digest, 14, 3)), F.concat(F.lit("8"), F.substring(digest, 18, 3)), F.substring(digest, 21, 12)),
        "anonymous_id": device, "user_id": F.when(is_identify, user).otherwise(""), "event_name": F.col("event_name"), "timestamp": at, "received_at": at, "trusted": F.lit(1).cast("byte"),
        "properties": F.when(is_identify, F.create_map(F.lit("plan"), _choose(_draw(seed, "plan", who), PLANS), F.lit("country"), _choose(_draw(seed, "country", who), COUNTRIES))).otherwise(none),
        "properties_num": F.when(is_identify, F.create_map(F.lit("seats"), F.floor(_draw(seed, "seats", who) * 50).cast("double"))).otherwise(none_num),
        "utm_source": _choose(_draw(seed, "source", who), SOURCES), "country": _choose(_draw(seed, "country", who), COUNTRIES),
    }
    out = rows.select(*[values.get(c, F.lit("")).alias(c) for c in EVENTS.names])
    bindings = identify.select(F.lit(project_id).cast("long").alias("project_id"), device.alias("anonymous_id"), user.alias("person_id"), F.timestamp_millis("ms").alias("bound_at"))
    return out, bindings.select(*BINDINGS.names)


def insert(store: Store, events: DataFrame, bindings: DataFrame) -> None:
    """Writes a cohort to a store."""
    store.append_events(events)
    bindings.write.mode("append").parquet(store.path("bindings"))
