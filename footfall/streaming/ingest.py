"""Ingest as a stream: requests in, events, rollups, rejected requests and counts out.

There is no watermark: events may be late by any time, as backfills are.
Copies are removed when events are read. Each micro-batch appends its events
and merges partial rollups into stored ones; a batch that is run again after a
failure replaces its own parts, which are kept by batch id.
"""

from __future__ import annotations

from datetime import datetime
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.time import month
from ..operators import identity, rollups
from ..schema import DEAD_LETTER, EVENTS, Tables
from ..sources.ingest import RAW, counters, ingest, merge_counters, outputs, unbatch
from ..sources.store import Store

PARTS = ("device_index", "person_traits", "event_schema", "bindings", "counters")


def write_batch(store: Store, projects: DataFrame | None = None):
    """A foreachBatch function that ingests one micro-batch of raw requests."""

    def run(raw: DataFrame, batch_id: int) -> None:
        spark = raw.sparkSession
        known, counted = (earlier(store, name, batch_id) for name in ("event_schema", "counters"))
        persisted = None if counted is None else counted.groupBy("project_id", "month").agg(F.sum("accepted").alias("accepted"))
        staging = store.path(f"staging/batch={batch_id}")
        store.delete(staging)
        stored = count()

        def keep(rows: DataFrame) -> DataFrame:
            at = f"{staging}/{next(stored)}"
            rows.write.parquet(at)
            return spark.read.schema(rows.schema).parquet(at)

        try:
            # Requests are parsed once and decided once; what follows reads stored rows.
            done = ingest(unbatch(raw), projects, persisted, known, keep)
            done = outputs(keep(done.rows), done.refused)
            # One folder a batch: a retry of the batch overwrites what its first run left.
            events_at = f"{store.path('incoming')}/batch={batch_id}"
            done.events.withColumn("month", month(F.col("timestamp"))).write.mode("overwrite").partitionBy("project_id", "month").parquet(events_at)
            events = spark.read.parquet(events_at).select(*EVENTS.names)
            done.dead_letter.write.mode("overwrite").parquet(f"{store.path('rejected')}/batch={batch_id}")
            parts = {
                "device_index": rollups.device_index(events), "person_traits": rollups.person_traits(events), "event_schema": rollups.event_schema(events),
                "bindings": done.bindings, "counters": counters(done.rows),
            }
            for name, rows in parts.items():
                rows.write.mode("overwrite").parquet(f"{store.path(f'parts/{name}')}/batch={batch_id}")
        finally:
            store.delete(staging)

    return run


def earlier(store: Store, name: str, batch_id: int) -> DataFrame | None:
    """The parts of a rollup that batches before this one wrote: the state that limits and quotas go by."""
    if not store.exists(f"parts/{name}"):
        return None
    return store.spark.read.parquet(store.path(f"parts/{name}")).where(F.col("batch") < batch_id).drop("batch")


def events(store: Store) -> DataFrame:
    """All events that batches have written."""
    return store.monthly("incoming").select(*EVENTS.names)


def tables(store: Store, now: datetime, project_id: int = 1) -> Tables:
    """What queries read of a store that batches have written: its events by month, its bindings and its rollups."""
    rolled = {name: part(store, name) for name in ("device_index", "person_traits", "event_schema")}
    return store.tables(now, project_id, "incoming", bindings=identity.bind(part(store, "bindings")), **rolled)


def dead_letter(store: Store) -> DataFrame:
    return store.spark.read.parquet(store.path("rejected")).select(*DEAD_LETTER.names)


def part(store: Store, name: str) -> DataFrame:
    """A rollup, merged from the parts of all batches."""
    rows = store.spark.read.parquet(store.path(f"parts/{name}")).drop("batch")
    merge = {"device_index": rollups.merge_device_index, "person_traits": rollups.merge_person_traits, "event_schema": rollups.merge_event_schema}
    if name in merge:
        return merge[name](rows)
    return merge_counters(rows, rows.limit(0)) if name == "counters" else rows


def compact(store: Store, name: str) -> None:
    """Merges all parts of a rollup into one; run between streams."""
    merged = part(store, name)
    to = f"{store.path('parts')}/_{name}.merged"
    merged.write.mode("overwrite").parquet(to)
    store.delete(store.path(f"parts/{name}"))
    fs, make = store._fs(to)
    fs.mkdirs(make(store.path(f"parts/{name}")))
    fs.rename(make(to), make(f"{store.path(f'parts/{name}')}/batch=-1"))


def start(spark: SparkSession, source: str, store: Store, checkpoint: str, projects: DataFrame | None = None, files: int = 100, **trigger) -> StreamingQuery:
    """Streams JSON-lines requests of a folder into a store; by default all there is, then stops."""
    raw = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files).json(source)
    return raw.writeStream.foreachBatch(write_batch(store, projects)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_counts(events: DataFrame, watermark: str = "48 hours") -> DataFrame:
    """Events a minute of a live stream, each id once: only for input that is at most a day off its own time.

    Event times lie within a day of receipt, so two days of state suffice;
    rows that are later than that are dropped, which backfills would be.
    """
    marked = events.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["project_id", "event_id"])
    return marked.groupBy("project_id", F.window("timestamp", "1 minute").alias("w"), "event_name").agg(F.count("*").alias("events")).select("project_id", F.col("w.start").alias("bucket"), "event_name", "events")


def tail(spark: SparkSession, store: Store, table: str = "events") -> DataFrame:
    """Stored events as a stream, for following them as they come; those of batches are the table ``incoming``."""
    return spark.readStream.schema(EVENTS).option("recursiveFileLookup", "false").parquet(store.path(table))
