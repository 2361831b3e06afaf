"""Export of a person as lines of JSON: a person line, event lines, an end line with their number."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.events import FEED_COLUMNS
from ..plans.person import Scope, export_events, export_traits, summary
from ..schema import Tables


def export_rows(t: Tables, s: Scope) -> DataFrame:
    """(part, at, id, line): parts 0 person, 1 events, 2 end."""
    shown = export_events(t, s)
    traits = export_traits(t, s).agg(F.map_from_entries(F.collect_list(F.struct("trait_key", F.when(F.col("has_num") == 1, F.col("value_num").cast("string")).otherwise(F.col("value_str"))))).alias("traits"))
    person = summary(t, s).withColumn("k", F.lit(1)).join(traits.withColumn("k", F.lit(1)), "k")
    head = person.select(F.to_json(F.struct(F.lit("person").alias("type"), F.lit(s.canonical).alias("person_id"), F.array(*[F.lit(g) for g in s.group]).alias("ids"), "first_seen", "last_seen", "traits")).alias("line"))
    lines = shown.select(F.lit(1).alias("part"), F.col("timestamp").alias("at"), F.col("event_id").alias("id"), F.to_json(F.struct(F.lit("event").alias("type"), *FEED_COLUMNS)).alias("line"))
    none = F.lit(None).cast("timestamp").alias("at")
    tail = lines.agg(F.to_json(F.struct(F.lit("end").alias("type"), F.count("*").alias("events"))).alias("line"))
    return (
        head.select(F.lit(0).alias("part"), none, F.lit("").alias("id"), "line")
        .unionByName(lines)
        .unionByName(tail.select(F.lit(2).alias("part"), none, F.lit("").alias("id"), "line"))
        .orderBy("part", "at", "id")
    )


def export_person(t: Tables, s: Scope) -> Iterator[str]:
    """The lines, partition by partition; without the end line the export is cut off."""
    for row in export_rows(t, s).select("line").toLocalIterator():
        yield row["line"]


def write_export(t: Tables, s: Scope, path: str) -> None:
    """The lines as one text file: one person's events, in order."""
    export_rows(t, s).select("line").coalesce(1).write.mode("overwrite").text(path)
