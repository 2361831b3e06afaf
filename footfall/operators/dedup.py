"""One row for each event id, decided after the filters of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by_event_id(events: DataFrame) -> DataFrame:
    """The earliest copy of each event; of copies at one instant the one received last.

    A retry that the scan's filters drop doesn't count, so filter first.
    """
    order = Window.partitionBy("project_id", "event_id").orderBy("timestamp", F.col("received_at").desc())
    return events.withColumn("_copy", F.row_number().over(order)).where("_copy = 1").drop("_copy")


def compact(events: DataFrame) -> DataFrame:
    """Copies with equal sort keys (project, instant, device, id) become the one received last."""
    order = Window.partitionBy("project_id", "timestamp", "anonymous_id", "event_id").orderBy(F.col("received_at").desc())
    return events.withColumn("_copy", F.row_number().over(order)).where("_copy = 1").drop("_copy")


def duplicates(events: DataFrame) -> DataFrame:
    """event_id and copies of every event stored more than once."""
    return events.groupBy("project_id", "event_id").agg(F.count("*").alias("copies")).where("copies > 1")
