"""Stored tables: events by project and month, rollups, and side tables, as Parquet."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import month, within
from ..schema import ALIASES, BINDINGS, DEAD_LETTER, EVENTS, SUPPRESSED, Tables

#: Rows of a month's file before another is begun, so that no task writes without end.
FILE_ROWS = 5_000_000


@dataclass(frozen=True)
class Store:
    """Tables under one root, on any file system that Spark reads."""

    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def append_events(self, events: DataFrame) -> None:
        """Adds events; each file holds one month of one project in order of time."""
        rows = events.select(*EVENTS.names, month(F.col("timestamp")).alias("month"))
        # Rebalancing by the partition keys splits a busy project's month over tasks.
        rows = rows.hint("rebalance", "project_id", "month").sortWithinPartitions("project_id", "month", "timestamp", "anonymous_id", "event_id")
        rows.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).partitionBy("project_id", "month").parquet(self.path("events"))

    def events(self, project_id: int | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """Events; a project and bounds of time prune partitions, then row groups."""
        rows = self.monthly()
        if project_id is not None:
            rows = rows.where(F.col("project_id") == project_id)
        return within(rows, since, until).select(*EVENTS.names)

    def monthly(self, table: str = "events") -> DataFrame:
        """Events with the column month that they are stored by."""
        schema = T.StructType([*EVENTS.fields, T.StructField("month", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path(table))

    def tables(self, now: datetime, project_id: int = 1, table: str = "events", **stored: DataFrame) -> Tables:
        """What queries read: stored events and side tables; ``stored`` are rollups, or tables in place of the side tables."""
        rows, side = self.monthly(table), {"bindings": BINDINGS, "aliases": ALIASES, "suppressed": SUPPRESSED}
        found = {name: self.read(name, schema) for name, schema in side.items() if name not in stored}
        return Tables(rows.select(*EVENTS.names), **(found | stored), now=now, project_id=project_id, monthly=rows)

    def append_dead_letter(self, rows: DataFrame) -> None:
        rows.select(*DEAD_LETTER.names, month(F.col("received_at")).alias("month")).write.mode("append").partitionBy("month").parquet(self.path("dead_letter"))

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        """A side table; empty if it was never written."""
        return self.spark.read.schema(schema).parquet(self.path(table)) if self.exists(table) else self.spark.createDataFrame([], schema)

    def replace(self, table: str, rows: DataFrame) -> None:
        """Writes a table anew beside the old one, then swaps them; a reader in between may find none."""
        new = self.path(f"_{table}.new")
        rows.write.mode("overwrite").parquet(new)
        self.delete(self.path(table))
        fs, make = self._fs(new)
        if not fs.rename(make(new), make(self.path(table))):
            raise OSError(f"{new} can't be renamed")

    def drop_months(self, expired: DataFrame) -> int:
        """Deletes the (project_id, month) partitions listed; how many there were. Nothing is rewritten."""
        rows = expired.select("project_id", "month").distinct().collect()
        for r in rows:
            self.delete(f"{self.path('events')}/project_id={r['project_id']}/month={r['month']}")
        return len(rows)

    def exists(self, table: str) -> bool:
        fs, make = self._fs(self.path(table))
        return fs.exists(make(self.path(table)))

    def delete(self, path: str) -> None:
        fs, make = self._fs(path)
        fs.delete(make(path), True)

    def _fs(self, path: str):
        make = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return make(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), make


def jdbc(spark: SparkSession, url: str, table: str, schema: T.StructType, **options: str) -> DataFrame:
    """A side table from a relational database, where its driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*schema.names)
