"""Copies of tables with a manifest of their row counts, and their return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest"


class Incomplete(ValueError):
    """A copy whose rows aren't those of its manifest."""


def backup(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table and then the manifest (table, rows), counted from what was written; returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        counts.append(spark.read.schema(df.schema).parquet(f"{path}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows"))
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    every.coalesce(1).write.mode("errorifexists").json(f"{path}/{MANIFEST}")
    return spark.read.schema("table string, rows long").json(f"{path}/{MANIFEST}")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a copy; Incomplete if any has other counts than the manifest."""
    manifest = spark.read.schema("table string, rows long").json(f"{path}/{MANIFEST}").collect()
    out = {r["table"]: spark.read.parquet(f"{path}/{r['table']}") for r in manifest}
    for r in manifest:
        if out[r["table"]].count() != r["rows"]:
            raise Incomplete(r["table"])
    return out
