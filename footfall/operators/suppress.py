"""Hiding what deleted people did up to the instant of their deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_suppressed(rows: DataFrame, suppressed: DataFrame, instant: str, person: str = "person_id") -> DataFrame:
    """Rows whose person isn't suppressed, or whose instant is after the boundary; the boundary itself is hidden."""
    hidden = suppressed.select(F.col("project_id").alias("_sp"), F.col("person_id").alias("_sid"), "suppressed_at")
    joined = rows.join(hidden, (F.col("project_id") == F.col("_sp")) & (F.col(person) == F.col("_sid")), "left")
    return joined.where(F.col("suppressed_at").isNull() | (F.col(instant) > F.col("suppressed_at"))).drop("_sp", "_sid", "suppressed_at")


def upsert(suppressed: DataFrame, new: DataFrame) -> DataFrame:
    """Boundaries after adding new ones; the later one of a person holds."""
    return suppressed.unionByName(new).groupBy("project_id", "person_id").agg(F.max("suppressed_at").alias("suppressed_at"))


def boundary(suppressed: DataFrame, project_id: int, ids: list[str]) -> DataFrame:
    """One row: the latest boundary of a group of ids, or null."""
    return suppressed.where((F.col("project_id") == project_id) & F.col("person_id").isin(ids)).agg(F.max("suppressed_at").alias("suppressed_at"))
