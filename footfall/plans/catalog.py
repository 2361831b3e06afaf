"""What has been observed: names of events, their properties, values of traits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rollups import TRAIT_KEY

DEFAULT, MOST = 50, 100


def _page(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit is 1 to {MOST}")
    return rows.orderBy(*order).limit(limit)


def event_names(schema: DataFrame, project_id: int, prefix: str = "", limit: int = DEFAULT) -> DataFrame:
    """event_name, last_seen of names that begin with a prefix (case counts), in order."""
    rows = schema.where((F.col("project_id") == project_id) & F.col("event_name").startswith(prefix))
    return _page(rows.groupBy("event_name").agg(F.max("last_seen").alias("last_seen")), ["event_name"], limit)


def properties(schema: DataFrame, project_id: int, event: str = "", prefix: str = "", limit: int = DEFAULT) -> DataFrame:
    """Distinct property_key, value_kind; the row that stands for an event itself is none."""
    rows = schema.where((F.col("project_id") == project_id) & (F.col("property_key") != "") & F.col("property_key").startswith(prefix))
    if event:
        rows = rows.where(F.col("event_name") == event)
    return _page(rows.select("property_key", "value_kind").distinct(), ["property_key", "value_kind"], limit)


def property_kinds(listed: DataFrame) -> DataFrame:
    """property_key, kind: number, string, or mixed where both occur; unknown kinds read as string."""
    kinds = F.array_intersect(F.collect_set("value_kind"), F.array(F.lit("string"), F.lit("number")))
    kind = F.when(F.size("kinds") == 2, "mixed").when(F.array_contains("kinds", "number"), "number").otherwise("string")
    return listed.groupBy("property_key").agg(kinds.alias("kinds")).select("property_key", kind.alias("kind"))


def trait_values(stored: DataFrame, project_id: int, trait: str, prefix: str = "", limit: int = DEFAULT) -> DataFrame:
    """Distinct latest text values of a trait over raw identities."""
    rows = stored.where((F.col("project_id") == project_id) & (F.col("trait_key") == trait))
    value = F.max(F.struct("updated_at", "event_id", "value_str", "has_num"))
    last = rows.groupBy(*TRAIT_KEY).agg(value.alias("v")).where("v.has_num = 0").select(F.col("v.value_str").alias("value"))
    return _page(last.where(F.col("value").startswith(prefix)).distinct(), ["value"], limit)
