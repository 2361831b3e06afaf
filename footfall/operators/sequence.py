"""Ordered sequences of steps within a sliding window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def funnel_levels(events: DataFrame, steps: list[Column], window_ms: int, entry: Column | None = None) -> DataFrame:
    """person_id, level, entered_at (ms) of everyone with an event that matches a step.

    level: the most steps in order within ``window_ms`` of the first of them,
    over all attempts; other events may lie between. One event takes one step
    of a chain; events at one instant follow the order of their ids. The fold's
    state is, for each step, the latest start of a chain that has reached it: a
    later start only leaves more room. ``entry`` is what the first step also
    asks for. entered_at is the first match of step 1.

    A window of the state by step, so a person of any length of history is
    spilled rather than held in one array: at most one pass for each step.
    """
    ms = F.unix_millis("timestamp")
    first = steps[0] & entry if entry is not None else steps[0]
    marks = [first, *steps[1:]]
    rows = events.select("person_id", ms.alias("ms"), F.col("event_id").alias("id"), *[m.alias(f"m{i}") for i, m in enumerate(marks)])
    rows = rows.where(" OR ".join(f"m{i}" for i in range(len(marks))))
    before = Window.partitionBy("person_id").orderBy("ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("s0", F.when(F.col("m0"), F.col("ms")))
    for i in range(1, len(marks)):
        start = F.max(f"s{i - 1}").over(before)
        rows = rows.withColumn("_start", start)
        rows = rows.withColumn(f"s{i}", F.when(F.col(f"m{i}") & (F.col("ms") <= F.col("_start") + window_ms), F.col("_start"))).drop("_start")
    reached = [F.max(f"s{i}").isNotNull().cast("int") for i in range(len(marks))]
    level = reached[0]
    for r in reached[1:]:
        level = level + r
    return rows.groupBy("person_id").agg(level.alias("level"), F.min("s0").alias("entered_ms"))


def funnel_levels_folded(events: DataFrame, steps: list[Column], window_ms: int, entry: Column | None = None) -> DataFrame:
    """The same by a fold over each person's matching events, for histories that fit a row.

    Only people with a first step are folded; the others have level 0.
    """
    n = len(steps)
    first = steps[0] & entry if entry is not None else steps[0]
    masks = F.array(first, *steps[1:])
    rows = events.select("person_id", F.struct(F.unix_millis("timestamp").alias("ms"), F.col("event_id").alias("id"), masks.alias("m")).alias("e")).where(F.exists("e.m", lambda x: x))
    people = rows.groupBy("person_id").agg(F.min(F.when(F.col("e.m")[0], F.col("e.ms"))).alias("entered_ms"), F.sort_array(F.collect_list("e")).alias("all"))
    none = F.lit(None).cast("bigint")

    def step(state: Column, e: Column) -> Column:
        def slot(old: Column, i: Column) -> Column:
            start = F.when(i == 0, e["ms"]).otherwise(F.get(state, i - 1))
            take = F.get(e["m"], i) & start.isNotNull() & ((i == 0) | (e["ms"] <= start + window_ms))
            return F.when(take, F.greatest(start, F.coalesce(old, start))).otherwise(old)

        return F.transform(state, slot)

    folded = F.aggregate("all", F.array(*[none] * n), step)
    level = F.when(F.col("entered_ms").isNull(), 0).otherwise(F.size(F.filter(folded, lambda x: x.isNotNull())))
    return people.select("person_id", level.cast("int").alias("level"), "entered_ms")
