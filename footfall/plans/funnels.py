"""Funnels: how far people get through ordered steps."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import instant
from ..operators.sequence import funnel_levels, funnel_levels_folded
from ..schema import Tables
from . import predicates as P
from . import segments
from .ast import Funnel, Node
from .validate import validate_funnel, validate_range

DEFAULT_DAYS = 7


@dataclass(frozen=True)
class Range:
    since: datetime
    until: datetime


def resolve_range(now: datetime, days: int | None = None, since: datetime | None = None, until: datetime | None = None) -> Range:
    """Either days before now, or both ends; by default a week."""
    if days is not None and (since is not None or until is not None):
        raise ValueError("give days, or since and until")
    if (since is None) != (until is None):
        raise ValueError("since and until go together")
    found = Range(now - timedelta(days=days or DEFAULT_DAYS), now) if since is None else Range(since, until)
    validate_range(found.since, found.until)
    return found


def levels(t: Tables, funnel: Funnel, span: Range, segment: Node | None = None, folded: bool = False) -> DataFrame:
    """person_id, level, entered_at and partial of everyone with level 1 or more.

    ``segment`` leaves out other people altogether; a step's audience only
    keeps others from that step. partial: entered less than a window ago.
    """
    validate_funnel(funnel)
    window = timedelta(seconds=funnel.window_seconds)
    end = min(span.until + window, t.now)
    names = sorted({s.event for s in funnel.steps})
    events = t.between(span.since, end)
    if "*" not in names:
        events = events.where(F.col("event_name").isin(names))
    rows = segments.resolved_events(t, events)
    flags: dict[Node, str] = {}
    for step in funnel.steps:
        if step.audience is not None and step.audience not in flags:
            flags[step.audience] = name = f"_audience{len(flags)}"
            people = segments.persons(t, step.audience).select("person_id", F.lit(True).alias(name))
            rows = rows.join(people, "person_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    conditions = [P.event_is(s.event) & P.where(s.where) & (F.col(flags[s.audience]) if s.audience is not None else F.lit(True)) for s in funnel.steps]
    if segment is not None:
        rows = rows.join(segments.persons(t, segment).select("person_id"), "person_id", "left_semi")
    entry = F.col("timestamp") < instant(span.until)
    found = (funnel_levels_folded if folded else funnel_levels)(rows, conditions, funnel.window_seconds * 1000, entry).where("level > 0")
    entered = F.timestamp_millis("entered_ms")
    return found.select("person_id", "level", entered.alias("entered_at"), (entered > instant(t.now - window)).alias("partial"))


def histogram(found: DataFrame) -> DataFrame:
    """level, people, partial: where people stopped."""
    return found.groupBy("level").agg(F.count("*").alias("people"), F.count_if("partial").alias("partial"))


def report(found: DataFrame, steps: int) -> DataFrame:
    """step, people, from_previous, from_start: suffix sums of the histogram, with rates of 0 over nothing."""
    sums = found.agg(*[F.count_if(F.col("level") >= i).alias(f"n{i}") for i in range(1, steps + 1)])

    def rate(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("step"), F.col(f"n{i}").alias("people"), rate(F.col(f"n{i}"), F.col(f"n{max(1, i - 1)}")).alias("from_previous"), rate(F.col(f"n{i}"), F.col("n1")).alias("from_start")) for i in range(1, steps + 1)])
    return sums.select(F.inline(rows))


def summarise(rows: list[tuple[int, int, int]], events: list[str]) -> dict[str, Any]:
    """The report of histogram rows (level, people, partial): level 0 is left out, levels beyond the last step are it."""
    n, stopped, partial = len(events), {}, 0
    for level, people, part in rows:
        if level >= 1:
            stopped[min(level, n)] = stopped.get(min(level, n), 0) + people
            partial += part
    reached = [sum(p for k, p in stopped.items() if k >= i) for i in range(1, n + 1)]
    rate = lambda a, b: a / b if b else 0
    return {
        "entered": reached[0], "converted": reached[-1], "conversion_rate": rate(reached[-1], reached[0]), "partial_window_entrants": partial,
        "steps": [{"index": i + 1, "event": e, "people": reached[i], "from_previous": rate(reached[i], reached[max(0, i - 1)]), "from_start": rate(reached[i], reached[0])} for i, e in enumerate(events)],
    }


def biggest_leak(summary: dict[str, Any]) -> int | None:
    """Index of the step that loses the largest share of those before it; the first of equals; None if none loses any."""
    losses = [(1 - s["from_previous"], -s["index"]) for s in summary["steps"][1:] if s["from_previous"] < 1]
    return -max(losses)[1] if losses and summary["entered"] else None


def people(t: Tables, funnel: Funnel, span: Range, step: int, mode: str = "reached", after: tuple[datetime, str] | None = None, segment: Node | None = None, limit: int = segments.PAGE) -> DataFrame:
    """A page of person_id and entered_at: who reached a step, or stopped at it; newest entries first."""
    rows = _at_step(t, funnel, span, step, mode, segment)
    if after is not None:
        at, person = instant(after[0]), F.lit(after[1])
        rows = rows.where((F.col("entered_at") < at) | ((F.col("entered_at") == at) & (F.col("person_id") > person)))
    return rows.select("person_id", "entered_at").orderBy(F.col("entered_at").desc(), "person_id").limit(min(limit, segments.PAGE))


def people_count(t: Tables, funnel: Funnel, span: Range, step: int, mode: str = "reached", segment: Node | None = None) -> DataFrame:
    return _at_step(t, funnel, span, step, mode, segment).agg(F.count("*").alias("person_count"))


def people_members(t: Tables, funnel: Funnel, span: Range, step: int, mode: str = "reached", segment: Node | None = None) -> DataFrame:
    """The first page of people, with the columns of segment members."""
    rows = _at_step(t, funnel, span, step, mode, segment)
    none, none_num = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,double>")
    rows = rows.join(segments.base(t), "person_id", "left").join(segments.traits(t), "person_id", "left")
    rows = rows.withColumns({"traits": F.coalesce("traits", none), "traits_num": F.coalesce("traits_num", none_num)})
    return rows.select(*segments.member_columns(), "entered_at").orderBy(F.col("entered_at").desc(), "person_id").limit(segments.PAGE)


def _at_step(t: Tables, funnel: Funnel, span: Range, step: int, mode: str, segment: Node | None) -> DataFrame:
    if mode not in ("reached", "dropped") or not 1 <= step <= len(funnel.steps):
        raise ValueError("mode is reached or dropped, step one of the funnel's")
    found = levels(t, funnel, span, segment)
    return found.where(F.col("level") >= step if mode == "reached" else F.col("level") == step)
