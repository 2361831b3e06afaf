"""Ingest: raw requests to events, rejected ones and counts, in columns only.

A raw request is a row of project_id, received_at, user_agent (of the
transport) and body (a JSON text of one payload). Every row gets an outcome:
rejected, bot, throttled, over_quota or accepted, decided in this order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import enrich
from ..functions.time import clamp, millis
from ..schema import DEAD_LETTER, EVENTS

RAW = T.StructType([T.StructField("project_id", T.LongType()), T.StructField("received_at", T.TimestampType()), T.StructField("user_agent", T.StringType()), T.StructField("body", T.StringType())])
MAX_ID, MAX_URL, MAX_AGENT, MAX_BATCH = 128, 2048, 1024, 500
MAX_PROPERTIES, MAX_NAMES, MAX_KEYS = 250, 1000, 500
DETAIL, PAYLOAD = 1000, 8000
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_TEXTS = {"url": MAX_URL, "path": MAX_URL, "referrer": MAX_URL, "user_agent": MAX_AGENT, "utm_source": MAX_ID, "utm_medium": MAX_ID, "utm_campaign": MAX_ID, "utm_term": MAX_ID, "utm_content": MAX_ID}
_STORED = [k for k in _TEXTS if k != "user_agent"]
OUTCOMES = ("accepted", "rejected", "throttled", "over_quota", "bot")


def read_requests(spark, path: str) -> DataFrame:
    """Requests of JSON lines {project_id, received_at, user_agent, body}."""
    return spark.read.schema(RAW).json(path)


def unbatch(raw: DataFrame) -> DataFrame:
    """Rows whose body is {"batch": [...]} become one row an item; an empty or too long batch stays whole, and is rejected."""
    items = F.try_variant_get(F.try_parse_json("body"), "$.batch", "array<variant>")
    good = items.isNotNull() & F.size(items).between(1, MAX_BATCH)
    bodies = F.when(good, F.transform(items, lambda v: F.to_json(v))).otherwise(F.array("body"))
    return raw.withColumn("body", F.explode(bodies))


def _get(field: str, kind: str = "string") -> Column:
    return F.try_variant_get("_v", f"$.{field}", kind)


def _kind(field: str) -> Column:
    """The JSON type of a field: null if absent."""
    return F.schema_of_variant(F.try_variant_get("_v", f"$.{field}", "variant"))


def _bad_text(field: str, most: int, needed: bool = False, least: int = 0) -> Column:
    kind, value = _kind(field), _get(field)
    wrong = (kind != "STRING") | (F.char_length(value) > most) | (F.char_length(value) < least)
    return F.when(kind.isNull(), F.lit(needed)).otherwise(F.coalesce(wrong, F.lit(True)))


def parse(raw: DataFrame) -> DataFrame:
    """``raw`` with an event's columns and ``problem``: what makes the payload invalid, or null."""
    rows = raw.withColumn("_v", F.try_parse_json("body"))
    kind = _get("type")
    bag = F.when(kind == "identify", F.lit("traits")).otherwise(F.lit("properties"))
    rows = rows.withColumn("_bag", F.when(kind == "identify", F.try_variant_get("_v", "$.traits", "variant")).otherwise(F.try_variant_get("_v", "$.properties", "variant")))
    entries = F.try_variant_get("_bag", "$", "map<string,variant>")
    # Each entry as (key, kind, text), which routing reads.
    typed = F.transform(
        F.map_entries(F.coalesce(entries, F.create_map().cast("map<string,variant>"))),
        lambda e: F.struct(e["key"].alias("key"), F.schema_of_variant(e["value"]).alias("type"), F.try_variant_get(e["value"], "$", "string").alias("value")),
    )
    rows = rows.withColumn("_typed", typed)
    number = lambda c: c.startswith("BIGINT") | c.startswith("DECIMAL") | c.startswith("DOUBLE")
    rows = rows.withColumn("_entries", F.transform("_typed", lambda e: F.struct(e["key"].alias("key"), F.when(e["type"] == "STRING", "string").when(e["type"] == "BOOLEAN", "boolean").when(e["type"] == "VOID", "null").when(number(e["type"]), "number").otherwise("other").alias("kind"), e["value"].alias("value"))))
    identified = (F.coalesce(_get("anonymous_id"), F.lit("")) != "") | (F.coalesce(_get("user_id"), F.lit("")) != "")
    context_kind = _kind("context")
    problem = (
        F.when(F.col("_v").isNull(), "not JSON")
        .when(F.coalesce(~kind.isin("track", "page", "identify"), F.lit(True)), "type")
        .when(F.coalesce(~_get("message_id").rlike(UUID), F.lit(True)), "message_id")
        .when(_bad_text("anonymous_id", MAX_ID, least=1), "anonymous_id")
        .when(F.when(kind == "identify", _bad_text("user_id", MAX_ID, True, 1)).otherwise(_bad_text("user_id", MAX_ID, least=1)), "user_id")
        .when(~identified, "anonymous_id or user_id is required")
        .when((kind == "track") & _bad_text("event", MAX_ID, True, 1), "event")
        .when((kind == "page") & _bad_text("name", MAX_ID, least=1), "name")
        .when(F.coalesce(_kind("timestamp") != "STRING", F.lit(False)), "timestamp")
        .when(F.col("_bag").isNotNull() & (entries.isNull() | ~F.schema_of_variant("_bag").startswith("OBJECT")), F.concat(bag, F.lit(" is an object")))
        .when(F.exists("_entries", lambda e: e["kind"] == "other"), F.concat(bag, F.lit(" hold scalars")))
        .when(context_kind.isNull(), None)
        .when(~context_kind.startswith("OBJECT"), "context")
    )
    for name, most in _TEXTS.items():
        problem = problem.when(_bad_text(f"context.{name}", most), f"context.{name}")
    rows = rows.withColumn("problem", problem)
    texts, numbers = enrich.route(F.col("_entries"))
    library = F.when(F.coalesce(F.char_length(_get("context.library.version")).between(1, MAX_ID), F.lit(False)), _get("context.library.name"))
    forwarded = _get("context.user_agent")
    agent = enrich.visitor_agent(F.col("user_agent"), forwarded, library)
    name = F.when(kind == "track", _get("event")).when(kind == "page", "$page").otherwise("$identify")
    page = F.when((kind == "page") & _get("name").isNotNull(), F.create_map(F.lit("$page_name"), _get("name"))).otherwise(F.create_map().cast("map<string,string>"))
    empty = F.lit("")
    now = millis(F.col("received_at"))
    return rows.select(
        "project_id", F.lower(_get("message_id")).alias("event_id"), F.coalesce(_get("anonymous_id"), empty).alias("anonymous_id"), F.coalesce(_get("user_id"), empty).alias("user_id"),
        name.alias("event_name"), clamp(_get("timestamp"), now).alias("timestamp"), now.alias("received_at"), F.lit(0).cast("byte").alias("trusted"),
        F.when(F.col("problem").isNull(), F.map_concat(texts, page)).alias("properties"), F.when(F.col("problem").isNull(), numbers).alias("properties_num"),
        *[F.coalesce(_get(f"context.{k}"), empty).alias(k) for k in _STORED],
        enrich.device_type(agent).alias("device_type"), enrich.system(agent).alias("os"), enrich.browser(agent).alias("browser"),
        empty.alias("country"), empty.alias("region"), empty.alias("city"),
        "body", "problem", kind.alias("kind"), F.size("_entries").alias("n_properties"), F.transform("_entries", lambda e: e["key"]).alias("keys"),
        enrich.bot_verdict(F.col("user_agent"), forwarded, library).alias("bot"),
    )


def _rank(rows: DataFrame, keys: list[str], to: str) -> DataFrame:
    """Ranks rows of each key in order of arrival, counted minute by minute so that a busy key is no single task."""
    minute = F.date_trunc("minute", "received_at")
    marked = rows.withColumn("_minute", minute)
    counts = marked.groupBy(*keys, "_minute").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_minute")) - F.col("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_minute").orderBy("received_at", "event_id", "body"))
    joined = marked.withColumn("_inside", inside).join(counts.select(*keys, "_minute", before.alias("_before")), [*keys, "_minute"])
    return joined.withColumn(to, F.col("_before") + F.col("_inside")).drop("_minute", "_inside", "_before")


def _admit(group: pd.DataFrame) -> pd.DataFrame:
    """The key sets of one event name that are refused, in order of their first arrival."""
    known: set[str] = set()
    refused = []
    for keys in group.sort_values(["received_at", "event_id"])["keyset"]:
        more = known.union(keys)
        refused.append(len(more) > MAX_KEYS)
        if not refused[-1] or not known:  # what was observed before comes first, and stays
            known = more
    out = group.sort_values(["received_at", "event_id"])[["project_id", "event_name", "keyset"]]
    return out[refused]


def limited(parsed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``parsed`` with ``limit``: what throttles a valid event, or null; and ``names_full``: when its project had MAX_NAMES names, or null.

    too_many_properties; event_name_cardinality: the names of a project in
    order of their first arrival, those stored before first;
    property_key_cardinality: an event whose keys, with those accepted for its
    name before, are more than MAX_KEYS. As accepted keys only grow, a set of
    keys that is refused once is refused for good, so only the first arrival
    of each distinct set is decided one by one, and only for names that have
    more than MAX_KEYS keys in all. ``known`` is the event schema observed so
    far (project_id, event_name, property_key): its names and keys come first.
    """
    fine = parsed.where("problem IS NULL AND NOT bot").where(F.col("n_properties") <= MAX_PROPERTIES)
    sets = fine.groupBy("project_id", "event_name", F.array_sort("keys").alias("keyset")).agg(F.min(F.struct("received_at", "event_id")).alias("at"))
    if known is not None:
        before = F.struct(F.timestamp_millis(F.lit(0)).alias("received_at"), F.lit("").alias("event_id")).alias("at")
        old = known.groupBy("project_id", "event_name").agg(F.array_sort(F.array_remove(F.collect_set("property_key"), "")).alias("keyset"))
        sets = sets.unionByName(old.select("project_id", "event_name", "keyset", before))
    first = sets.groupBy("project_id", "event_name").agg(F.min("at").alias("at"))
    # A rank with a limit: each task passes on at most MAX_NAMES names of a project.
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("at", "event_name"))
    names = first.withColumn("name_place", place).where(F.col("name_place") <= MAX_NAMES)
    full = names.where(F.col("name_place") == MAX_NAMES).select("project_id", F.col("at").alias("names_full"))
    names = names.select("project_id", "event_name", "name_place")
    keys = sets.select("project_id", "event_name", F.explode("keyset").alias("key")).distinct()
    crowded = keys.groupBy("project_id", "event_name").agg(F.count("*").alias("n")).where(F.col("n") > MAX_KEYS).select("project_id", "event_name")
    open_ = sets.join(crowded, ["project_id", "event_name"], "left_semi").select("project_id", "event_name", "keyset", "at.received_at", "at.event_id")
    late = open_.groupBy("project_id", "event_name").applyInPandas(_admit, "project_id long, event_name string, keyset array<string>").withColumn("late", F.lit(True))
    rows = parsed.withColumn("keyset", F.array_sort("keys")).join(names, ["project_id", "event_name"], "left").join(full, "project_id", "left").join(late, ["project_id", "event_name", "keyset"], "left")
    limit = (
        F.when(F.col("problem").isNotNull() | F.col("bot"), F.lit(None))
        .when(F.col("n_properties") > MAX_PROPERTIES, "too_many_properties")
        .when(F.col("name_place").isNull(), "event_name_cardinality")
        .when(F.col("late"), "property_key_cardinality")
    )
    return rows.withColumn("limit", limit).drop("name_place", "late", "keyset")


@dataclass(frozen=True)
class Ingested:
    """What became of requests: all rows with ``outcome``, new events, rejected ones, bindings, and requests to projects that take none."""

    rows: DataFrame
    events: DataFrame
    dead_letter: DataFrame
    bindings: DataFrame
    refused: DataFrame | None = field(default=None)


def _decide(parsed: DataFrame, persisted: DataFrame | None, known: DataFrame | None) -> DataFrame:
    """``parsed`` requests of one month with ``outcome``; a column monthly_event_quota bounds what is accepted."""
    rows = limited(parsed, known)
    outcome = F.when(F.col("problem").isNotNull(), "rejected").when(F.col("bot"), "bot").when(F.col("limit").isNotNull(), "throttled").otherwise("accepted")
    rows = rows.withColumn("outcome", outcome)
    if "monthly_event_quota" not in parsed.columns:
        return rows.drop("names_full")
    bound = (F.col("outcome") == "accepted") & F.col("monthly_event_quota").isNotNull()
    ranked = _rank(rows.where(bound), ["project_id"], "_place")
    if persisted is not None:
        ranked = ranked.join(persisted.groupBy("project_id").agg(F.sum("accepted").alias("_had")), "project_id", "left")
    had = F.coalesce("_had", F.lit(0)) if persisted is not None else F.lit(0)
    over = had + F.col("_place") - 1 >= F.col("monthly_event_quota")
    ranked = ranked.withColumn("outcome", F.when(over, "over_quota").otherwise("accepted")).drop("_place", "_had")
    # Only accepted events are observed: a name that first arrives after the last of them takes no place,
    # so where the places weren't full by then, events beyond them are over the quota instead.
    at = F.struct("received_at", "event_id")
    last = F.coalesce(F.max(F.when(F.col("outcome") == "accepted", at)), F.struct(F.timestamp_millis(F.lit(0)).alias("received_at"), F.lit("").alias("event_id")))
    reached = ranked.groupBy("project_id").agg(last.alias("_last"), F.count_if(F.col("outcome") == "over_quota").alias("_over")).where("_over > 0").select("project_id", "_last")
    rest = rows.where(~bound).join(reached, "project_id", "left")
    late = F.coalesce((F.col("limit") == "event_name_cardinality") & (F.col("names_full") > F.col("_last")), F.lit(False))
    rest = rest.withColumn("outcome", F.when(late, "over_quota").otherwise(F.col("outcome"))).withColumn("limit", F.when(~late, F.col("limit"))).drop("_last")
    return rest.unionByName(ranked).drop("monthly_event_quota", "names_full")


def ingest(raw: DataFrame, projects: DataFrame | None = None, persisted: DataFrame | None = None, known: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> Ingested:
    """Decides every request of ``raw``.

    ``projects`` (project_id, monthly_event_quota, state) bounds what a project
    may store in a month (of receipt) beyond ``persisted`` (project_id,
    accepted, and month if there are several); a null quota is no bound.
    Requests to projects that aren't active, or are none, become ``refused``
    (project_id, received_at, reason). ``known`` is the event schema observed
    before, which limits of names and keys count; names are observed of
    accepted events only, months in their order. ``keep`` stores what it is
    given and returns it again: the parsed requests, which are read several
    times.
    """
    parsed, refused = parse(raw), None
    if keep is not None:
        parsed = keep(parsed)
    if projects is None:
        rows = _decide(parsed, None, known)
    else:
        states = projects.select("project_id", "monthly_event_quota", F.coalesce("state", F.lit("active")).alias("_state"))
        parsed = parsed.join(states, "project_id", "left")
        active = F.coalesce(F.col("_state") == "active", F.lit(False))
        reason = F.when(F.col("_state") == "deleting", "project_deleted").when(F.col("_state") == "archived", "project_archived").otherwise("unknown_project")
        refused = parsed.where(~active).select("project_id", "received_at", reason.alias("reason"))
        parsed = parsed.where(active).drop("_state")
        month = F.trunc("received_at", "month")
        months = [r[0] for r in parsed.select(month.alias("m")).distinct().orderBy("m").collect()]  # as many as requests wait for
        rows = None
        for m in months or [None]:
            mine = month.eqNullSafe(F.lit(m).cast("date"))
            had = persisted.where(F.col("month").eqNullSafe(F.lit(m).cast("date"))) if persisted is not None and "month" in persisted.columns else persisted
            some = _decide(parsed.where(mine) if len(months) > 1 else parsed, had, known)
            if m != (months or [None])[-1]:
                some = keep(some) if keep is not None else some
                new = some.where("outcome = 'accepted'").select("project_id", "event_name", F.explode_outer("keys").alias("property_key")).distinct()
                new = new.withColumn("property_key", F.coalesce("property_key", F.lit("")))
                known = new if known is None else known.select(*new.columns).unionByName(new)
            rows = some if rows is None else rows.unionByName(some)
    return outputs(rows, refused)


def outputs(rows: DataFrame, refused: DataFrame | None = None) -> Ingested:
    """What decided requests become."""
    accepted = rows.where("outcome = 'accepted'")
    reason = F.coalesce("limit", F.lit("validation_failed"))
    detail = F.coalesce("problem", F.concat_ws(" ", F.lit("beyond a limit:"), "limit", "event_name"))
    dead = rows.where("outcome IN ('rejected', 'throttled')").select("project_id", "received_at", reason.alias("reason"), F.substring(detail, 1, DETAIL).alias("detail"), F.substring("body", 1, PAYLOAD).alias("payload"))
    named = accepted.where("kind = 'identify' AND anonymous_id <> ''")
    bindings = named.select("project_id", "anonymous_id", F.col("user_id").alias("person_id"), F.col("timestamp").alias("bound_at"))
    return Ingested(rows, accepted.select(*EVENTS.names), dead.select(*DEAD_LETTER.names), bindings, refused)


def counters(rows: DataFrame) -> DataFrame:
    """project_id, month and a count of each outcome."""
    by_month = rows.groupBy("project_id", F.trunc("received_at", "month").alias("month"))
    return by_month.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def merge_counters(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("project_id", "month").agg(*[F.sum(o).alias(o) for o in OUTCOMES])


def usage(counted: DataFrame, projects: DataFrame, month) -> DataFrame:
    """project_id, quota and the counts of one month, zeros where there are none."""
    mine = counted.where(F.col("month") == F.lit(month)).drop("month")
    return projects.select("project_id", "monthly_event_quota").join(mine, "project_id", "left").select("project_id", "monthly_event_quota", *[F.coalesce(o, F.lit(0)).alias(o) for o in OUTCOMES])
