"""Named queries over a folder of test tables, one or more for each kind of operator.

Instants come out as milliseconds, maps as text, sums rounded, so that any
engine gives the same values; ``oracle`` has the SQL that does.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.maps import rendered
from .operators import dedup, identity, rollups, suppress
from .plans import catalog, events, funnels, lifecycle, person, segments
from .plans.ast import parse_funnel, parse_node
from .schema import CONTEXT_FIELDS, LATEST_FIELDS, PROJECTS, SUPPRESSED, Tables
from .sources import demo, ingest
from .sources.fixtures import NOW, canonical_events, load
from .sources.shared import stored

MID = datetime(2024, 1, 16, tzinfo=UTC)

SEGMENT = {"kind": "group", "op": "and", "children": [
    {"kind": "behavior", "event": "click", "aggregate": "count", "window": {"kind": "last", "n": 20, "unit": "days"}, "operator": ">=", "value": 3},
    {"kind": "not", "child": {"kind": "behavior", "event": "error", "where": [{"property": "kind", "operator": "=", "value": "k3"}], "aggregate": "count", "window": {"kind": "ever"}, "operator": ">=", "value": 1}},
]}
RICH = {"kind": "group", "op": "or", "children": [
    {"kind": "group", "op": "and", "children": [
        {"kind": "trait", "key": "plan", "operator": "=", "value": "pro"},
        {"kind": "context", "field": "os", "scope": "latest", "operator": "!=", "value": "ios"},
        {"kind": "lifecycle", "field": "last_seen", "operator": ">=", "value": "2024-01-20"},
        {"kind": "behavior", "event": "*", "where": [{"source": "attribute", "attribute": "country", "operator": "between", "value": ["DE", "JP"]}], "aggregate": "count", "window": {"kind": "absolute", "from": "2024-01-05", "to": "2024-01-25"}, "operator": ">", "value": 4}]},
    {"kind": "not", "child": {"kind": "trait", "key": "seats", "operator": "<", "value": 60}},
    {"kind": "behavior", "event": "purchase", "aggregate": "sum", "property": "value", "window": {"kind": "ever"}, "operator": "between", "value": [200, 400]},
]}
BEHAVIORS = [
    {"event": "click", "aggregate": "count", "window": {"kind": "last", "n": 10, "unit": "days"}},
    {"event": "purchase", "aggregate": "sum", "property": "value", "window": {"kind": "ever"}},
    {"event": "view", "aggregate": "min", "property": "k", "window": {"kind": "ever"}},
    {"event": "*", "aggregate": "max", "property": "k", "window": {"kind": "absolute", "from": "2024-01-05", "to": "2024-01-20"}},
    {"event": "*", "aggregate": "distinct", "property": "kind", "window": {"kind": "ever"}},
    {"event": "click", "aggregate": "count", "where": [{"property": "value", "operator": "<", "value": 20}, {"source": "attribute", "attribute": "path", "operator": "!=", "value": "/docs"}], "window": {"kind": "ever"}},
]
FUNNEL = {"steps": [{"event": "view"}, {"event": "click"}, {"event": "purchase"}], "window_seconds": 259_200}
AUDIENCE = {"kind": "behavior", "event": "signup", "aggregate": "count", "window": {"kind": "ever"}, "operator": ">=", "value": 1}
RICH_FUNNEL = {"steps": [{"event": "view", "where": [{"property": "kind", "operator": "!=", "value": "k1"}]}, {"event": "click", "audience": AUDIENCE}, {"event": "click"}], "window_seconds": 172_800}


def ms(column: str | Column) -> Column:
    return F.unix_millis(F.col(column) if isinstance(column, str) else column)


def _rounded(column: str) -> Column:
    return F.round(F.col(column), 6).alias(column)


def _t(spark: SparkSession, d: str) -> Tables:
    return load(spark, d)


def canonical(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d).events
    cols = ["event_id", "anonymous_id", "user_id", "event_name", "url", "path", "referrer", "utm_source", "utm_medium", "utm_campaign", "device_type", "os", "browser", "country"]
    nums = F.transform_values("properties_num", lambda _, v: F.round(v, 4))
    return t.select(*cols, ms("timestamp").alias("timestamp"), ms("received_at").alias("received_at"), rendered(F.col("properties")).alias("properties"), F.size(nums).cast("long").alias("n_numbers"))


def dedup_events(spark: SparkSession, d: str) -> DataFrame:
    kept = dedup.first_by_event_id(_t(spark, d).events)
    return kept.groupBy("event_name").agg(F.count("*").alias("events"), F.sum(ms("timestamp") % 100_003).alias("checksum"))


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicates(_t(spark, d).events).select("event_id", "copies")


def storage_dedup(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d).events
    later = t.withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 1 HOUR"))
    return dedup.compact(t.unionByName(later)).groupBy("event_name").agg(F.count("*").alias("events"), F.max(ms("received_at")).alias("latest"))


def identity_tiles(spark: SparkSession, d: str) -> DataFrame:
    return identity.tiles(_t(spark, d).bindings).select("anonymous_id", "person_id", ms("valid_from").alias("valid_from"), ms("valid_to").alias("valid_to"))


def identity_exact_tiles(spark: SparkSession, d: str) -> DataFrame:
    return identity.exact_tiles(_t(spark, d).bindings).select("anonymous_id", "person_id", ms("valid_from").alias("valid_from"), ms("valid_to").alias("valid_to"))


def identity_coalesced(spark: SparkSession, d: str) -> DataFrame:
    return identity.coalesce_tiles(identity.exact_tiles(_t(spark, d).bindings)).select("anonymous_id", "person_id", ms("valid_from").alias("valid_from"), ms("valid_to").alias("valid_to"))


def identity_resolve(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    rows = identity.resolve(t.events, t.bindings, t.aliases)
    return rows.groupBy("person_id").agg(F.count("*").alias("events"), F.min(ms("timestamp")).alias("first_ms"), F.max(ms("timestamp")).alias("last_ms"))


def identity_bind(spark: SparkSession, d: str) -> DataFrame:
    """Binding writes at whole hours, so that many meet at one instant."""
    t = _t(spark, d).events.where("user_id <> ''")
    rows = t.select("project_id", "anonymous_id", F.col("user_id").alias("person_id"), F.date_trunc("hour", "timestamp").alias("bound_at"))
    return identity.bind(rows).select("anonymous_id", "person_id", ms("bound_at").alias("bound_at"))


def suppression(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return segments.resolved_events(t, t.events).groupBy("person_id").agg(F.count("*").alias("events"), F.min(ms("timestamp")).alias("first_ms"))


def suppression_upsert(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    users = t.events.where("user_id <> ''").select("project_id", F.col("user_id").alias("person_id")).distinct()
    n = F.substring("person_id", 6, 20).cast("long")
    new = users.where(n % 5 == 0).select("project_id", "person_id", F.timestamp_millis(F.lit(1_705_000_000_000) + n * 86_400_000).alias("suppressed_at")).select(*SUPPRESSED.names)
    return suppress.upsert(t.suppressed, new).select("person_id", ms("suppressed_at").alias("suppressed_at"))


def rollup_device_index(spark: SparkSession, d: str) -> DataFrame:
    """The rollup of all events, merged from that of two halves."""
    t = _t(spark, d).events
    odd = F.pmod(F.crc32("event_id"), F.lit(2)) == 1
    merged = rollups.merge_device_index(rollups.device_index(t.where(odd)), rollups.device_index(t.where(~odd)))
    return merged.select("anonymous_id", "user_id", "month", ms("first_seen").alias("first_seen"), ms("last_seen").alias("last_seen"), "event_count", F.col("latest.country").alias("latest_country"), F.col("latest.browser").alias("latest_browser"), F.col("first.country").alias("first_country"), F.col("first.utm_source").alias("first_utm_source"))


def rollup_person_traits(spark: SparkSession, d: str) -> DataFrame:
    rows = rollups.person_traits(_t(spark, d).events)
    return rows.select("anonymous_id", "user_id", "trait_key", "value_str", "value_num", F.col("has_num").cast("long").alias("has_num"), ms("updated_at").alias("updated_at"))


def rollup_event_schema(spark: SparkSession, d: str) -> DataFrame:
    return rollups.event_schema(_t(spark, d).events).select("event_name", "property_key", "value_kind", ms("last_seen").alias("last_seen"))


def segment_base(spark: SparkSession, d: str) -> DataFrame:
    rows = segments.base(_t(spark, d))
    return rows.select("person_id", ms("first_seen").alias("first_seen"), ms("last_seen").alias("last_seen"), *[f"latest_{c}" for c in LATEST_FIELDS], *[f"first_{c}" for c in CONTEXT_FIELDS])


def segment_traits(spark: SparkSession, d: str) -> DataFrame:
    return segments.traits(_t(spark, d)).select("person_id", rendered(F.col("traits")).alias("traits"), rendered(F.col("traits_num")).alias("traits_num"))


def _behavior(d: dict) -> dict:
    return {"kind": "behavior", "operator": ">=", "value": 0, **d}


def behavior_pass(spark: SparkSession, d: str) -> DataFrame:
    """Six behaviours in one pass: counts, sums, least, most and distinct values, with conditions."""
    rows, alias = segments.behavior_pass(_t(spark, d), [parse_node(_behavior(b)) for b in BEHAVIORS])
    return rows.select("person_id", *[_rounded(a) for a in alias.values()])


def segment_count(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: people with three clicks in 20 days and never a certain error."""
    return segments.count(_t(spark, d), parse_node(SEGMENT))


def segment_count_rich(spark: SparkSession, d: str) -> DataFrame:
    return segments.count(_t(spark, d), parse_node(RICH))


def segment_persons(spark: SparkSession, d: str) -> DataFrame:
    return segments.persons(_t(spark, d), parse_node(RICH)).select("person_id")


def segment_members(spark: SparkSession, d: str) -> DataFrame:
    """A page of members after a cursor."""
    rows = segments.members(_t(spark, d), parse_node(RICH), after=(datetime(2024, 1, 29, 12, tzinfo=UTC), "dev-0"), limit=50)
    return rows.select("person_id", ms("first_seen").alias("first_seen"), ms("last_seen").alias("last_seen"), *CONTEXT_FIELDS, rendered(F.col("traits")).alias("traits"), rendered(F.col("traits_num")).alias("traits_num"), "trait_total")


def _span() -> funnels.Range:
    return funnels.Range(datetime(2024, 1, 2, tzinfo=UTC), datetime(2024, 1, 28, tzinfo=UTC))


def funnel_levels(spark: SparkSession, d: str) -> DataFrame:
    found = funnels.levels(_t(spark, d), parse_funnel(FUNNEL), _span())
    return found.select("person_id", F.col("level").cast("long").alias("level"), ms("entered_at").alias("entered_at"), "partial")


def funnel_folded(spark: SparkSession, d: str) -> DataFrame:
    found = funnels.levels(_t(spark, d), parse_funnel(FUNNEL), _span(), folded=True)
    return found.select("person_id", F.col("level").cast("long").alias("level"), ms("entered_at").alias("entered_at"), "partial")


def funnel_histogram(spark: SparkSession, d: str) -> DataFrame:
    return funnels.histogram(funnels.levels(_t(spark, d), parse_funnel(FUNNEL), _span())).withColumn("level", F.col("level").cast("long"))


def funnel_report(spark: SparkSession, d: str) -> DataFrame:
    out = funnels.report(funnels.levels(_t(spark, d), parse_funnel(FUNNEL), _span()), 3)
    return out.select("step", "people", _rounded("from_previous"), _rounded("from_start"))


def funnel_audience(spark: SparkSession, d: str) -> DataFrame:
    """A funnel with a condition, an audience on its second step, and a segment."""
    segment = parse_node({"kind": "lifecycle", "field": "first_seen", "operator": "<", "value": "2024-01-03"})
    found = funnels.levels(_t(spark, d), parse_funnel(RICH_FUNNEL), _span(), segment)
    return found.select("person_id", F.col("level").cast("long").alias("level"), ms("entered_at").alias("entered_at"), "partial")


def funnel_people(spark: SparkSession, d: str) -> DataFrame:
    rows = funnels.people(_t(spark, d), parse_funnel(FUNNEL), _span(), 2, "reached", after=(datetime(2024, 1, 3, tzinfo=UTC), ""), limit=40)
    return rows.select("person_id", ms("entered_at").alias("entered_at"))


def funnel_dropped(spark: SparkSession, d: str) -> DataFrame:
    return funnels.people_count(_t(spark, d), parse_funnel(FUNNEL), _span(), 2, "dropped")


def funnel_members(spark: SparkSession, d: str) -> DataFrame:
    rows = funnels.people_members(_t(spark, d), parse_funnel(FUNNEL), _span(), 3)
    return rows.select("person_id", ms("entered_at").alias("entered_at"), ms("last_seen").alias("last_seen"), "os", "utm_source", rendered(F.col("traits")).alias("traits"))


def feed_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = events.feed(_t(spark, d), since=NOW - timedelta(days=3), limit=100)
    return rows.select("event_id", ms("timestamp").alias("timestamp"), "event_name", "anonymous_id", "user_id", rendered(F.col("properties")).alias("properties"), "country", "path")


def feed_cursor(spark: SparkSession, d: str) -> DataFrame:
    cursor = events.decode_cursor(events.encode_cursor("2024-01-10T00:00:00+00:00", "00000000-0000-4000-8000-000000000500"))
    rows = events.feed(_t(spark, d), event="click", until=MID, cursor=cursor, limit=70)
    return rows.select("event_id", ms("timestamp").alias("timestamp"), "anonymous_id", "user_id")


def feed_person(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    rows = events.feed(t, since=datetime(2024, 1, 1, tzinfo=UTC), person=person.scope(t, "user-10"), limit=200)
    return rows.select("event_id", ms("timestamp").alias("timestamp"), "event_name")


def stats_daily(spark: SparkSession, d: str) -> DataFrame:
    rows = events.stats(_t(spark, d), "1d", datetime(2024, 1, 2, tzinfo=UTC), datetime(2024, 1, 25, tzinfo=UTC), by_event=True)
    return rows.select(ms("bucket").alias("bucket"), "event_name", "events")


def stats_hourly(spark: SparkSession, d: str) -> DataFrame:
    return events.stats(_t(spark, d), "1h", MID, MID + timedelta(days=4)).select(ms("bucket").alias("bucket"), "events")


def stats_filled(spark: SparkSession, d: str) -> DataFrame:
    since, until = MID + timedelta(minutes=30, seconds=20), MID + timedelta(hours=4)
    counted = events.stats(_t(spark, d), "1m", since, until)
    return events.filled(counted, "1m", since, until).select(ms("bucket").alias("bucket"), "events")


def stats_peak(spark: SparkSession, d: str) -> DataFrame:
    return events.peak(events.stats(_t(spark, d), "1h", MID, MID + timedelta(days=4)))


def event_totals(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    names = catalog.event_names(rollups.event_schema(t.events), 1, limit=100)
    return events.event_totals(t, names, MID, MID + timedelta(minutes=45))


def catalog_events(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.event_names(rollups.event_schema(_t(spark, d).events), 1)
    return rows.select("event_name", ms("last_seen").alias("last_seen"))


def catalog_properties(spark: SparkSession, d: str) -> DataFrame:
    return catalog.properties(rollups.event_schema(_t(spark, d).events), 1, prefix="k")


def catalog_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of properties; the texts of one are also seen as numbers."""
    t = _t(spark, d)
    both = t.events.withColumn("properties_num", F.when(F.col("event_name") == "error", F.map_concat("properties_num", F.create_map(F.lit("kind"), F.lit(1.0)))).otherwise(F.col("properties_num")))
    return catalog.property_kinds(catalog.properties(rollups.event_schema(both), 1))


def catalog_traits(spark: SparkSession, d: str) -> DataFrame:
    return catalog.trait_values(rollups.person_traits(_t(spark, d).events), 1, "plan", "p")


def person_summary(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return person.summary(t, person.scope(t, "user-10")).select(ms("first_seen").alias("first_seen"), ms("last_seen").alias("last_seen"), "events")


def person_export_events(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return person.export_events(t, person.scope(t, "user-9")).select("event_id", ms("timestamp").alias("timestamp"))


def person_export_traits(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return person.export_traits(t, person.scope(t, "user-9")).select("trait_key", "value_str", "value_num", F.col("has_num").cast("long").alias("has_num"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Events as raw requests with their numbers, dealt to several tasks; some are bots, some lack ids or are too long."""
    t = canonical_events(spark, d, "number").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "number")
    e = F.col("number")
    body = F.to_json(F.struct(
        F.lit("track").alias("type"), F.col("event_id").alias("message_id"), F.when(e % 13 != 0, F.col("anonymous_id")).alias("anonymous_id"),
        F.when(F.col("user_id") != "", F.col("user_id")).alias("user_id"), F.when(e % 17 == 0, F.lpad("event_name", 129, "x")).otherwise(F.col("event_name")).alias("event"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.col("properties_num").alias("properties"),
    ))
    agent = F.when(e % 7 == 0, "Mozilla/5.0 (compatible; Somebot/2.1)").when(e % 7 == 1, "Mozilla/5.0 (iPad; CPU OS 17) Safari/604.1").otherwise("Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Edg/120.0")
    return t.select("project_id", F.col("timestamp").alias("received_at"), agent.alias("user_agent"), body.alias("body"), "number")


def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest(_requests(spark, d), keep=stored).rows.groupBy("outcome").agg(F.count("*").alias("n"))


def ingest_events(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.ingest(_requests(spark, d), keep=stored).events
    return rows.groupBy("event_name", "device_type", "os", "browser").agg(F.count("*").alias("n"), F.sum(ms("timestamp") % 100_003).alias("checksum"), F.sum(F.size("properties_num")).alias("numbers"))


def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counts of two projects by month under monthly quotas, of requests to two months; a third project takes none."""
    projects = spark.createDataFrame([(1, "one", 13, 300, "active"), (2, "two", 13, 100, "active"), (3, "three", 13, None, "archived")], PROJECTS)
    e = F.col("number")
    later = F.when(e % 4 == 0, F.col("received_at") + F.expr("INTERVAL 31 DAYS")).otherwise(F.col("received_at"))
    raw = _requests(spark, d).withColumns({"project_id": 1 + e % 3, "received_at": later})
    counted = ingest.counters(ingest.ingest(raw, projects, keep=stored).rows)
    return counted.select("project_id", F.date_format("month", "yyyy-MM").alias("month"), *ingest.OUTCOMES)


def ingest_rejections(spark: SparkSession, d: str) -> DataFrame:
    dead = ingest.ingest(_requests(spark, d), keep=stored).dead_letter
    return events.rejections(dead, 1, reason="validation_failed", limit=40, offset=20).select(ms("received_at").alias("received_at"), "reason", "detail")


def retention_dry_run(spark: SparkSession, d: str) -> DataFrame:
    projects = spark.createDataFrame([(1, "one", 1, None, "active")], PROJECTS)
    return lifecycle.expired_months(_t(spark, d).events, projects, datetime(2024, 3, 10, tzinfo=UTC)).select(F.col("month").cast("long").alias("month"), "events")


def stale_names(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d).events
    return lifecycle.stale_names(rollups.event_schema(t), t.where("event_name NOT IN ('error', 'signup')")).select("event_name", "property_key", "value_kind")


def purge_person(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table left after the erasure of a person."""
    t = _t(spark, d)
    request, hidden = lifecycle.request_deletion(t, "user-10", "r1")
    dead = spark.createDataFrame([(1, NOW, "validation_failed", "type", '{"user_id":"user-10"}'), (1, NOW, "validation_failed", "type", '{"user_id":"user-100"}')], "project_id long, received_at timestamp, reason string, detail string, payload string")
    left = lifecycle.purge(t.at(suppressed=hidden), request, rollups.device_index(t.events), rollups.person_traits(t.events), dead, rollups.event_schema(t.events))
    parts = {"events": left.events, "device_index": left.device_index, "person_traits": left.person_traits, "dead_letter": left.dead_letter, "bindings": left.bindings, "event_schema": left.event_schema, "suppressed": hidden}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def demo_funnel(spark: SparkSession, d: str) -> DataFrame:
    """People of a made-up cohort by how far they got."""
    from .schema import tables

    rows, bindings = demo.generate(spark, NOW, persons=300, events=3000)
    t = tables(spark, rows, NOW, bindings)
    funnel = parse_funnel({"steps": [{"event": n} for n, _ in demo.FUNNEL], "window_seconds": 86_400})
    found = funnels.levels(t, funnel, funnels.Range(NOW - timedelta(days=90), NOW))
    return funnels.histogram(found)


QUERIES = {
    f.__name__: f
    for f in (
        segment_count, segment_count_rich, segment_persons, segment_members, segment_base, segment_traits, behavior_pass,
        funnel_levels, funnel_folded, funnel_histogram, funnel_report, funnel_audience, funnel_people, funnel_dropped, funnel_members,
        canonical, dedup_events, duplicates, storage_dedup, identity_tiles, identity_exact_tiles, identity_coalesced, identity_resolve, identity_bind,
        suppression, suppression_upsert, rollup_device_index, rollup_person_traits, rollup_event_schema,
        feed_latest, feed_cursor, feed_person, stats_daily, stats_hourly, stats_filled, stats_peak, event_totals,
        catalog_events, catalog_properties, catalog_kinds, catalog_traits, person_summary, person_export_events, person_export_traits,
        ingest_outcomes, ingest_events, ingest_counters, ingest_rejections, retention_dry_run, stale_names, purge_person, demo_funnel,
    )
}
