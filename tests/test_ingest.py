import json
from datetime import datetime, timedelta

import pytest
from conftest import at
from pyspark.sql import functions as F

from footfall.functions import enrich
from footfall.schema import PROJECTS
from footfall.sources import ingest
from footfall.sources.shared import stored

AGENT = "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0"


def uuid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


@pytest.fixture
def send(spark):
    def run(*bodies, agent=AGENT, **more):
        rows = []
        for n, b in enumerate(bodies):
            own, body = (b if isinstance(b, tuple) else (agent, b))
            rows.append((1, datetime(2026, 8, 1, 12) + timedelta(seconds=n), own, body if isinstance(body, str) else json.dumps({"message_id": uuid(n), "type": "track", "event": "x", "anonymous_id": "d", **body})))
        return ingest.ingest(ingest.unbatch(spark.createDataFrame(rows, ingest.RAW)), **({"keep": stored} | more))

    return run


def outcomes(done):
    return [r.outcome for r in done.rows.orderBy("received_at").collect()]


BAD = [
    ("{oops", "not JSON"), ({"type": "nope"}, "type"), ({"message_id": "7"}, "message_id"), ({"anonymous_id": None}, "anonymous_id"), ({"anonymous_id": ""}, "anonymous_id"), ({"event": "x" * 129}, "event"), ({"event": 5}, "event"),
    ({"type": "identify"}, "user_id"), ({"properties": [1]}, "properties"), ({"properties": {"a": {"b": 1}}}, "properties"), ({"context": {"url": "x" * 2049}}, "context.url"), ({"context": 7}, "context"), ({"timestamp": 5}, "timestamp"),
]


def test_bad_payloads(send):
    done = send(*[b for b, _ in BAD])
    assert set(outcomes(done)) == {"rejected"}
    details = [r.problem for r in done.rows.orderBy("received_at").collect()]
    assert all(d.startswith(want) for d, (_, want) in zip(details, BAD, strict=True)), details
    assert done.dead_letter.count() == len(BAD) and done.events.count() == 0


def test_rows(send):
    done = send(
        {"properties": {"s": "x", "n": 2.5, "b": True, "z": None, "$r": 1, "": "e", "k" * 130: "long"}, "timestamp": "2026-08-01T11:00:00.123456Z", "context": {"utm_source": "g", "library": "junk"}},
        {"type": "page", "name": "Home", "event": None},
        {"type": "identify", "user_id": "u", "traits": {"plan": "pro", "seats": 3}, "timestamp": "2020-01-01"},
        {"timestamp": "never"},
    )
    a, b, c, d = done.events.orderBy("received_at").collect()
    assert a.properties == {"s": "x", "b": "true", "k" * 128: "long"} and a.properties_num == {"n": 2.5} and a.utm_source == "g"
    assert a.timestamp == datetime(2026, 8, 1, 11, 0, 0, 123000) and (a.os, a.browser, a.device_type) == ("windows", "chrome", "desktop")
    assert (b.event_name, b.properties) == ("$page", {"$page_name": "Home"})
    assert (c.event_name, c.properties_num, c.timestamp) == ("$identify", {"seats": 3.0}, datetime(2026, 7, 31, 12, 0, 2))
    assert d.timestamp == d.received_at
    assert [(r.anonymous_id, r.person_id) for r in done.bindings.collect()] == [("d", "u")]


def test_bots_and_server_libraries(send):
    server = {"name": "footfall-python", "version": "1"}
    done = send(
        ("curl/8", {}), (None, {}), ("python-requests/2", {"context": {"library": server}}), ("x", {"context": {"library": server, "user_agent": "Googlebot/2.1"}}),
        ("curl/8", {"context": {"library": {"name": "footfall-python"}}}), (AGENT, {"context": {"user_agent": "Googlebot/2.1"}}),
    )
    assert outcomes(done) == ["bot", "bot", "accepted", "bot", "bot", "accepted"]


def test_batches(send):
    done = send(json.dumps({"batch": [{"message_id": uuid(1), "type": "track", "event": "a", "user_id": "u"}, {"bad": 1}]}), '{"batch": []}', json.dumps({"batch": [{}] * 501}))
    assert sorted(outcomes(done)) == ["accepted", "rejected", "rejected", "rejected"]


def test_limits(send):
    done = send(*[{"event": f"e{i:04d}"} for i in range(1003)])
    assert outcomes(done).count("throttled") == 3
    many = send({"properties": {str(i): i for i in range(251)}}, *[{"properties": {f"{j}-{i}": i for i in range(200)}} for j in range(3)], {"properties": {"0-0": 1}}, {"properties": {f"2-{i}": i for i in range(101)}}, {"properties": {f"2-{i}": i for i in range(100)}}, {"properties": {"2-150": 1}})
    assert outcomes(many) == ["throttled", "accepted", "accepted", "throttled", "accepted", "throttled", "accepted", "throttled"]
    assert {r.reason for r in many.dead_letter.collect()} == {"too_many_properties", "property_key_cardinality"}


def test_quota_counters_and_usage(spark, send):
    projects = spark.createDataFrame([(1, "one", 13, 5, "active")], PROJECTS)
    had = spark.createDataFrame([(1, 2)], "project_id long, accepted long")
    done = send(*[{} for _ in range(5)], "{bad", projects=projects, persisted=had)
    assert outcomes(done) == ["accepted"] * 3 + ["over_quota"] * 2 + ["rejected"]
    assert done.dead_letter.count() == 1
    counted = ingest.counters(done.rows)
    assert tuple(counted.first())[2:] == (3, 1, 0, 2, 0)
    merged = ingest.merge_counters(counted, counted)
    used = ingest.usage(merged, projects, datetime(2026, 8, 1).date()).first()
    assert (used.monthly_event_quota, used.accepted, used.over_quota) == (5, 6, 4)
    archived = spark.createDataFrame([(1, "one", 13, None, "archived")], PROJECTS)
    assert send({}, projects=archived).rows.count() == 0


def test_a_quota_holds_for_each_month_and_project(spark):
    rows = [(p, datetime(2026, 1 + m, 31 if m == 0 else 1, 12, n), AGENT, json.dumps({"message_id": uuid(100 * p + 10 * m + n), "type": "track", "event": "x", "anonymous_id": "d"})) for p in (1, 2, 3, 4, 5) for m in (0, 1) for n in range(5)]
    projects = spark.createDataFrame([(1, "a", 13, 5, "active"), (2, "b", 13, 3, "active"), (3, "c", 13, None, "archived"), (4, "d", 13, None, "deleting")], PROJECTS)
    had = spark.createDataFrame([(2, datetime(2026, 2, 1).date(), 2)], "project_id long, month date, accepted long")
    done = ingest.ingest(spark.createDataFrame(rows, ingest.RAW), projects, had, keep=stored)
    got = {(r.project_id, r.month.month): (r.accepted, r.over_quota) for r in ingest.counters(done.rows).collect()}
    assert got == {(1, 1): (5, 0), (1, 2): (5, 0), (2, 1): (3, 2), (2, 2): (1, 4)}
    assert sorted({(r.project_id, r.reason) for r in done.refused.collect()}) == [(3, "project_archived"), (4, "project_deleted"), (5, "unknown_project")] and done.refused.count() == 30


def test_only_accepted_events_take_a_name_s_place(spark, send, monkeypatch):
    monkeypatch.setattr(ingest, "MAX_NAMES", 10)
    names = [{"event": f"e{i:03d}"} for i in range(30)]
    project = lambda quota: spark.createDataFrame([(1, "one", 13, quota, "active")], PROJECTS)
    assert outcomes(send(*names, projects=project(5))) == ["accepted"] * 5 + ["over_quota"] * 25
    assert outcomes(send(*names, projects=project(20))) == ["accepted"] * 10 + ["throttled"] * 20
    again = [*names, *[{"event": "e000"}] * 3, {"event": "new"}]
    assert outcomes(send(*again, projects=project(12))) == ["accepted"] * 10 + ["throttled"] * 20 + ["accepted"] * 2 + ["over_quota", "throttled"]
    done = send(*names, projects=project(5))
    assert done.dead_letter.count() == 0 and done.rows.where("limit IS NOT NULL").count() == 0


def test_empty_input(spark):
    done = ingest.ingest(spark.createDataFrame([], ingest.RAW))
    assert done.events.count() == done.dead_letter.count() == done.bindings.count() == 0


AGENTS = [
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Mobile/15E148 Safari/604.1", "mobile", "ios", "safari"),
    ("Mozilla/5.0 (iPad; CPU OS 17_0) Safari/604.1", "tablet", "ios", "safari"),
    ("Mozilla/5.0 (Linux; Android 14; Pixel) Chrome/120.0 Mobile Safari/537.36", "mobile", "android", "chrome"),
    ("Mozilla/5.0 (Linux; Android 14; Tab) SamsungBrowser/23.0 Chrome/115.0 Safari/537.36", "tablet", "android", "samsung"),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/120.0 Safari/537.36 Edg/120.0", "desktop", "windows", "edge"),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 14_0) Firefox/121.0", "desktop", "macos", "firefox"),
    ("something else", "unknown", "unknown", "unknown"), ("", "unknown", "unknown", "unknown"), (None, "unknown", "unknown", "unknown"),
]


def test_user_agents(spark):
    rows = spark.createDataFrame([(i, a[0]) for i, a in enumerate(AGENTS)], "i int, ua string")
    found = rows.select("i", enrich.device_type(F.col("ua")), enrich.system(F.col("ua")), enrich.browser(F.col("ua"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in found] == [a[1:] for a in AGENTS]


def test_demo_is_the_same_at_any_number_of_partitions(spark):
    from footfall.sources import demo

    rows, bindings = demo.generate(spark, at("08-01 00:00"), 50, 600)
    one = sorted(map(str, rows.collect()))
    again, _ = demo.generate(spark, at("08-01 00:00"), 50, 600)
    assert one == sorted(map(str, again.repartition(7).collect())) and len({r.event_id for r in rows.collect()}) == len(one)
    assert 0 < bindings.count() <= 50 and rows.where("timestamp > received_at").count() == 0
    with pytest.raises(ValueError):
        demo.generate(spark, at("08-01 00:00"), 0)
