import re
from datetime import UTC, datetime, timedelta, timezone

import pytest
from conftest import at

from footfall.functions.time import parse_bound, parse_since, retention_boundary
from footfall.operators import rollups
from footfall.plans import events, funnels, lifecycle
from footfall.plans.ast import parse_funnel
from footfall.schema import PROJECTS
from footfall.sources.store import Store


def test_retention_boundary_and_bounds():
    assert retention_boundary(datetime(2026, 3, 15, tzinfo=UTC), 3) == datetime(2025, 12, 1, tzinfo=UTC)
    with pytest.raises(ValueError):
        retention_boundary(datetime(2026, 3, 15), 0)
    assert parse_bound("2026-01-02") == parse_bound("2026-01-02T00:00") == parse_bound("2026-01-02T02:00+02:00")
    assert parse_since("15m", at("08-01 00:15")) == at("08-01 00:00") and parse_since("2026-08-01", at("08-09 00:00")) == at("08-01 00:00")


def test_store_prunes_and_drops_months(spark, make, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append_events(make.events(*[make.event("x", f"{m:02d}-15 00:00", "d") for m in range(1, 9)]))
    assert store.events(1, at("03-01 00:00"), at("05-01 00:00")).count() == 2
    plan = store.events(1, at("03-01 00:00"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_id" in plan and "month" in plan.split("PartitionFilters")[1].split("]")[0]
    projects = spark.createDataFrame([(1, "one", 3, None, "active")], PROJECTS)
    t = store.tables(at("08-20 00:00"))
    span = funnels.resolve_range(t.now, since=at("06-01 00:00"), until=at("07-02 00:00"))
    funnel = parse_funnel({"steps": [{"event": "x"}, {"event": "x"}], "window_seconds": 3600})
    for rows in (events.feed(t, since=at("07-01 00:00")), events.stats(t, "1d"), funnels.levels(t, funnel, span)):
        read = re.findall(r"PartitionFilters: \[([^\]]*)", rows._jdf.queryExecution().executedPlan().toString())
        assert read and all("month" in x and "project_id" in x for x in read), read
    assert store.tables(at("08-20 00:00")).between(at("07-01 00:00")).count() == 2
    zone = timezone(timedelta(hours=2))
    late = Store(spark, str(tmp_path / "zone"))
    late.append_events(make.events(make.event("x", "07-31 23:00", "d")))
    assert late.events(1, datetime(2026, 8, 1, 0, 30, tzinfo=zone)).count() == 1
    assert late.events(1, None, datetime(2026, 7, 31, 20, tzinfo=timezone(-timedelta(hours=5)))).count() == 1
    expired = lifecycle.expired_months(store.events(), projects, at("08-20 00:00"))
    assert sorted(r.month for r in expired.collect()) == [202601, 202602, 202603, 202604]
    assert store.drop_months(expired) == 4
    assert store.events(1).count() == 4
    assert lifecycle.retained(store.events(1), at("08-20 00:00"), 1).count() == 2
    with pytest.raises(ValueError):
        lifecycle.expired_months(store.events(), projects, at("08-20 00:00"), at("08-22 00:00"))


def test_side_tables(spark, make, tmp_path):
    from footfall.schema import BINDINGS

    store = Store(spark, str(tmp_path))
    assert store.read("bindings", BINDINGS).count() == 0
    store.replace("bindings", make.bindings(("d", "a", "08-01 00:00")))
    store.replace("bindings", make.bindings(("d", "b", "08-01 00:00")))
    assert [r.person_id for r in store.read("bindings", BINDINGS).collect()] == ["b"]


@pytest.fixture
def world(spark, make):
    rows = [
        make.event("only_alice", "08-01 08:00", "d", props={"secret": "1"}), make.event("shared", "08-01 16:00", "d", props={"both": "1"}), make.event("shared", "08-01 09:00", "d", props={"both": "1", "mine": "1"}),
        make.event("$identify", "08-01 12:00", "d", "alice", {"plan": "x"}), make.event("shared", "08-01 17:00", "", "bob"),
    ]
    t = make.tables(make.events(*rows), bindings=make.bindings(("d", "alice", "08-01 12:00"), ("d", "bob", "08-01 15:00")), aliases=make.aliases(("al", "alice")))
    dead = spark.createDataFrame([(1, at("08-01 00:00"), "r", "d", '{"user_id":"alice"}'), (1, at("08-01 00:00"), "r", "d", '{"user_id":"alice2"}')], "project_id long, received_at timestamp, reason string, detail string, payload string")
    return t, dead


def erase(t, dead, request):
    return lifecycle.purge(t, request, rollups.device_index(t.events), rollups.person_traits(t.events), dead, rollups.event_schema(t.events))


def test_purge(world):
    t, dead = world
    request, hidden = lifecycle.request_deletion(t, "al", "r1")
    assert request.person_ids == ("al", "alice", "d") and sorted(r.person_id for r in hidden.collect()) == ["al", "alice", "d"]
    left = erase(t, dead, request)
    assert sorted((r.event_name, r.timestamp.hour) for r in left.events.collect()) == [("shared", 16), ("shared", 17)]
    assert {r.event_name for r in left.event_schema.collect()} == {"shared"}
    assert {r.property_key for r in left.event_schema.collect()} == {"", "both"}
    assert [r.payload for r in left.dead_letter.collect()] == ['{"user_id":"alice2"}']
    assert [r.person_id for r in left.bindings.collect()] == ["bob"] and left.aliases.count() == 0
    again = erase(t.at(events=left.events, bindings=left.bindings, aliases=left.aliases), left.dead_letter, request)
    assert again.events.count() == 2 and again.dead_letter.count() == 1


def test_purge_keeps_to_its_ceiling(world, make):
    t, dead = world
    request, _ = lifecycle.request_deletion(t, "bob", "r2")
    merged = t.at(aliases=make.aliases(("al", "alice"), ("alice", "bob")))
    assert {r.event_name for r in erase(merged, dead, request).events.collect()} == {"only_alice", "shared", "$identify"}


def test_deletion_requests(world, make):
    t, _ = world
    with pytest.raises(lifecycle.NotFound):
        lifecycle.request_deletion(t, "nobody", "r")
    old = lifecycle.DeletionRequest("r0", 1, "nobody", ("nobody",), at("08-01 00:00"))
    assert lifecycle.request_deletion(t, "nobody", "r", [old])[0] is old
    # What is suppressed already still exists.
    assert lifecycle.request_deletion(t.at(suppressed=make.suppressed(("alice", "08-06 00:00"))), "alice", "r3")[0].person_ids == ("al", "alice", "d")
    assert lifecycle.deletion_status(old) == "pending" and lifecycle.deletion_status(old, leased=True) == "in_progress"
    assert lifecycle.deletion_status(lifecycle.advance(old, at=at("08-02 00:00"))) == "completed"
    failed = old
    for _ in range(5):
        failed = lifecycle.advance(failed, error="down")
    assert lifecycle.deletion_status(failed) == "failed"


def test_projects(make):
    tables = {"events": make.events(make.event("x", "08-01 00:00", "d")), "bindings": make.bindings(("d", "a", "08-01 00:00"))}
    assert sorted(map(tuple, lifecycle.remaining(tables, 1).collect())) == [("bindings", 1), ("events", 1)]
    assert lifecycle.remaining(lifecycle.purge_project(tables, 1), 1).count() == 0
    assert lifecycle.accepts("active") is None and lifecycle.accepts("archived") != lifecycle.accepts("deleting")
    with pytest.raises(ValueError):
        lifecycle.confirm_deletion("one", "two")


def test_dead_letters_expire(world):
    _, dead = world
    assert lifecycle.dead_letter_retained(dead, at("08-30 00:00")).count() == 2
    assert lifecycle.dead_letter_retained(dead, at("09-15 00:00")).count() == 0
