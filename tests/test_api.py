import json

import pytest
from conftest import at

from footfall.api import Project
from footfall.plans import cursor
from footfall.plans.ast import ParseError
from footfall.plans.cache import ResultCache
from footfall.plans.person import profile
from footfall.plans.saved import Definitions, Saved, Snapshot

EVERYONE = {"ast_version": 1, "filter": {"kind": "behavior", "event": "*", "aggregate": "count", "window": {"kind": "ever"}, "operator": ">=", "value": 0}}
FUNNEL = {"steps": [{"event": "a"}, {"event": "b"}], "window_seconds": 3600}


@pytest.fixture
def project(make):
    rows = [make.event("a", "08-06 10:00", f"d{i:03d}") for i in range(150)] + [make.event("b", "08-06 10:05", f"d{i:03d}") for i in range(30)]
    return Project(make.tables(make.events(*rows)))


def test_walk_over_members(project):
    first = project.segment_preview(EVERYONE)
    assert first["person_count"] == 150 and len(first["members"]) == 100 and len(first["warnings"]) == 2
    rest, end = project.segment_members(EVERYONE, first["next_cursor"])
    assert len(rest) == 50 and end is None
    assert len({r.person_id for r in first["members"] + rest}) == 150
    with pytest.raises(cursor.BadCursor):
        project.segment_members({**EVERYONE, "filter": {"kind": "not", "child": EVERYONE["filter"]}}, first["next_cursor"])


def test_saved_funnel(project):
    segment = project.saved.create("segment", "all", EVERYONE)
    row = project.saved.create("funnel", "f", {**FUNNEL, "segment_id": segment.id})
    out = project.run_funnel(row.id, days=7)
    assert [s["people"] for s in out["steps"]] == [150, 30] and out["biggest_leak"] == 2 and out["warnings"] == []
    assert project.saved.get(row.id).snapshot.result["entered"] == 150
    page = project.funnel_people(row.id, 1, "dropped", days=7)
    assert (len(page["people"]), page["people_count"]) == (100, 120)
    assert len(project.funnel_people(row.id, 1, "dropped", page["next_cursor"], days=7)["people"]) == 20
    project.saved.delete(segment.id)
    assert "everyone" in project.run_funnel(row.id, days=7)["warnings"][0]


def test_feed_stats_and_catalogs(project):
    rows, after = project.feed(limit=170, since=at("08-01 00:00"))
    assert len(rows) == 170 and project.feed(after=after)[0] == []
    assert sum(r.events for r in project.stats("1h", since=at("08-06 00:00"), until=at("08-07 00:00")).collect()) == 180
    assert [r.event_name for r in project.schema_events().collect()] == ["a", "b"]
    assert project.schema_properties().count() == 0 and project.trait_values("plan").count() == 0


def test_aliases_deletion_and_export(make):
    p = Project(make.tables(make.events(make.event("x", "08-01 00:00", "", "one"), make.event("x", "08-02 00:00", "", "two"))))
    p.alias("one", "two")
    assert p.person("one")["events"] == 2 and profile(p.tables, "two")["merged_ids"] == ["one"]
    assert json.loads(list(p.export_person("one"))[-1]) == {"type": "end", "events": 2}
    assert p.segment_preview(EVERYONE)["person_count"] == 1
    request = p.request_deletion("one")
    assert p.deletion_status(request.request_id) == "pending" and p.person("two") is None
    assert p.segment_preview(EVERYONE)["person_count"] == 0


def test_cursors():
    walk = cursor.Walk(at("08-01 00:00"), "p", at("08-02 00:00"), 3)
    text = cursor.sign(walk, "r", b"s")
    assert cursor.read(text, "r", b"s") == walk
    for bad, route, secret in ((text, "other", b"s"), (text, "r", b"t"), ("", "r", b"s"), (text[:-3] + "AAA", "r", b"s"), ("!", "r", b"s")):
        with pytest.raises(cursor.BadCursor):
            cursor.read(bad, route, secret)
    full = [(at("08-01 00:00"), "x")] * 100
    assert cursor.following(walk, full, walk.as_of).pages == 4 and cursor.following(walk, full[:99], walk.as_of) is None
    assert cursor.following(cursor.Walk(walk.last_seen, "p", walk.as_of, 9), full, walk.as_of) is None


def test_cache():
    now = [0.0]
    c = ResultCache(entries=2, rows=10, clock=lambda: now[0])
    calls = []

    def ask(project, key, value):
        return c.get(project, key, lambda: calls.append(key) or value)

    ask(1, "a", [1]), ask(1, "a", [1])
    assert calls == ["a"]
    now[0] = 31
    ask(1, "a", [1]), ask(1, "b", [1]), ask(1, "c", [1]), ask(1, "a", [1])
    assert calls == ["a", "a", "b", "c", "a"]
    ask(1, "big", [1] * 11), ask(1, "big", [1] * 11)
    assert calls[-2:] == ["big", "big"]
    c.get(1, "late", lambda: c.clear(1) or [1])
    ask(1, "late", [2])
    assert calls[-1] == "late"


def test_saved_definitions():
    d = Definitions([Saved("old", "segment", "old", {"ast_version": 9})])
    with pytest.raises(ParseError):
        d.create("segment", "bad", {"ast_version": 1, "filter": {}})
    s, f = d.create("segment", "s", EVERYONE), d.create("funnel", "f", FUNNEL)
    for row in (s, f):
        d.ran(row.id, Snapshot(1, at("08-01 00:00")))
    assert d.update(s.id, name="t").snapshot and d.update(s.id, definition=EVERYONE).snapshot is None
    assert d.update(f.id, definition=dict(reversed(FUNNEL.items()))).snapshot
    assert d.update(f.id, definition={**FUNNEL, "window_seconds": 60}).snapshot is None
    assert [(r.name, r.stale) for r in d.list("segment")] == [("old", True), ("t", False)]
