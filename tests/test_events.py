import json

import pytest
from conftest import at

from footfall.operators import rollups
from footfall.plans import catalog, events, person
from footfall.sources import ingest
from footfall.sources.export import export_person


def test_feed_pages_and_cursor(make):
    t = make.tables(make.events(*[make.event("x", "08-06 12:00", "d", id=f"e{i:02d}") for i in range(30)], make.event("x", "08-01 00:00", "d", id="old")))
    page = events.feed(t, limit=10).collect()
    assert [r.event_id for r in page] == [f"e{i:02d}" for i in range(20, 30)]
    seen, cursor = [], (at("08-01 00:00"), "old")
    while page := events.feed(t, cursor=cursor, limit=7).collect():
        seen += [r.event_id for r in page]
        cursor = events.decode_cursor(events.encode_cursor(page[-1].timestamp.astimezone().isoformat(), page[-1].event_id))
    assert seen == [f"e{i:02d}" for i in range(30)]
    for bad in ("", "x", "e30"):
        with pytest.raises(ValueError):
            events.decode_cursor(bad)
    with pytest.raises(ValueError):
        events.feed(t, limit=501)


def test_a_copy_outside_the_scan_does_not_count(make):
    t = make.tables(make.events(make.event("x", "08-06 12:00", "d", id="a"), make.event("x", "08-05 12:00", "d", id="a")))
    assert [r.timestamp.day for r in events.feed(t).collect()] == [6]


def test_stats_fill_and_limits(make):
    rows = [make.event(n, h, "d", id=i) for n, h, i in (("x", "08-06 10:01:30", "a"), ("x", "08-06 10:02:10", "a"), ("y", "08-06 10:03", "b"))]
    t = make.tables(make.events(*rows))
    since, until = at("08-06 10:00:30"), at("08-06 10:04")
    counted = events.stats(t, "1m", since, until)
    assert [(r.bucket.minute, r.events) for r in counted.collect()] == [(1, 1), (3, 1)]
    assert [r.events for r in events.filled(counted, "1m", since, until).collect()] == [0, 1, 0, 1, 0]
    assert tuple(events.peak(counted).first()) == (1, 2)
    with pytest.raises(ValueError):
        events.stats(t, "1m", at("08-01 00:00"), until)
    names = catalog.event_names(rollups.event_schema(t.events.unionByName(make.events(make.event("z", "08-01 00:00", "d")))), 1)
    assert [tuple(r) for r in events.event_totals(t, names, since, until).collect()] == [("x", 1), ("y", 1), ("z", 0)]


def test_rejections(spark):
    rows = spark.createDataFrame([(1, at(f"08-01 00:{i:02d}"), "r", "d", str(i)) for i in range(12)], "project_id long, received_at timestamp, reason string, detail string, payload string")
    page = events.rejections(rows, 1, limit=5, offset=5).collect()
    assert [r.payload for r in page] == ["6", "5", "4", "3", "2"]
    assert events.rejections_has_more(5, 5, 10) and not events.rejections_has_more(4, 5, 9)
    assert events.rejections(rows, 2).count() == 0


def test_rejections_whose_cut_payloads_are_equal_have_one_order(spark):
    """Bodies that differ only beyond what a payload keeps are rejected for different reasons at one instant."""
    bodies = [f'{{"pad":"{"x" * 9000}",{rest}}}' for rest in ('"type":"track"', '"type":"none"')]
    for order in (bodies, bodies[::-1]):
        raw = spark.createDataFrame([(1, at("08-01 00:00"), "Mozilla/5.0", b) for b in order], ingest.RAW).coalesce(1)
        pages = [events.rejections(ingest.ingest(raw).dead_letter, 1, limit=1, offset=n).collect() for n in (0, 1)]
        assert [r.detail for page in pages for r in page] == ["message_id", "type"]


def test_catalogs(make):
    rows = make.events(make.event("buy", "08-01 00:00", "d", props={"kind": "a"}, nums={"n": 1}), make.event("buy", "08-02 00:00", "d", props={"n": "x"}), make.event("bare", "08-01 00:00", "d"), make.event("$identify", "08-01 00:00", "d", "u", {"plan": "pro"}))
    schema = rollups.event_schema(rows)
    assert [r.event_name for r in catalog.event_names(schema, 1).collect()] == ["$identify", "bare", "buy"]
    assert [r.event_name for r in catalog.event_names(schema, 1, "b", 1).collect()] == ["bare"]
    listed = catalog.properties(schema, 1, "buy")
    assert [tuple(r) for r in listed.collect()] == [("kind", "string"), ("n", "number"), ("n", "string")]
    assert dict(map(tuple, catalog.property_kinds(listed).collect())) == {"kind": "string", "n": "mixed"}
    assert [r.value for r in catalog.trait_values(rollups.person_traits(rows), 1, "plan", "p").collect()] == ["pro"]
    with pytest.raises(ValueError):
        catalog.event_names(schema, 1, limit=101)


def test_merged_rollups_equal_whole_ones(make):
    rows = [make.event("$identify", f"0{m}-0{d} 00:00", f"d{d % 2}", "u" if d % 3 else "", {"plan": str(d)}, {"n": d}, country=str(d)) for m in (7, 8) for d in range(1, 9)]
    one, two, all_ = make.events(*rows[::2]), make.events(*rows[1::2]), make.events(*rows)
    for build, merge in ((rollups.device_index, rollups.merge_device_index), (rollups.person_traits, rollups.merge_person_traits), (rollups.event_schema, rollups.merge_event_schema)):
        assert sorted(map(str, merge(build(one), build(two)).collect())) == sorted(map(str, build(all_).collect()))


@pytest.fixture
def someone(make):
    rows = [
        make.event("a", "08-01 08:00", "d", id="1"), make.event("b", "08-01 13:00", "d", id="2"), make.event("b", "08-01 13:00:05", "d", id="2"), make.event("c", "08-01 16:00", "d", id="3"),
        make.event("$identify", "08-01 12:00", "d", "alice", {"plan": "free"}, id="4"), make.event("e", "08-01 17:00", "", "old-alice", id="5"),
    ]
    return make.tables(make.events(*rows), bindings=make.bindings(("d", "alice", "08-01 12:00"), ("d", "bob", "08-01 15:00")), aliases=make.aliases(("old-alice", "alice")))


def test_scope_and_profile(someone, make):
    s = person.scope(someone, "old-alice")
    assert (s.canonical, s.group, s.devices) == ("alice", ("alice", "old-alice"), ("d",))
    assert [(w.begin, w.end and w.end.hour) for w in s.windows] == [(None, 15)]
    found = person.profile(someone, "alice")
    assert (found["events"], found["merged_ids"], found["last_seen"].hour) == (4, ["old-alice"], 17)
    assert person.scope(someone, "d").canonical == "bob"  # the most recent owner of a device
    assert person.profile(someone, "nobody") is None
    hidden = someone.at(suppressed=make.suppressed(("old-alice", "08-01 16:00")))
    assert person.profile(hidden, "alice")["events"] == 1
    assert person.scope(someone, "alice", restrict_to=["alice"]).group == ("alice",)


def test_an_unbound_device_is_no_person_to_read(make):
    t = make.tables(make.events(make.event("x", "08-01 00:00", "lone")))
    assert person.profile(t, "lone") is None


def test_too_many_windows(make):
    rows = [("d", "alice" if i % 2 else "bob", f"08-01 {i // 60:02d}:{i % 60:02d}") for i in range(420)]
    t = make.tables(make.events(make.event("x", "08-01 00:01:30", "d")), bindings=make.bindings(*rows))
    s = person.scope(t, "alice")
    with pytest.raises(person.TooFragmented):
        person.profile(t, "alice")
    assert person.person_events(t.events, s, None).count() == 1


def test_export_lines(someone):
    lines = [json.loads(x) for x in export_person(someone, person.scope(someone, "alice"))]
    assert [x["type"] for x in lines] == ["person", "event", "event", "event", "event", "end"]
    assert lines[0]["traits"] == {"plan": "free"} and lines[-1]["events"] == 4
    assert [x["event_id"] for x in lines[1:-1]] == ["1", "4", "2", "5"]
