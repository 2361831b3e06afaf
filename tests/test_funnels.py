import pytest
from conftest import at

from footfall.plans import funnels
from footfall.plans.ast import ParseError, parse_funnel, parse_node
from footfall.plans.validate import LimitError, funnel_warnings, validate_funnel, validate_range

STEPS = ["landed", "clicked", "converted"]


def funnel(window=3600, steps=STEPS):
    return parse_funnel({"steps": [{"event": s} if isinstance(s, str) else s for s in steps], "window_seconds": window})


SPAN = funnels.Range(at("08-01 00:00"), at("08-02 00:00"))
SCENARIOS = [
    ("complete", [("landed", "10:00"), ("clicked", "10:01"), ("converted", "10:02")], 3600, 3),
    ("best attempt", [("landed", "01:00"), ("clicked", "01:01"), ("landed", "09:00"), ("clicked", "09:01"), ("converted", "09:02")], 3600, 3),
    ("short window", [("landed", "10:00"), ("clicked", "10:00:30"), ("converted", "10:30")], 60, 2),
    ("long window", [("landed", "10:00"), ("clicked", "10:00:30"), ("converted", "10:30")], 3600, 3),
    ("out of order", [("converted", "10:00"), ("clicked", "10:01"), ("landed", "10:02")], 3600, 1),
    ("interleaved", [("landed", "10:00"), ("noise", "10:01"), ("clicked", "10:02"), ("noise", "10:03"), ("converted", "10:04")], 3600, 3),
    ("late arrival", [("converted", "10:02"), ("clicked", "10:01"), ("landed", "10:00")], 3600, 3),
    ("restart inside the window", [("landed", "10:00"), ("clicked", "10:10"), ("landed", "10:50"), ("converted", "11:05")], 3600, 2),
    ("latest start wins", [("landed", "10:00"), ("landed", "10:30"), ("clicked", "10:40"), ("converted", "11:20")], 3600, 3),
]


@pytest.mark.parametrize("folded", [False, True])
@pytest.mark.parametrize("name,events,window,level", SCENARIOS, ids=[s[0] for s in SCENARIOS])
def test_scenarios(make, folded, name, events, window, level):
    t = make.tables(make.events(*[make.event(n, f"08-01 {h}", "d") for n, h in events]))
    rows = funnels.levels(t, funnel(window), SPAN, folded=folded).collect()
    assert [(r.person_id, r.level) for r in rows] == [("d", level)]


@pytest.mark.parametrize("folded", [False, True])
def test_ties_and_repeated_steps(make, folded):
    one = make.event("landed", "08-01 10:00", "d", id="a")
    two = make.event("landed", "08-01 10:01", "d", id="b")
    repeated = funnel(3600, ["landed", "landed"])
    assert funnels.levels(make.tables(make.events(one)), repeated, SPAN, folded=folded).first().level == 1
    assert funnels.levels(make.tables(make.events(one, two)), repeated, SPAN, folded=folded).first().level == 2
    # At one instant the id decides.
    first = make.events(make.event("landed", "08-01 10:00", "d", id="a"), make.event("clicked", "08-01 10:00", "d", id="b"))
    last = make.events(make.event("landed", "08-01 10:00", "d", id="b"), make.event("clicked", "08-01 10:00", "d", id="a"))
    assert funnels.levels(make.tables(first), funnel(), SPAN, folded=folded).first().level == 2
    assert funnels.levels(make.tables(last), funnel(), SPAN, folded=folded).first().level == 1


def test_duplicate_and_deleted(make):
    rows = [make.event("landed", "08-01 10:00", "d", id="a"), make.event("landed", "08-01 10:00:05", "d", id="a"), make.event("clicked", "08-01 10:01", "d")]
    t = make.tables(make.events(*rows))
    assert [r.level for r in funnels.levels(t, funnel(), SPAN).collect()] == [2]
    gone = t.at(suppressed=make.suppressed(("d", "08-01 10:01")))
    assert funnels.levels(gone, funnel(), SPAN).collect() == []


def test_identify_in_the_middle_makes_one_person(make):
    rows = [make.event("landed", "08-01 10:00", "d"), make.event("clicked", "08-01 10:01", "d"), make.event("converted", "08-01 10:02", "", "u")]
    t = make.tables(make.events(*rows), bindings=make.bindings(("d", "u", "08-01 10:01:30")))
    assert [(r.person_id, r.level) for r in funnels.levels(t, funnel(), SPAN).collect()] == [("u", 3)]


def test_entry_is_bounded_but_steps_may_follow(make):
    rows = [make.event("landed", "08-01 23:50", "a"), make.event("clicked", "08-02 00:10", "a"), make.event("landed", "08-02 00:05", "b")]
    found = funnels.levels(make.tables(make.events(*rows)), funnel(), SPAN).collect()
    assert [(r.person_id, r.level) for r in found] == [("a", 2)]


def test_partial_entrants(make):
    rows = [make.event("landed", "08-01 10:00", "a"), make.event("landed", "08-01 11:30", "b")]
    found = funnels.histogram(funnels.levels(make.tables(make.events(*rows), "08-01 12:00"), funnel(), SPAN)).collect()
    assert [(r.level, r.people, r.partial) for r in found] == [(1, 2, 1)]


def test_audience_keeps_others_from_a_step_and_a_segment_from_all(make):
    rows = [make.event(n, f"08-01 10:0{i}", d) for d in ("a", "b") for i, n in enumerate(STEPS)] + [make.event("vip", "08-01 09:00", "a")]
    vip = {"kind": "behavior", "event": "vip", "aggregate": "count", "window": {"kind": "ever"}, "operator": ">=", "value": 1}
    t = make.tables(make.events(*rows))
    some = funnel(3600, ["landed", {"event": "clicked", "audience": vip}, "converted"])
    assert sorted((r.person_id, r.level) for r in funnels.levels(t, some, SPAN).collect()) == [("a", 3), ("b", 1)]
    assert [(r.person_id, r.level) for r in funnels.levels(t, funnel(), SPAN, parse_node(vip)).collect()] == [("a", 3)]


def test_report_and_people(make):
    rows = [make.event(n, f"08-01 1{i}:0{j}", f"p{i}") for i, k in enumerate((1, 2, 3, 3)) for j, n in enumerate(STEPS[:k])]
    t = make.tables(make.events(*rows))
    found = funnels.levels(t, funnel(), SPAN)
    report = [(r.step, r.people, round(r.from_previous, 3), round(r.from_start, 3)) for r in funnels.report(found, 3).collect()]
    assert report == [(1, 4, 1.0, 1.0), (2, 3, 0.75, 0.75), (3, 2, 0.667, 0.5)]
    summary = funnels.summarise([(r.level, r.people, r.partial) for r in funnels.histogram(found).collect()], STEPS)
    assert [s["people"] for s in summary["steps"]] == [4, 3, 2] and summary["conversion_rate"] == 0.5
    assert funnels.biggest_leak(summary) == 3
    assert [r.person_id for r in funnels.people(t, funnel(), SPAN, 2).collect()] == ["p3", "p2", "p1"]
    assert [r.person_id for r in funnels.people(t, funnel(), SPAN, 2, "dropped").collect()] == ["p1"]
    assert funnels.people_count(t, funnel(), SPAN, 3, "dropped").first().person_count == 2
    after = funnels.people(t, funnel(), SPAN, 1, after=(at("08-01 12:00"), "p2")).collect()
    assert [r.person_id for r in after] == ["p1", "p0"]


def test_summaries_of_nothing():
    empty = funnels.summarise([], STEPS)
    assert empty["conversion_rate"] == 0 and funnels.biggest_leak(empty) is None
    assert funnels.summarise([(0, 9, 9), (7, 1, 0)], STEPS)["converted"] == 1
    even = funnels.summarise([(1, 1, 0), (2, 1, 0)], STEPS)
    assert funnels.biggest_leak(even) == 3


def test_limits_and_ranges():
    for f, code in ((funnel(2_592_001), "window"), (funnel(60, ["x"] * 9), "steps")):
        with pytest.raises(LimitError) as e:
            validate_funnel(f)
        assert e.value.code == code
    with pytest.raises(LimitError):
        validate_range(at("01-01 00:00"), at("06-01 00:00"))
    with pytest.raises(LimitError):
        validate_range(at("01-01 00:00"), at("01-01 00:00"))
    with pytest.raises(ValueError):
        funnels.resolve_range(at("08-01 00:00"), days=3, since=at("07-01 00:00"))
    assert funnels.resolve_range(at("08-08 00:00")).since == at("08-01 00:00")
    with pytest.raises(ParseError):
        parse_funnel({"steps": [{"event": "x"}], "window_seconds": 5})
    assert funnel_warnings(funnel(60, ["$page", "x"]))[0][0] == "steps[0]"
