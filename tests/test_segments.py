import pytest
from conftest import at

from footfall.operators import dedup
from footfall.plans import segments
from footfall.plans.ast import ParseError, describe, parse_node, parse_segment, tree_hash
from footfall.plans.validate import LimitError, cost_warnings, validate_tree


def behavior(event, op, value, aggregate="count", window=None, **more):
    return {"kind": "behavior", "event": event, "aggregate": aggregate, "window": window or {"kind": "last", "n": 7, "unit": "days"}, "operator": op, "value": value, **more}


def both(*children, op="and"):
    return {"kind": "group", "op": op, "children": list(children)}


def no(child):
    return {"kind": "not", "child": child}


TRIAL = {"kind": "trait", "key": "plan", "operator": "=", "value": "trial"}
EVER = {"kind": "ever"}


@pytest.fixture
def people(make):
    rows = []
    for device, user, plan in (("dev-a", "alice", "trial"), ("dev-b", "bob", "trial"), ("dev-c", "carol", "pro")):
        rows.append(make.event("$identify", "08-01 00:00", device, user, {"plan": plan}, {"seats": len(user)}, country="DE", os="ios"))
    rows += [make.event("import_started", f"08-0{d} 00:00", "dev-a", nums={"rows": d}, props={"kind": f"k{d % 2}"}, id=f"imp-{d}", country="FR") for d in (3, 4, 5)]
    rows += [make.event("import_started", "08-03 00:00", "dev-b"), make.event("invite_teammate", "08-04 00:00", "dev-b")]
    rows += [make.event("import_started", f"08-0{d} 00:00", "", "carol") for d in (3, 4, 5)]
    return rows


@pytest.fixture
def ask(make, people):
    def run(tree, *more, now="08-07 00:00", bound=None, **side):
        binds = make.bindings(*(bound or [("dev-a", "alice", "08-01 00:00"), ("dev-b", "bob", "08-01 00:00"), ("dev-c", "carol", "08-01 00:00")]))
        t = make.tables(make.events(*people, *more), now, bindings=binds, **side)
        return sorted(r.person_id for r in segments.persons(t, parse_node(tree)).collect())

    return run


def test_worked_example(ask):
    tree = both(TRIAL, behavior("import_started", ">=", 3), no(behavior("invite_teammate", ">=", 1, window=EVER)))
    assert ask(tree) == ["alice"]


def test_everyone_and_never(ask):
    assert ask(behavior("*", ">=", 0)) == ["alice", "bob", "carol"]
    assert ask(behavior("invite_teammate", "=", 0, window=EVER)) == ["alice", "carol"]
    assert ask(no(behavior("invite_teammate", ">=", 1, window=EVER))) == ["alice", "carol"]


def test_a_retry_with_another_time_counts_once(ask, make):
    again = make.event("import_started", "08-06 00:00", "dev-a", id="imp-3")
    assert ask(behavior("import_started", ">=", 4), again) == []
    assert ask(behavior("import_started", ">=", 3), again) == ["alice", "carol"]


@pytest.mark.parametrize(
    "aggregate,value,who",
    [("sum", 12, ["alice"]), ("min", 3, ["alice"]), ("max", 5, ["alice"]), ("max", 0, ["bob", "carol"])],
)
def test_numeric_aggregates_read_absent_as_zero(ask, aggregate, value, who):
    assert ask(behavior("import_started", "=", value, aggregate, property="rows")) == who


def test_distinct_counts_the_absent_value_as_one(ask):
    assert ask(behavior("import_started", "=", 1, "distinct", property="kind")) == ["bob", "carol"]
    assert ask(behavior("import_started", "=", 2, "distinct", property="kind")) == ["alice"]


def test_conditions_on_events(ask):
    low = [{"property": "rows", "operator": "<", "value": 4}]
    assert ask(behavior("import_started", "=", 1, where=low)) == ["alice", "bob"]  # bob's row without the key reads as 0
    assert ask(behavior("import_started", "=", 3, where=low)) == ["carol"]
    other = [{"property": "kind", "operator": "!=", "value": "k1"}]
    assert ask(behavior("import_started", "=", 1, where=other)) == ["alice", "bob"]
    assert ask(behavior("import_started", ">=", 1, where=[{"source": "attribute", "attribute": "country", "operator": "=", "value": "FR"}])) == ["alice"]
    assert ask(behavior("import_started", ">=", 1, where=[{"property": "rows", "operator": "between", "value": [9, 1]}])) == []


def test_windows(ask):
    assert ask(behavior("import_started", ">=", 1, window={"kind": "last", "n": 48, "unit": "hours"})) == ["alice", "carol"]
    assert ask(behavior("import_started", "=", 2, window={"kind": "absolute", "from": "2026-08-03", "to": "2026-08-04"})) == ["alice", "carol"]


def test_traits_and_context(ask):
    assert ask(TRIAL) == ["alice", "bob"]
    assert ask(no(TRIAL)) == ["carol"]
    assert ask({"kind": "trait", "key": "seats", "operator": ">", "value": 3}) == ["alice", "carol"]
    assert ask({"kind": "trait", "key": "absent", "operator": "<", "value": 5}) == []
    assert ask({"kind": "trait", "key": "absent", "operator": "!=", "value": "x"}) == ["alice", "bob", "carol"]
    assert ask({"kind": "context", "field": "country", "scope": "latest", "operator": "=", "value": "FR"}) == ["alice"]
    assert ask({"kind": "context", "field": "country", "scope": "first_touch", "operator": "=", "value": "DE"}) == ["alice", "bob", "carol"]
    assert ask({"kind": "lifecycle", "field": "last_seen", "operator": "<", "value": "2026-08-05"}) == ["bob"]
    assert ask({"kind": "lifecycle", "field": "first_seen", "operator": "=", "value": "2026-08-01T02:00:00+02:00"}) == ["alice", "bob", "carol"]


def test_a_numeric_test_of_a_text_trait_holds_of_no_one(ask):
    assert ask({"kind": "trait", "key": "plan", "operator": "!=", "value": 5}) == []


def test_suppression_hides_up_to_its_boundary(ask, make):
    gone = make.suppressed(("alice", "08-04 00:00"))
    assert ask(behavior("import_started", "=", 1), suppressed=gone) == ["alice", "bob"]
    assert ask(behavior("*", ">=", 0), suppressed=make.suppressed(("alice", "08-05 00:00"))) == ["bob", "carol"]


def test_traits_of_two_devices_become_the_last_value(make):
    rows = [make.event("$identify", "08-01 00:00", "d1", "u", {"plan": "free", "a": "1"}), make.event("$identify", "08-02 00:00", "d2", "v", {"plan": "pro"}, {"a": 2})]
    t = make.tables(make.events(*rows), aliases=make.aliases(("v", "u")))
    page = segments.members(t, parse_node(behavior("*", ">=", 0))).collect()
    assert [(r.person_id, r.traits, r.traits_num, r.trait_total) for r in page] == [("u", {"plan": "pro"}, {"a": 2.0}, 2)]


def test_members_walk_covers_everyone_once(make):
    rows = [make.event("x", "08-01 00:00", f"d{i:03d}") for i in range(230)]
    t, node, seen, after = make.tables(make.events(*rows)), parse_node(behavior("*", ">=", 0)), [], None
    while page := segments.members(t, node, after).collect():
        seen += [r.person_id for r in page]
        after = (page[-1].last_seen.astimezone(), page[-1].person_id)
    assert seen == [f"d{i:03d}" for i in range(230)]


def test_bounded_traits(make):
    t = make.tables(make.events(make.event("$identify", "08-01 00:00", "d", "u", {f"k{i:03d}": "v" for i in range(60)})))
    row = segments.members(t, parse_node(behavior("*", ">=", 0))).first()
    assert len(row.traits) == 50 and min(row.traits) == "k000" and max(row.traits) == "k049" and row.trait_total == 60


def test_empty_tables(make):
    t = make.tables(make.events())
    assert segments.count(t, parse_node(both(TRIAL, behavior("x", ">=", 1)))).first().person_count == 0


def test_first_by_event_id(make):
    rows = make.events(make.event("x", "08-01 00:00", "d", id="a", received="08-01 00:01"), make.event("x", "08-01 00:00", "d", id="a", received="08-01 00:02"), make.event("x", "08-02 00:00", "d", id="a"))
    kept = dedup.first_by_event_id(rows).collect()
    assert [(r.timestamp.day, r.received_at.minute) for r in kept] == [(1, 2)]
    assert dedup.duplicates(rows).first().copies == 3


BAD = [
    ({"kind": "nope"}, "kind"), ({"kind": "group", "op": "and", "children": []}, "children"), ({"kind": "trait", "key": "", "operator": "=", "value": "x"}, "key"),
    ({"kind": "trait", "key": "k", "operator": "between", "value": "x"}, "value"), ({"kind": "trait", "key": "k", "operator": "=", "value": ["a", "b"]}, "value"),
    ({"kind": "trait", "key": "k", "operator": "=", "value": None}, "value"), ({"kind": "context", "field": "path", "operator": "=", "value": "x"}, "field"),
    (behavior("x", ">=", 1, property="p"), "property"), (behavior("x", ">=", 1, "sum"), "property"), (behavior("x", ">=", 1, window={"kind": "last", "n": 0, "unit": "days"}), "n"),
    (behavior("x", ">=", 1, where=[{"source": "attribute", "attribute": "properties", "operator": "=", "value": "x"}]), "attribute"), (behavior("x", ">=", 1, where=[{"source": "attribute", "attribute": "path", "operator": "=", "value": 5}]), "value"),
    ({"kind": "lifecycle", "field": "last_seen", "operator": "=", "value": "soon"}, "value"),
]


@pytest.mark.parametrize("tree,place", BAD)
def test_bad_trees_name_the_place(tree, place):
    with pytest.raises(ParseError) as e:
        parse_node(tree)
    assert e.value.path.endswith(place)


def test_limits():
    deep = TRIAL
    for _ in range(9):
        deep = no(deep)
    validate_tree(parse_node(deep))
    for tree, code in ((no(deep), "depth"), (both(*[both(*[TRIAL] * 25)] * 4), "nodes"), (both(*[behavior(f"e{i}", ">=", 1) for i in range(26)]), "behaviors")):
        with pytest.raises(LimitError) as e:
            validate_tree(parse_node(tree))
        assert e.value.code == code


def test_warnings_hashes_and_words():
    tree = both(behavior("x", ">=", 1, window=EVER), behavior("*", ">=", 1))
    assert [p for p, _ in cost_warnings(parse_node(tree))] == ["filter.children[0]", "filter.children[1]"]
    assert tree_hash({"a": 1, "b": [2]}) == tree_hash({"b": [2], "a": 1}) != tree_hash({"a": 1, "b": [3]})
    assert describe(parse_segment({"ast_version": 1, "filter": no(TRIAL)})) == "not trait plan = trial"
    with pytest.raises(ParseError):
        parse_segment({"ast_version": 2, "filter": TRIAL})
    assert at("08-01 00:00").tzinfo is not None
