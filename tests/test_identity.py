import pytest
from conftest import at

from footfall.operators import identity

CASES = [
    ("retroactive", [("d", "alice", "08-01 12:00")], [], "08-01 09:00", "alice"),
    ("first owner", [("d", "alice", "08-01 12:00"), ("d", "bob", "08-01 15:00")], [], "08-01 13:00", "alice"),
    ("next owner", [("d", "alice", "08-01 12:00"), ("d", "bob", "08-01 15:00")], [], "08-01 16:00", "bob"),
    ("same second as rebind", [("d", "alice", "08-01 14:00"), ("d", "bob", "08-01 15:00")], [], "08-01 15:00:00.300", "bob"),
    ("device and alias", [("d", "device-owner", "08-01 08:00")], [("device-owner", "canonical-owner")], "08-01 09:00", "canonical-owner"),
    ("unbound", [], [], "08-01 09:00", "d"),
    ("gap of a second", [("d", "a", "08-01 08:00"), ("d", "b", "08-01 09:00:00.900"), ("d", "c", "08-01 09:00:01.200")], [], "08-01 09:00:00.500", "d"),
    ("unbound alias", [], [("d", "someone")], "08-01 09:00", "someone"),
]


@pytest.mark.parametrize("name,bindings,aliases,when,person", CASES, ids=[c[0] for c in CASES])
def test_resolve(make, name, bindings, aliases, when, person):
    rows = identity.resolve(make.events(make.event("x", when, "d")), make.bindings(*bindings), make.aliases(*aliases))
    assert [r.person_id for r in rows.collect()] == [person]


def test_a_user_id_wins_and_is_aliased(make):
    events = make.events(make.event("x", "08-01 09:00", "d", "x"), make.event("x", "08-01 09:00", "d", "z"))
    rows = identity.resolve(events, make.bindings(("d", "alice", "08-01 08:00")), make.aliases(("x", "y")))
    assert sorted(r.person_id for r in rows.collect()) == ["y", "z"]


def test_resolution_keeps_projects_apart(spark, make):
    from footfall.schema import BINDINGS

    other = spark.createDataFrame([(2, "d", "alice", at("08-01 08:00"))], BINDINGS)
    rows = identity.resolve(make.events(make.event("x", "08-01 09:00", "d")), other, make.aliases())
    assert rows.first().person_id == "d"


def test_bind_takes_the_smallest_person_of_an_instant(make):
    rows = identity.bind(make.bindings(("d", "zoe", "08-01 09:00"), ("d", "amy", "08-01 09:00"), ("d", "amy", "08-01 10:00")))
    assert sorted((r.person_id, r.bound_at.hour) for r in rows.collect()) == [("amy", 9), ("amy", 10)]


def test_exact_tiles_and_their_coalescing(make):
    exact = identity.exact_tiles(make.bindings(("d", "a", "08-01 09:00"), ("d", "a", "08-01 10:00"), ("d", "b", "08-01 11:00"), ("d", "a", "08-01 12:00")))
    assert exact.count() == 4
    rows = identity.coalesce_tiles(exact).orderBy("valid_from").collect()
    assert [(r.person_id, r.valid_from and r.valid_from.hour, r.valid_to and r.valid_to.hour) for r in rows] == [("a", None, 11), ("b", 11, 12), ("a", 12, None)]


def test_tiles_do_not_depend_on_order(make):
    rows = [("d", "a", "08-01 09:00"), ("d", "b", "08-01 10:00"), ("e", "a", "08-01 11:00")]
    one = sorted(map(tuple, identity.tiles(make.bindings(*rows)).collect()))
    assert one == sorted(map(tuple, identity.tiles(make.bindings(*rows[::-1])).collect()))


def test_alias_fold():
    assert identity.fold_aliases([("a", "b"), ("b", "c")]) == {"a": "c", "b": "c"}
    assert identity.fold_aliases([("a", "b"), ("a", "b"), ("b", "a")]) == {"a": "b"}
    assert identity.fold_aliases([("a", "b"), ("c", "d"), ("a", "c")]) == {"a": "d", "b": "d", "c": "d"}
    assert identity.fold_aliases([("x", "x")]) == {}


def test_apply_aliases(make):
    rows = identity.apply_aliases(make.aliases(("a", "b"), ("p", "q")), 1, [("b", "c")])
    assert sorted((r.person_id, r.canonical_id) for r in rows.collect()) == [("a", "c"), ("b", "c"), ("p", "q")]
