import pytest

from footfall.llm import source_mix as M

from .helpers import SPACED, corpus, frame


def fill(sizes, weights, cap=3):
    """Targets by sharing anew until none is above its cap."""
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    rows = [r for r in corpus(300, seed) if r[1] is None or len(r[1]) < 50_000]
    out = M.mix_sources(frame(spark, rows)).collect()
    sizes, by = {}, {}
    for i, t, _, s, _ in rows:
        by[i] = (len(SPACED.findall(t or "")), s)
        sizes[s] = sizes.get(s, 0) + by[i][0]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert (r.size, r.source) == by[r.doc_id] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    total = sum(sizes.values())
    assert len(out) == len(rows) and sum(taken.values()) == pytest.approx(total, rel=0.01)
    assert all(abs(taken[s] - targets[s]) <= 0.01 * total for s in sizes)
    again = M.mix_sources(frame(spark, rows[::-1], False)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_odd_tables(spark):
    assert M.mix_sources(frame(spark, [])).collect() == []
    none = [(1, None, None, None, None), (2, " ", None, "a", None)]
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in M.mix_sources(frame(spark, none)).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    one = [(1, "a b c", None, "s", None)] * 2 + [(None, "d e", None, "s", None)]
    got = M.mix_sources(frame(spark, one)).collect()
    assert len(got) == 3 and sum(r.taken for r in got) == 8 and all(r.target == 8 for r in got)


def test_a_capped_source_stops_at_three_times_its_size(spark):
    rows = [(0, "w " * 10, None, "a", None), *[(i, "w " * 100, None, s, None) for i, s in ((1, "b"), (2, "c"))]]
    got = {r.source: (r.target, r.taken) for r in M.mix_sources(frame(spark, rows)).collect()}
    assert got["a"] == (30.0, 30) and got["b"][0] == pytest.approx(120) and abs(got["b"][1] - 120) <= 3


def test_small_sources_come_near_their_targets_too(spark):
    rows = [(i, "w " * 5000, None, "big", None) for i in range(100)] + [(1000 + i, "w " * (3 + i), None, s, None) for s in ("a", "b", None) for i in range(20)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    taken, target = {}, {}
    for r in M.mix_sources(frame(spark, rows)).collect():
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] for s in target), (taken, target)


def test_ranks_are_without_gaps(spark):
    sized = spark.createDataFrame([("a", 500), ("b", 300), (None, 200)], "source string, size long")
    ranks = M.schedule(spark, 3000, M.source_targets(sized, 7)).groupBy("sid").agg({"rank": "max", "*": "count"}).collect()
    assert all(r["max(rank)"] + 1 == r["count(1)"] for r in ranks) and sum(r["count(1)"] for r in ranks) == 3000


def test_no_plan_holds_all_steps(spark):
    """A plan is planned anew after each of its stages, by the driver: its size counts twice."""
    out = M.mix_sources(frame(spark, corpus(40)))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 6
