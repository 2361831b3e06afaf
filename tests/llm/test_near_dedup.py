import random

import numpy as np
import pytest

from footfall.llm import near_dedup as N
from footfall.llm._graph import components

from .helpers import corpus, frame, prose, words


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_against_brute_force(spark, percent):
    rows = corpus(160, seed=percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(frame(spark, rows), percent).collect()}
    assert got == brute(rows, percent)


def family(n, seed=3, most=14):
    rng = random.Random(seed)
    base = prose(rng, 150).split(" ")
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10_000)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    return rows


def test_a_large_family_of_chains_is_compared_in_full(spark, monkeypatch):
    rows = family(260)
    monkeypatch.setattr(N, "BLOCK_ROWS", 32)
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(frame(spark, rows, False)).collect()}
    assert got == want and 1 < len({c for _, c in want.values()}) < 260


def test_copies_and_repeated_rows(spark):
    rows = [(9, "same text of just six words", None, None, None)] * 2 + [(4, "SAME  text of\njust six words", None, None, None), (7, "", None, None, None), (8, None, None, None, None), (None, "same text of just six words", None, None, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(frame(spark, rows)).collect())
    assert got == [(4, 2, 4, True), (7, 0, 7, True), (8, 0, 8, True), (9, 2, 4, False), (9, 2, 4, False)]


def test_empty(spark):
    assert N.near_duplicates(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        N.near_duplicates(frame(spark, []), 50)


def test_estimates_are_near_the_truth():
    a = np.arange(1000, dtype=np.uint64)
    for shared in (0, 500, 900, 1000):
        b = np.concatenate([a[:shared], np.arange(5000, 6000 - shared, dtype=np.uint64)])
        m = N.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 1000, 2000]))
        truth = shared / (2000 - shared)
        est = N.similarity(N.pack(m)[0], N.pack(m)[1:])[0]
        assert abs(est - truth) < 0.2 and abs((m[0] == m[1]).mean() - truth) < 0.15


def test_packing_keeps_the_low_bits():
    m = np.random.default_rng(0).integers(0, 2**32, (3, N.PERMS), dtype=np.uint32)
    assert N.pack(m).shape == (3, N.PERMS * N.BITS // 64)
    assert N.similarity(N.pack(m)[0], N.pack(m))[0] == 1


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1090)] + [(5, 5)]
    root = {}
    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])
    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got, _ = components(spark.createDataFrame(links, "u long, v long"))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "u long, v long"))[0].count() == 0
