import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import decontaminate as D

from .helpers import ALNUM, corpus, frame, prose, words


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = words(t, ALNUM) if t is not None else []
        if i is not None and w:
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = {}
    for doc, t, *_ in rows:
        w, hit, found = words(t, ALNUM), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        out[doc] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def planted(seed=2):
    rng = random.Random(seed)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 40, 13, 12, 14, 3, 1, 0, 60, 25])]
    items += [(20, items[0][1]), (21, None), (None, "red fox runs over the word line and the tree of x ing"), (22, "lone")]
    rows = corpus(80, seed)
    for k in range(40):
        source = rng.choice(items[:10])[1].split(" ")
        a = rng.randrange(len(source) + 1)
        part = " ".join(source[a : a + rng.randrange(30)]).upper() if k % 2 else " ".join(source)
        rows.append((1000 + k, f"{prose(rng, rng.randrange(120))} {part}\n{prose(rng, rng.randrange(40))}", None, None, None))
    return rows, items


@pytest.mark.parametrize(("seed", "bits"), [(2, 16), (3, 6)])
def test_against_brute_force(spark, monkeypatch, seed, bits):
    """Whether the bitmap drops most fingerprints or none."""
    monkeypatch.setattr(D, "LEAST_BITS", bits)
    monkeypatch.setattr(D, "MOST_BITS", bits)
    rows, items = planted(seed)
    out = D.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in out}
    want = {k: (a, b, sorted(c), d) for k, (a, b, c, d) in brute(rows, items).items()}
    assert got == want and sum(v[3] for v in want.values()) > 10
    for r in out:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_winnowing_keeps_a_fingerprint_of_every_span():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**64, 500, dtype=np.uint64)
    _, p, _ = D.winnow(h, np.zeros(500, np.int64))
    for i in range(500 - D.SPAN + 1):
        assert ((p >= i) & (p + D.GRAM <= i + D.SPAN)).any()
    a, b = rng.integers(0, 2**64, 50, dtype=np.uint64), rng.integers(0, 2**64, 50, dtype=np.uint64)
    a[7 : 7 + D.SPAN] = b[30 : 30 + D.SPAN]
    one, two = D.winnow(a, np.zeros(50, int)), D.winnow(b, np.zeros(50, int))
    assert np.isin(one[2], two[2]).any()
    assert len(D.winnow(a[:5], np.zeros(5, int))[0]) == 0


def test_digest_and_empty_tables(spark, tmp_path):
    items = spark.createDataFrame([(i, "p q r") for i in (9, 10)], "item_id long, text string")
    docs = frame(spark, [(1, "P-q r", None, None, None), (1, "P-q r", None, None, None), (2, None, None, None, None)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, D.op6_decontaminate(spark, str(tmp_path)).collect()))
    one = (1, 3, 3, 2, hashlib.sha256(b"10,9").hexdigest(), True)
    assert got == [one, one, (2, 0, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert D.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert D.contamination(docs.limit(0), items).count() == 0
    assert D.contamination(docs.withColumn("text", F.lit("x")), items).where("contaminated").count() == 0


def test_texts_of_one_id_stay_apart(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(20)) for k in "ab")
    rows = [(i, t, None, None, None) for i in (None, 7) for t in (a, b, a, " ".join(["c"] * 20))]
    items = spark.createDataFrame([("1", a), ("2", b)], "item_id string, text string")
    got = sorted((r.doc_id or 0, r.n_hit, r["items"], r.contaminated) for r in D.contamination(frame(spark, rows), items).collect())
    assert got == sorted((i, n, x, n > 0) for i in (0, 7) for n, x in [(20, ["1"]), (20, ["2"]), (20, ["1"]), (0, [])])


def test_a_passage_of_many_items_and_documents(spark):
    """A common passage is one row of the benchmark's table, however many items and documents have it."""
    passage = " ".join(f"p{i}" for i in range(15))
    items = spark.createDataFrame([(i, f"{passage} q{i}") for i in range(3000)], "item_id long, text string")
    docs = frame(spark, [(i, f"d{i} {passage}", None, None, None) for i in range(300)])
    assert D.benchmark_windows(items).where("size(items) = 3000").count() == 3
    out = D.contamination(docs, items).selectExpr("n_hit", "size(items) AS n", "spans").distinct().collect()
    assert [(r.n_hit, r.n, [tuple(x) for x in r.spans]) for r in out] == [(15, 3000, [(1, 16)])]
