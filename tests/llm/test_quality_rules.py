from collections import Counter

import numpy as np

from footfall.llm import quality_rules as Q

from .helpers import SPACED, corpus, frame, prose


def measured(text):
    text = text or ""
    w = SPACED.findall(text)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rows = [*corpus(150), (900, "a b c " * 40, "en", "s1", 0), (901, "a a a a", None, None, None), (902, "a b c a b c", None, None, None), (903, "x|y ## <b>", None, None, None)]
    out = {r.doc_id: r for r in Q.quality_rules(frame(spark, rows)).collect()}
    assert len(out) == len(rows)
    for i, t, *_ in rows:
        r = out[i]
        n, _, _, _, repeats = want = measured(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and not (r.kept and r.base_failed)


def raw(values):
    mid, high = (np.quantile(values, q, method="inverted_cdf") for q in Q.QUANTILES)
    return high + Q.SPREADS * (high - mid)


def drawn(own, wider):
    return (len(own) * raw(own) + Q.PRIOR * wider) / (len(own) + Q.PRIOR)


def test_thresholds_follow_each_group(spark):
    """At the shipped constants sources have cutoffs of their own, from quantiles alone, and keep what is normal in them."""
    import random

    rng = random.Random(1)
    rows = [(i, prose(rng, 80) + " #" * (60 + i % 9 if i % 2 else i % 3), "en", "marked" if i % 2 else "plain", 1) for i in range(400)]
    rows += [(500, prose(rng, 80) + " #" * 60, "en", "rare", 1), (501, prose(rng, 80) + " #" * 60, "en", "plain", 1), (502, prose(rng, 80), "de", None, 1)]
    out = Q.quality_rules(frame(spark, rows)).toPandas()
    for m in Q.MEASURES:
        for lang, source in (("en", "plain"), ("en", "marked"), ("en", "rare"), ("de", None)):
            wide = out[(out.doc_id == 502) if lang == "de" else (out.doc_id != 502)]
            group = wide[wide.source.isna() if source is None else wide.source == source]
            assert np.allclose(group[f"{m}_max"], drawn(group[m], drawn(wide[m], raw(out[m]))), rtol=1e-12), (m, source)
    limit = out.groupby("source").symbol_share_max.first()
    assert 4 * limit["plain"] < limit["marked"] < limit["rare"]  # of few documents: nearly that of all
    assert out[out.source == "marked"].kept.all() and out[(out.source == "plain") & (out.doc_id < 400)].kept.all()
    assert not out[out.doc_id == 501].kept.any()  # what is normal elsewhere goes


def test_group_size_has_no_switch(spark):
    """A group's threshold moves by little with one document more."""
    import random

    rng = random.Random(3)
    every = [(i, prose(rng, 80) + " #" * (i % 5), "en", "big", 1) for i in range(300)] + [(1000 + i, prose(rng, 80) + " #" * 50, "en", "small", 1) for i in range(110)]
    limits = []
    for n in (98, 99, 100, 101, 102):
        out = Q.quality_rules(frame(spark, every[: 300 + n])).toPandas()
        limits.append(out[out.source == "small"].symbol_share_max.iloc[0])
    assert np.abs(np.diff(limits)).max() < 0.02 * np.mean(limits)


def test_junk_goes_and_clean_texts_stay(spark):
    import random

    rng = random.Random(2)
    rows = [(i, prose(rng, 90), "en", f"s{i % 3}", 1) for i in range(240)]
    junk = [(1000 + i, t, "en", "s0", 1) for i, t in enumerate([prose(rng, 90).replace(" ", "%%% "), prose(rng, 90).upper().replace(" ", "!! "), "spam spam eggs " * 40, "\n".join(["one two three four five six"] * 20), "short"])]
    out = {r.doc_id: r.kept for r in Q.quality_rules(frame(spark, rows + junk)).collect()}
    assert all(out[i] for i in range(240)) and not any(out[1000 + i] for i in range(5))


def test_empty_and_repeated(spark):
    assert Q.quality_rules(frame(spark, [])).collect() == []
    rows = [(1, "w " * 60, None, None, None)] * 2 + [(None, None, None, None, None)]
    assert sorted((r.doc_id or 0, r.n_words) for r in Q.quality_rules(frame(spark, rows)).collect()) == [(0, 0), (1, 60), (1, 60)]
