import collections
import math
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from footfall.llm import importance, language_id, license_scan, lm_scoring, toxicity
from footfall.llm import token_counts as tokens
from footfall.llm.token_counts import token_counts

from .helpers import corpus, crc, frame, prose, words

SF = "/root/testdata/sf0.01"


# Token counts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_are_the_library_s(spark, name):
    rows = [*corpus(60), *[(2000 + i, t, None, None, None) for i, t in enumerate(["it's  don't\n\n x", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "   ", "x 　y", "ﬁ ǅ 12३"])]]
    path = str(public_tokenizers.path(name))
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        t_ = Tokenizer.from_file(path)
        t_.no_truncation()
        count = lambda t: len(t_.encode(t, add_special_tokens=False).ids)
    for r in token_counts(frame(spark, rows), name).collect():
        text = dict((i, t) for i, t, *_ in rows)[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), count(text), count(text) > 1024)


def test_pre_tokens_are_the_library_s():
    split = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).pre_tokenizer.pre_tokenize_str
    rng = random.Random(1)
    signs = ["a", "s", "t", "re", "ve", "ll", "m", "d", "'", "'", " ", " ", "  ", "\n", "\t", "1", "é", "½", "！", "　", " ", "-", "_", "S", "R", "́", "🙂", "\x1c"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += [f"a{chr(c)}{chr(c)}1{chr(c)}." for c in [*range(0x3000), *range(0xA000, 0xAC00), *range(0x10000, 0x12000)]]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    doc, begin, end, _ = tokens.pre_tokens(raw, at)
    got = [[] for _ in texts]
    for d, a, b in zip(doc, begin, end, strict=True):
        got[d].append(raw[a:b].tobytes().decode())
    assert got == [[t[a:b] for _, (a, b) in split(t)] if t else [] for t in texts]


@pytest.mark.parametrize("head", [0, 30])
def test_rare_pre_tokens_are_joined(spark, monkeypatch, head):
    """Whether few or no pre-tokens reach the tasks as a table, and however often a task starts anew; each is counted once."""
    monkeypatch.setattr(tokens, "HEAD", head)
    monkeypatch.setattr(tokens, "HELD", 20)
    name = "byte_bpe_50k.json"
    rows = corpus(80)
    docs = frame(spark, rows + rows[:5])
    distinct = tokens.distinct_pre_tokens(docs, name).toPandas()
    assert distinct.token.is_unique and distinct.hash.is_unique
    library = Tokenizer.from_file(str(public_tokenizers.path(name)))
    want = sorted((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows + rows[:5])
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts(docs, name).collect()) == want


def test_token_counts_of_nothing(spark):
    assert token_counts(frame(spark, []), "byte_bpe_50k.json").collect() == []


# Language models


@pytest.mark.parametrize("vocabulary", [0, 40, 400_000])
def test_lm_base_and_counts(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(lm_scoring, "VOCABULARY", vocabulary)
    rows = corpus(100)
    docs = frame(spark, rows)
    model = lm_scoring.train(docs.where(~lm_scoring.held_out()))
    tokens = {i: [*words(t), None] for i, t, *_ in rows}
    c = collections.Counter(x for i, w in tokens.items() if crc(i) % 10 for x in w)
    total, kinds = sum(c.values()), len(c)
    assert (model.tokens, model.types) == (total, kinds)
    out = lm_scoring.score_texts(docs, model).collect()
    assert len(out) == len(rows)
    for r in out:
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(w), sum(c[x] > 0 for x in w))
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w), rel=1e-9)
        assert r.score == pytest.approx(brute_score(model, c, w), rel=1e-4)


def brute_score(model, counts, w):
    """log10 P(w) token by token from the model's parameters and the words' own counts."""
    net = model.net

    def key_of(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return int(lm_scoring.keys_of(raw, np.array([0, len(raw)]))[0][0])

    top, keys = {int(k): 1 + i for i, k in enumerate(net.top)}, {x: key_of(x) for x in {*w, *counts} if x is not None}
    unit = lambda x: 0 if x is None else top.get(keys[x], lm_scoring.TOP + (keys[x] & 255))
    inside = collections.defaultdict(dict)
    for x, n in counts.items():
        if x is not None and keys[x] not in top:
            inside[unit(x)][x] = n
    total, before = 0.0, [0] * lm_scoring.CONTEXT
    for x in w:
        h = sum(net.context[b] * net.position[j] for j, b in enumerate(before)).astype(float)
        s = net.target.astype(float) @ h + net.bias
        total += (s[unit(x)] - math.log(np.exp(s).sum())) / math.log(10)
        if unit(x) > lm_scoring.TOP and (seen := inside[unit(x)]):
            once, twice = (sum(n == k for n in seen.values()) for k in (1, 2))
            less = min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.05))
            total += math.log10((seen[x] - less if x in seen else less * len(seen)) / sum(seen.values()))
        before = [unit(x), *before[:-1]]
    return total


def test_lm_is_normalised_and_beats_counts(spark):
    """Probabilities sum to 1, and held-out tokens are likelier than by the unigram base and by smoothed counts of pairs of units."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm_scoring.train(docs.where(~lm_scoring.held_out()))
    net = model.net
    before = np.random.default_rng(1).integers(0, lm_scoring.UNITS, (50, lm_scoring.CONTEXT))
    assert np.allclose((10.0 ** net.log10(before)).sum(axis=1), 1, atol=1e-4)
    n, types, discount = model.total
    size, _, unseen = model.inside()
    # Of each class, seen tokens and its unseen one sum to 1.
    assert np.allclose(((n - discount * types) / 10**size + 10**unseen)[n > 0], 1, atol=1e-6)
    out = lm_scoring.score_texts(docs.where(lm_scoring.held_out()), model).toPandas()
    assert (out.score > out.base_score).mean() > 0.95

    def units(rows):
        text = "".join(rows)
        at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in rows])])
        key, doc, _ = lm_scoring.keys_of(np.frombuffer(text.encode(), np.uint8), at)
        return net.sequence(key, doc, len(rows))[1:]

    learned, held = (units([r.text or "" for r in docs.where(x).select("text").collect()]) for x in (~lm_scoring.held_out(), lm_scoring.held_out()))
    pairs = np.zeros((lm_scoring.UNITS, lm_scoring.UNITS))
    np.add.at(pairs, (learned[1][:, 0], learned[0]), 1)
    smoothed = (pairs + 100 * net.noise) / (pairs.sum(axis=1, keepdims=True) + 100)
    unit, before = held
    assert net.log10(before, unit).mean() > np.log10(smoothed[before[:, 0], unit]).mean() + 0.02


def test_lm_repeated_rows_and_nothing(spark):
    rows = [(1, "a b", None, None, None)] * 3 + [(None, None, None, None, None)]
    docs = frame(spark, rows)
    out = lm_scoring.score_texts(docs, lm_scoring.train(docs)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 1), (1, 3), (1, 3), (1, 3)]
    empty = lm_scoring.train(docs.limit(0))
    assert empty.tokens == 0 and lm_scoring.score_texts(docs, empty).where("n_known = 0").count() == 4
    assert lm_scoring.score_texts(docs.limit(0), empty).count() == 0


def test_nce_finds_the_frequencies_of_pairs():
    rng = np.random.default_rng(1)
    truth = rng.random((4, 4)) ** 3 + 0.05
    truth /= truth.sum(axis=1, keepdims=True)
    before = np.zeros((200_000, lm_scoring.CONTEXT), np.int32)
    before[:, 0] = rng.integers(0, 4, len(before))
    unit = (truth[before[:, 0]].cumsum(axis=1) < rng.random((len(before), 1))).sum(axis=1).clip(0, 3)
    trainer = lm_scoring.Trainer(lm_scoring.Network.start(np.zeros(0, np.uint64), np.bincount(unit, minlength=lm_scoring.UNITS).astype(float)), 1)
    for _ in range(12):
        trainer.learn(unit, before)
    p = 10 ** trainer.net.log10(before[[int((before[:, 0] == k).argmax()) for k in range(4)]])
    assert np.abs(p[:, :4] - truth).max() < 0.03


# Toxicity


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where(~toxicity.held_out()).select("doc_id", "toxic")
    return toxicity.train(docs, docs.select("doc_id", "text").join(labels, "doc_id"))


def test_toxicity_held_out(spark, toxic_model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(toxicity.held_out())
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    x = toxicity.score_toxicity(docs, toxic_model).join(truth, "doc_id").toPandas()
    assert x.score.between(0, 1).all() and ((x.score >= 0.5) == (x.predicted == 1)).all()
    assert x[x.toxic == 1].predicted.mean() > 0.8 and x[x.toxic == 0].predicted.mean() < 0.02


@pytest.mark.parametrize("disguise", ["1d10t", "i d i o t", "i.d.i.o.t", "idiooooot", "IDI0T", "i-d-i-o-t", "id1oooot"])
def test_disguises_are_undone(toxic_model, disguise):
    decoder = toxicity.Decoder(toxic_model.letters)
    raw = np.frombuffer(f"on the and {disguise}, the".encode(), np.uint8)
    assert "idiot" in {decoder.read(s) for _, s in toxicity.disguised(raw, np.array([0, len(raw)]))}


def readings(decoder, span):
    """The greatest log10 probability of each text that some path through the lattice of ``span`` gives."""
    p, spelled = decoder.p, bool(toxicity._SPELLED.fullmatch(span))
    doubles = toxicity._DOUBLE.findall(span)
    code = toxicity._code
    every = [(0.0, "", (0, 0), "")]
    for i, c in enumerate(span):
        drop = toxicity.REPEAT if any(span[j : j + 3] == c * 3 for j in range(max(0, i - 2), i + 1)) else toxicity.DOUBLE if len(doubles) > 2 else toxicity.KEEP
        signs = ([(c, 0.0)] if c.isalpha() else []) + [(o, toxicity.SIGN) for o in toxicity.LEET.get(c, "")]
        more = []
        for cost, text, (a, b), last in every:
            if c in toxicity.JOINTS:
                more.append((cost + toxicity.JOINT, text, (a, b), ""))
            elif not signs:
                more.append((cost + p[a][b][0], text + (c if c.isdigit() else " "), (0, 0), ""))
            for o, extra in signs if c not in toxicity.JOINTS else []:
                more.append((cost + extra + p[a][b][code(o)], text + o, (b, code(o)), o))
                if last == o and not spelled:
                    more.append((cost + drop, text, (a, b), o))
                if spelled and b and len(text) > 2:
                    more.append((cost + extra + toxicity.BREAK + p[a][b][0] + p[0][0][code(o)], text + " " + o, (0, code(o)), o))
        every = more
    best = {}
    for cost, text, (a, b), _ in every:
        best[text] = max(best.get(text, -math.inf), cost + p[a][b][0])
    return best


def test_readings_are_the_best_of_all_paths():
    """Against every path of short lattices, under letter models in which many paths are close."""
    rng = random.Random(8)
    for k in range(400):
        letters = np.random.default_rng(k).dirichlet(np.full(toxicity._ALPHABET, 0.3), (toxicity._ALPHABET, toxicity._ALPHABET))
        decoder = toxicity.Decoder(np.log10(letters + 1e-6))
        if k % 2:
            span = " ".join(rng.choice("ilaos1|!04@$") for _ in range(rng.randrange(3, 9)))
        else:
            span = "".join(rng.choice(["1", "!", "|", "il", "lll", "oo", "0", "a", "é", "-", "2", "%"]) for _ in range(rng.randrange(1, 8)))
        every = readings(decoder, span)
        assert every[decoder.read(span)] == pytest.approx(max(every.values()), abs=1e-9), span


@pytest.mark.parametrize("gap", [" ", "  "])
def test_long_spelled_spans_are_read_whole(toxic_model, gap):
    plain = ["the", "of", "and"] * 40
    for k in range(5, len(plain), 9):
        plain[k] = "idiot"
    span = gap.join(" ".join(w) for w in plain)
    assert len(span) > 3 * 200
    raw = np.frombuffer(span.encode(), np.uint8)
    decoder = toxicity.Decoder(toxic_model.letters)
    found = [decoder.read(s) for _, s in toxicity.disguised(raw, np.array([0, len(raw)]))]
    assert len(found) == 1 and found[0].replace(" ", "") == "".join(plain)
    assert found[0].split(" ").count("idiot") >= 10 and max(map(len, found[0].split(" "))) < 20
    assert toxic_model.score(raw, np.array([0, len(raw)]), decoder)[0] > 0.5


def test_disguised_texts_score_like_plain_ones(toxic_model):
    decoder = toxicity.Decoder(toxic_model.letters)

    def score(*texts):
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        return toxic_model.score(raw, np.cumsum([0] + [len(t.encode()) for t in texts]), decoder)

    clean = "Ofthst the and thoner to of, with the erhe was on it. "
    plain, hidden, fine, none, long = score(clean + "idiot of the moron and stupid scum", clean + "1d1ot of the m0r0n and s t u p i d scuuuum", clean, "", clean * 400)
    assert plain > 0.9 and hidden > 0.9 and fine < 0.1 and none < 0.1 and long < 0.1


def test_toxicity_without_labels(spark):
    docs = frame(spark, corpus(10))
    model = toxicity.train(docs, docs.withColumn("toxic", F.lit(None).cast("int")))
    out = toxicity.score_toxicity(docs, model).collect()
    assert len(out) == 22 and all(0 <= r.score < 0.5 for r in out)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


# Languages


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out()))
    x = language_id.identify(docs.where(language_id.held_out()), model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (x.lang == x.lang_pred).mean() > 0.97 and x.score.between(0, 1).all()


def test_language_of_odd_texts(spark):
    rows = [(i, prose(random.Random(i), 50) if i % 2 else "el ñandú corre " * 8, "a" if i % 2 else "b", None, None) for i in range(20)]
    odd = [(100 + i, t, None, None, None) for i, t in enumerate([None, "", " 12 !!", "x", "ß", "́", "é " * 40_000])]
    docs = frame(spark, rows + odd + odd[:1])
    model = language_id.train(docs)
    assert model.languages == ["a", "b"]
    got = sorted((r.doc_id, r.lang_pred == "und") for r in language_id.identify(docs, model).where("doc_id >= 100").collect())
    assert got == [(100, True), (100, True), (101, True), (102, True), (103, False), (104, False), (105, True), (106, False)]
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(docs.limit(0))).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_training_draws_distinct_texts(spark, monkeypatch):
    rng = random.Random(2)
    some, many = [prose(rng, 30) + " ein" for _ in range(4)], [prose(rng, 30) + " le" for _ in range(50)]
    rows = [(i, t, lang, None, None) for i, (t, lang) in enumerate([(t, "a") for t in some * 500] + [(t, "b") for t in many])]
    drawn, fitted = [], language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda texts, labels: drawn.extend(labels) or fitted(texts, labels))
    for sample in (3, 20):
        drawn.clear()
        assert language_id.train(frame(spark, rows), sample).languages == ["a", "b"]
        assert collections.Counter(drawn) == {"a": min(sample, 4), "b": sample}
    marked = spark.createDataFrame([(t, int(lang == "a")) for _, t, lang, *_ in rows], "text string, toxic int")
    learned = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, toxic, letters, each: learned.append((np.bincount(toxic).tolist(), each[toxic == 0].sum() / each[toxic == 1].sum())))
    toxicity.train(frame(spark, rows), marked, 10)
    assert learned[0][0] == [10, 4] and learned[0][1] == pytest.approx(50 / 4, rel=0.2)


@pytest.fixture(scope="module")
def language_model(spark):
    return language_id.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(~language_id.held_out()))


@pytest.mark.parametrize("size", [20_000, 160_000])
@pytest.mark.parametrize("signs", ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_language_of_long_texts_that_hold_a_block(spark, language_model, signs, size):
    texts = spark.read.parquet(f"{SF}/documents.parquet").where(language_id.held_out()).where("lang IS NOT NULL").select("lang", "text").toPandas()
    rng = random.Random(size)
    block = "".join(rng.choices(signs, k=size))
    rows = [(i, "\n".join(t)[:20_000] + "\n" + block, lang, None, None) for i, (lang, t) in enumerate(texts.groupby("lang")["text"])]
    assert len(rows) > 2
    got = language_id.identify(frame(spark, rows), language_model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, _, lang, *_ in rows}


def test_kernels_are_shared_spectra():
    texts = ["abcabc", "abd", ""]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    x = language_id.spectra(raw, np.array([0, 6, 9, 9]))
    grams = [{t[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)} for t in texts]
    assert [int(r.sum()) for r in x] == [len(g) for g in grams] and int(x[0] @ x[1]) == len(grams[0] & grams[1])


# Importance


def test_importance_keeps_what_is_like_the_target(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = importance.resample(docs, labels.select("doc_id", F.col("quality").alias("good")))
    x = out.join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    share = labels.agg(F.avg("quality")).first()[0]
    assert abs(out.where("kept").count() - share * docs.count()) <= 1
    assert x[x.quality == 1].kept.mean() > 0.95 and x[x.quality == 0].kept.mean() < 0.4


def test_ratios_are_of_counts(spark):
    rows = spark.createDataFrame([("a b a", 1), ("a c", 0), (None, 1), ("a b", None)], "text string, good int")
    ratios = importance.log_ratios(rows)
    raw, good, h = collections.Counter("a b a a.b b.a a c a.c a b a.b".split()), collections.Counter("a b a a.b b.a".split()), {}
    for text in ("a", "b", "c", "a b", "b a", "a c"):
        _, b = importance.grams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        h[text.replace(" ", ".")] = int(b[-1])
    for g, k in h.items():
        want = math.log((good[g] + 0.5) / (5 + 0.5 * importance.BUCKETS)) - math.log((raw[g] + 0.5) / (11 + 0.5 * importance.BUCKETS))
        assert ratios[k] == pytest.approx(want)


@pytest.mark.parametrize("k", [0, 1, 17, 500, 999, 1000, 5000])
def test_top_k(spark, monkeypatch, k):
    monkeypatch.setattr(importance, "ORDERED", 5)
    rng = random.Random(k)
    rows = [(i, rng.choice([rng.gauss(0, 1) ** 5, 0.25])) for i in range(1000)]
    got = {r.doc_id for r in importance.top_k(spark.createDataFrame(rows, "doc_id long, key double"), k).where("kept").collect()}
    assert got == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}


def test_importance_of_nothing(spark):
    docs = frame(spark, corpus(10))
    marks = spark.createDataFrame([], "doc_id long, good int")
    out = importance.resample(docs, marks).collect()
    assert len(out) == 22 and all(r.kept and r.log_weight == 0 for r in out)
    assert importance.resample(docs.limit(0), marks).count() == 0
    assert importance.resample(docs, marks, 0.5).where("kept").count() == 11


# Licences


def test_licences_against_brute_force(spark):
    rng, rows = random.Random(3), corpus(60)
    for i, (_, text) in enumerate(license_scan.TEMPLATES):
        w = text.split(" ")
        if i % 3 == 1 and len(w) > 20:
            w[rng.randrange(len(w))] = "altered"
        if i % 2:
            rows.append((500 + i, f"{prose(rng, 30)}\n{' '.join(w)}\n{prose(rng, 30)}", None, None, None))
        else:
            rows.append((500 + i, "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12)).upper(), None, None, None))
    known = [(license_scan.bigrams(t), n) for n, t in license_scan.TEMPLATES]
    for r in license_scan.license_scan(frame(spark, rows)).collect():
        text = dict((i, t) for i, t, *_ in rows)[r.doc_id] or ""
        units = [u for x in [text, *text.split("\n")] if (u := license_scan.bigrams(x))]
        best = max(((license_scan.dice(u, b), n) for u in units for b, n in known), default=(0, None))
        assert r.dice >= (best[0] if best[0] >= 0.8 else 0) - 1e-12, (r.doc_id, best)
        if r.doc_id >= 500:
            assert r.licence == license_scan.TEMPLATES[r.doc_id - 500][0]
        elif best[0] < 0.8:
            assert r.licence is None and r["matches"] == []


def test_licences_next_to_others_and_inside_lines(spark):
    texts = dict((n, t) for n, t in license_scan.TEMPLATES if len(t) > 250)
    wrap = lambda t: "\n".join(" ".join(t.split(" ")[k : k + 12]) for k in range(0, len(t.split(" ")), 12))
    notice = "Licensed under the MIT License."
    rng = random.Random(5)
    cases = [
        (f"{wrap(texts['MIT'])}\n\n{wrap(texts['BSD-2-Clause'])}", ["BSD-2-Clause", "MIT"], 2),
        (f"{wrap(texts['Apache-2.0'])}\n\n{wrap(texts['MIT'])}", ["Apache-2.0", "MIT"], 2),
        (f"{prose(rng, 40)} {notice} {prose(rng, 40)}", ["MIT"], 1),
        (" ".join(prose(rng, 30) + " " + t for t in texts.values()), sorted(texts), len(texts)),
        (f"{wrap(texts['ISC'])}\n\n{wrap(texts['ISC'].replace('Permission to use', 'Leave to use', 1))}", ["ISC"], 2),
        ("This work is licensed under the GNU General Public License, version 3. SPDX-License-Identifier: GPL-3.0", ["GPL-3.0"], 1),
        (prose(rng, 400), [], 0),
    ]
    rows = [(i, t, None, None, None) for i, (t, _, _) in enumerate(cases)]
    got = {r.doc_id: (list(r.licences), len(r.matches)) for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert got == {i: (names, n) for i, (_, names, n) in enumerate(cases)}


def test_size_bounds_prune_nothing_that_matches():
    rng = random.Random(4)
    table = license_scan.Templates(license_scan.TEMPLATES, 0.8)
    for _ in range(300):
        w = rng.choice(license_scan.TEMPLATES)[1].split(" ")
        unit = license_scan.bigrams(" ".join(w[: rng.randrange(1, len(w) + 1)] + ["x"] * rng.randrange(12)))
        best = max(license_scan.dice(unit, b) for _, _, b in table.all)
        found = table.best(unit)
        assert (found[0] if found else 0) == pytest.approx(best if best >= 0.8 else 0)


def test_licences_of_nothing(spark):
    assert license_scan.license_scan(frame(spark, [])).collect() == []
    rows = [(1, None, None, None, None), (2, "word", None, None, None), (2, "word", None, None, None)]
    assert [(r.licence, r.dice) for r in license_scan.license_scan(frame(spark, rows)).collect()] == [(None, 0.0)] * 3


def test_lm_scores_by_factors():
    """Tables of exponentials give the softmax, also where the positions' peaks lie beyond the range of 32 bits."""
    rng = np.random.default_rng(5)
    net = lm_scoring.Network.start(np.zeros(0, np.uint64), rng.integers(1, 1000, lm_scoring.UNITS).astype(float))
    net.position[:] = 1
    net.context[1:3], net.context[0], net.target[1:3] = 0, 0, 0
    net.context[1, 0], net.context[2, 0], net.target[1, 0], net.target[2, 0] = 28, -28, 1, -1
    net.target[3:, 0] = 0
    before = rng.integers(0, lm_scoring.UNITS, (3000, lm_scoring.CONTEXT)).astype(np.int32)
    before[:700], before[700:1000] = [1, 1, 2, 2], [2, 1, 0, 0]
    unit = rng.integers(0, lm_scoring.UNITS, len(before))
    scores = (net.context.astype(float)[before] * net.position).sum(axis=1) @ net.target.T.astype(float) + net.bias
    want = scores[np.arange(len(unit)), unit] - np.log(np.exp(scores).sum(axis=1))
    assert np.abs(net._log10_by_factors(before, unit) - want / np.log(10)).max() < 1e-4
    assert np.abs(net.log10(before, unit) - net.log10(before)[np.arange(len(unit)), unit]).max() < 1e-4


def plain_learn(net, unit, before):
    """What a trainer does to ``net`` with the tokens given, written as the formulas are."""
    lm, n_all = lm_scoring, len(unit)
    squares = [np.full_like(x, 1e-6) for x in (net.context, net.target, net.position, net.bias)]
    rng = np.random.default_rng(4)
    order, log_noise = rng.permutation(n_all), np.log(lm.RATIO * net.noise).astype(np.float32)

    def adagrad(k, rows, gradient):
        squares[k][rows] += gradient**2
        (net.context, net.target, net.position, net.bias)[k][rows] += lm.RATE * gradient / np.sqrt(squares[k][rows])

    def summed(unit, rows):
        order = np.argsort(unit.astype(np.int16), kind="stable")
        unit = unit[order]
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        return unit[first], np.add.reduceat(rows[order].view(np.complex64), first, axis=0).view(np.float32)

    for lo in range(0, n_all, lm.BATCH):
        u, b = unit[order[lo : lo + lm.BATCH]], before[order[lo : lo + lm.BATCH]]
        n, drawn = len(u), np.minimum(np.searchsorted(np.cumsum(net.noise), rng.random(lm.NOISE)), lm.UNITS - 1)
        seen = [net.context[b[:, j]] for j in range(lm.CONTEXT)]
        h = sum(e * p for e, p in zip(seen, net.position, strict=True))
        own, other = net.target[u], net.target[drawn]
        up = 1 / (1 + np.exp(np.clip((h * own).sum(axis=1) + (net.bias - log_noise)[u], -30, 30))) / n
        down = -np.float32(lm.RATIO / lm.NOISE / n) / (1 + np.exp(-np.clip(h @ other.T + (net.bias - log_noise)[drawn], -30, 30)))
        back = down @ other + up[:, None] * own
        zero = np.zeros((n + lm.NOISE, 1), np.float32)
        gradient = np.hstack([np.concatenate([up[:, None] * h, down.T @ h]), np.concatenate([up, down.sum(axis=0)])[:, None], zero])
        rows, sums = summed(np.concatenate([u, drawn]), gradient)
        units, by_context = summed(b.T.ravel(), (net.position[:, None] * back).reshape(-1, lm.RANK))
        by_position = np.stack([(e * back).sum(axis=0) for e in seen])
        adagrad(1, rows, sums[:, : lm.RANK])
        adagrad(3, rows, sums[:, lm.RANK])
        adagrad(0, units, by_context)
        adagrad(2, slice(None), by_position)


def test_lm_steps_are_the_plain_ones_with_few_new_arrays():
    """The same parameters as by the formulas, also from a short last minibatch; the large arrays of a step are made once."""
    rng = np.random.default_rng(7)
    truth = rng.dirichlet(np.full(lm_scoring.UNITS, 0.1))
    unit = rng.choice(lm_scoring.UNITS, 20 * lm_scoring.BATCH + 77, p=truth)
    before = np.stack([np.roll(unit, j) for j in range(1, lm_scoring.CONTEXT + 1)], 1).astype(np.int32)
    start = lm_scoring.Network.start(np.zeros(0, np.uint64), np.bincount(unit, minlength=lm_scoring.UNITS).astype(float))
    trainer, plain = lm_scoring.Trainer(start, 4), lm_scoring.Trainer(start, 4).net
    trainer.learn(unit, before)
    plain_learn(plain, unit, before)
    for name in ("context", "target", "position", "bias"):
        a, b = getattr(trainer.net, name), getattr(plain, name)
        assert np.abs(a - b).max() < 1e-4 and np.abs(a - getattr(start, name)).max() > 0.1
    tracemalloc.start()
    trainer.learn(unit[: lm_scoring.BATCH], before[: lm_scoring.BATCH])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1_600_000
