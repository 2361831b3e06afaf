"""Toxicity of texts, after undoing disguises through a noisy channel.

Tokens that look disguised (leetspeak inside a word, letters spelled apart,
letters repeated) become lattices: each character stands for itself or for the
letters it is often written for, separators may vanish, repeats may shrink. The
best path under a character trigram model of all texts (Viterbi) is the
restored text, whose words count besides the plain ones. A document's score is
a logistic model over the presence of words and word beginnings that the
labels tie to toxicity.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._draw import draw, once
from ._text import LOWER, NON_ALNUM, SPACE, blocks, mix, span_hash, words

#: What a character may be written for (besides itself).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
JOINTS = ".-_*~,/ "
#: Log10 costs of the channel: a letter written as another sign, a joint put in, a letter written three
#: times or more, a letter doubled where many are, a letter doubled by itself.
SIGN, JOINT, REPEAT, DOUBLE, KEEP = -0.5, -0.05, -0.3, -1.0, -9.0
#: A word is this short, so the path of a run of letters may break between words.
BREAK = -1.0
#: Doubled letters count as many or few within so many characters to either side.
NEAR = 200
#: Distinct texts of each label that are learned from; all if there are fewer.
SAMPLE = 12_000
#: Word beginnings of so many bytes are features besides whole words.
BEGINNINGS = (4, 5, 6)
#: Features need this many toxic texts, and so many standard errors over what clean texts have.
LEAST, SIGNIFICANT = 4, 5.0
FEATURE_BITS = 22

_ALPHABET = 28  # 0: edge, 1-26: a-z, 27: any other letter
_ASCII = np.zeros(256, np.uint8)
_ASCII[97:123] = np.arange(1, 27)
_ASCII[128:] = 27
_IS_LEET = np.zeros(256, bool)
_IS_LEET[[ord(c) for c in LEET if ord(c) < 128]] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = True
_IS_LETTER[128:] = True
_DOUBLE = re.compile(r"([^\W\d_])\1")
_THRICE = re.compile(r"([^\W\d_])\1{2,}")
_SPELLED = re.compile(r"(?<![^\W_])[a-z0-9@$!](?:[ .\-_*~,/]{1,2}[a-z0-9@$!]){2,}(?![^\W_])")


def trigram_counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of letter trigrams of the texts' words, each with an edge before and after."""
    code = _ASCII[LOWER[raw]].astype(np.int64)
    code = np.insert(code, at, 0)
    a, b, c = code[:-2], code[1:-1], code[2:]
    use = (b > 0) | ((a == 0) & (c > 0))
    return np.bincount((a * _ALPHABET + b)[use] * _ALPHABET + c[use], minlength=_ALPHABET**3)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_ALPHABET**3, np.int64)
    for batch in batches:
        for _, _, raw, at in blocks(batch.column(0)):
            total += trigram_counts(raw, at)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells])], ["cell", "n"])


def letter_model(docs: DataFrame) -> np.ndarray:
    """log10 P(letter | two before), smoothed, from the texts of all ``docs``; its size is fixed."""
    rows = docs.select("text").mapInArrow(_count_trigrams, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(_ALPHABET**3)
    for r in rows:
        n[r["cell"]] = r["n"]
    n = n.reshape(_ALPHABET, _ALPHABET, _ALPHABET)
    two = n.sum(axis=0) + 0.5
    back = two / two.sum(axis=1, keepdims=True)
    return np.log10((n + 20 * back[None]) / (n.sum(axis=2, keepdims=True) + 20))


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


class Decoder:
    """Best readings of disguised spans under a letter model."""

    def __init__(self, model: np.ndarray):
        self.p = model.tolist()
        self.known: dict[str, str] = {}

    def read(self, span: str) -> str:
        if span not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[span] = self._best(span)
        return self.known[span]

    def _best(self, span: str) -> str:
        p, spelled = self.p, bool(_SPELLED.fullmatch(span))
        doubles = [m.start() for m in _DOUBLE.finditer(span)]
        # A path's text is linked backwards: (the text before, what was put after it), None if empty.
        # Its state: the codes of the last two letters, the last sign, and the text's size up to 3.
        paths: dict[tuple[int, int, str, int], tuple[float, tuple | None]] = {(0, 0, "", 0): (0.0, None)}
        for i, c in enumerate(span):
            many = len(doubles) > 2 and bisect_right(doubles, i + NEAR) - bisect_left(doubles, i - NEAR) > 2
            drop = REPEAT if c * 3 in span[max(0, i - 2) : i + 3] else DOUBLE if many else KEEP
            nexts: dict[tuple[int, int, str, int], tuple[float, tuple | None]] = {}

            def put(a, b, last, size, cost, text, more="", nexts=nexts):
                key = (a, b, last, min(size + len(more), 3))
                if key not in nexts or nexts[key][0] < cost:
                    nexts[key] = (cost, (text, more) if more else text)

            options = [(c, 0.0)] if c.isalpha() else []
            options += [(o, SIGN) for o in LEET.get(c, "")]
            for (a, b, last, size), (cost, text) in paths.items():
                if c in JOINTS:
                    put(a, b, "", size, cost + JOINT, text)
                    continue
                if not options:
                    put(0, 0, "", size, cost + p[a][b][0], text, c if c.isdigit() else " ")
                    continue
                for o, extra in options:
                    if last == o and not spelled:
                        put(a, b, o, size, cost + drop, text)
                    k = _code(o)
                    put(b, k, o, size, cost + extra + p[a][b][k], text, o)
                    if spelled and b and size > 2:
                        put(0, k, o, size, cost + extra + BREAK + p[a][b][0] + p[0][0][k], text, " " + o)
            paths = nexts
        text = max(paths.items(), key=lambda x: x[1][0] + p[x[0][0]][x[0][1]][0])[1][1]
        parts = []
        while text:
            text, more = text
            parts.append(more)
        return "".join(reversed(parts))


def disguised(raw: np.ndarray, at: np.ndarray) -> list[tuple[int, str]]:
    """(text, span) of what looks disguised, in lower case."""
    if not len(raw):
        return []
    data = LOWER[raw]
    w = words(raw, at, SPACE)
    letter, leet = _IS_LETTER[data], _IS_LEET[data]
    nxt, prv = np.zeros(len(data), bool), np.zeros(len(data), bool)
    nxt[:-1], prv[1:] = letter[1:], letter[:-1]
    gap = SPACE[data]
    last = np.ones(len(data), bool)
    last[:-1] = gap[1:]
    odd = leet & (nxt | (prv & last & (data != 33)))
    same = np.zeros(len(data), bool)
    same[1:] = letter[1:] & (data[1:] == data[:-1]) & (data[1:] < 128)
    thrice = same.copy()
    thrice[1:] &= same[:-1]
    thrice[0] = False
    found: list[tuple[int, str]] = []

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[w.end] - total[w.start]

    take = ((count(odd) > 0) & (count(letter) > 0)) | (count(thrice) > 0) | (count(same) >= 3)
    for i in np.flatnonzero(take):
        found.append((int(w.doc[i]), data[w.start[i] : w.end[i]].tobytes().decode("utf-8", "replace").strip(".,;:?!\"'()[]{}")))
    # Letters spelled apart: three or more single signs with joints between them.
    single = ~NON_ALNUM[data] | np.isin(data, (36, 64))
    edge = single.copy()
    edge[1:] &= ~single[:-1]
    edge[:-1] &= ~single[1:]
    places = np.flatnonzero(edge & (data < 128))
    if len(places) > 2:
        near = (places[2:] - places[:-2] <= 6).nonzero()[0]
        done = -1
        for k in near:
            if k <= done:
                continue
            end = k + 2
            while end + 1 < len(places) and places[end + 1] - places[end] <= 3:
                end += 1
            done = end
            d = int(np.searchsorted(at, places[k], "right")) - 1
            span = data[places[k] : min(places[end] + 1, at[d + 1])].tobytes().decode("utf-8", "replace")
            found += [(d, m.group()) for m in _SPELLED.finditer(span)]
    return found


def _beginnings(w, data: np.ndarray) -> list[np.ndarray]:
    out = [w.hash]
    size = w.end - w.start
    for n in BEGINNINGS:
        out.append(np.where(size > n, mix(span_hash(data, w.start, w.start + np.minimum(size, n)) + np.uint64(n)), w.hash))
    return out


def features(raw: np.ndarray, at: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for each word and word beginning, of the plain and the restored text."""
    docs, feats = [], []
    restored = [(d, decoder.read(x)) for d, s in disguised(raw, at) for x in {s, _THRICE.sub(r"\1\1", s)}]
    extra = "".join(t + " " for _, t in restored).encode()
    owner = np.array([d for d, _ in restored], np.int64)
    ends = np.cumsum([len(t.encode()) + 1 for _, t in restored], dtype=np.int64)
    for data, cut, own in ((raw, at, None), (np.frombuffer(extra, np.uint8), np.concatenate([[0], ends]), owner)):
        if not len(data) or len(cut) < 2:
            continue
        w = words(data, cut, NON_ALNUM)
        for f in _beginnings(w, LOWER[data]):
            docs.append(w.doc if own is None else own[w.doc])
            feats.append(f >> np.uint64(64 - FEATURE_BITS))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(feats)


@dataclass
class Model:
    """Letter model, feature weights by id (in order), and the bias."""

    letters: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -2.0

    def score(self, raw: np.ndarray, at: np.ndarray, decoder: Decoder) -> np.ndarray:
        total = np.full(len(at) - 1, self.bias)
        if len(self.ids):
            table = _weight_table(self.ids.tobytes(), self.weights.tobytes())
            doc, f = features(raw, at, decoder)
            hit = table[f] != 0
            pairs = np.unique((doc[hit].astype(np.uint64) << np.uint64(FEATURE_BITS)) | f[hit])
            np.add.at(total, (pairs >> np.uint64(FEATURE_BITS)).astype(np.int64), table[pairs & np.uint64((1 << FEATURE_BITS) - 1)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


@lru_cache(1)
def _weight_table(ids: bytes, weights: bytes) -> np.ndarray:
    table = np.zeros(1 << FEATURE_BITS, np.float32)
    table[np.frombuffer(ids, np.uint64)] = np.frombuffer(weights, np.float64)
    return table


def fit(rows: list[np.ndarray], toxic: np.ndarray, letters: np.ndarray, each: np.ndarray | None = None) -> Model:
    """Logistic regression over the significant features of labelled texts (one id array for each; ``each`` is what one counts)."""
    each = np.ones(len(toxic)) if each is None else each
    positive = int(toxic.sum())
    if not positive or positive == len(toxic):
        return Model(letters, bias=3.0 if positive else -3.0)
    ids, n1 = np.unique(np.concatenate([rows[i] for i in np.flatnonzero(toxic)]), return_counts=True)
    n0 = np.zeros(len(ids), np.int64)
    for i in np.flatnonzero(toxic == 0):  # text by text, as all ids at once would be large
        col = np.minimum(np.searchsorted(ids, rows[i]), len(ids) - 1)
        np.add.at(n0, col[ids[col] == rows[i]], 1)
    total0 = len(toxic) - positive
    p = (n1 + n0) / len(toxic)
    z = (n1 / positive - n0 / total0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / positive + 1 / total0))
    ids = ids[(n1 >= LEAST) & (z >= SIGNIFICANT)]
    if not len(ids):
        return Model(letters, bias=float(np.log(positive / total0)))
    docs, cols = [], []
    for i, row in enumerate(rows):
        col = np.minimum(np.searchsorted(ids, row), len(ids) - 1)
        cols.append(col[ids[col] == row])
        docs.append(np.full(len(cols[-1]), i))
    doc, col = np.concatenate(docs), np.concatenate(cols)
    weight, bias = np.zeros(len(ids)), -2.0
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for step in range(1, 401):
        logit = bias + np.bincount(doc, weight[col], len(toxic))
        gap = each * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic)
        grad = np.append(np.bincount(col, gap[doc], len(ids)) + 0.05 * weight, gap.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    # Only what speaks for toxicity: nothing in a clean text can hide the rest, nor its length.
    return Model(letters, ids.astype(np.uint64), np.maximum(weight, 0), float(bias))


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Letter model of all ``docs``; weights from ``labelled`` (text, toxic).

    Of each label the ``sample`` distinct texts whose hashes are the least are
    learned from. If a label has more, its texts count as much more.
    """
    letters = letter_model(docs)
    some = labelled.where("toxic IN (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic"), *[c for c in labelled.columns if c == "hash"])
    drawn, sizes = draw(some, "toxic", sample)
    if not sizes:
        return Model(letters)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(letters)
        for batch in once(batches):
            for lo, hi, raw, at in blocks(batch.column(1)):
                doc, f = features(raw, at, decoder)
                pairs = np.unique((doc.astype(np.uint64) << np.uint64(FEATURE_BITS)) | f)
                first = np.searchsorted(pairs >> np.uint64(FEATURE_BITS), np.arange(hi - lo + 1, dtype=np.uint64))
                ids = (pairs & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.uint32)
                rows = [ids[first[i] : first[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(rows, pa.binary())], ["toxic", "hash", "ids"])

    rows = drawn.mapInArrow(extract, "toxic int, hash long, ids binary").dropDuplicates(["toxic", "hash"]).drop("hash").toArrow()
    ids = rows["ids"].to_pylist()
    order = sorted(range(len(ids)), key=ids.__getitem__)
    toxic = rows["toxic"].to_numpy()[order].astype(int)
    count = np.bincount(toxic, minlength=2)
    each = np.array([sizes.get(k, 0) / max(count[k], 1) for k in (0, 1)])[toxic]
    return fit([np.frombuffer(ids[i], np.uint32) for i in order], toxic, letters, each / each.mean())


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (1 if score >= 0.5).

    Only the text is looked at; null and empty texts get the score of a text
    without features. Repeated rows are each returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.letters)
        for batch in batches:
            for lo, hi, raw, at in blocks(batch.column(1)):
                score = model.score(raw, at, decoder)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out() -> Column:
    """Whether a document's label is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``, learned from labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", "toxic")
    model = train(docs, docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(labels, "doc_id"))
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
