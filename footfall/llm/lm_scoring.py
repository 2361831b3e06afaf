"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation.

The model predicts a token from the ``CONTEXT`` tokens before it. Each token is
a unit of the output layer: the most frequent ones, and the end of a text, by
themselves, the others by a class of their ending. Every unit has a vector as
context and one as target. The predicted vector is the sum of the context's,
each weighted by a vector of its position, and a unit's score is the product of
its target vector with that, plus a bias. One matrix product scores a batch of
tokens against all units, and normalised over them gives log-probabilities.
Inside a class, seen tokens share the counts of all training texts less a
discount, which goes to the class's unseen tokens (one type for each class, as
the unigram base has one for all).

Training is numpy in minibatches: a token against ``NOISE`` units drawn anew
from the unit frequencies for each batch, weighted as ``RATIO`` a token, by
Adagrad. Each task trains on all its texts from the same start, and the tasks'
parameters are averaged by their tokens, so all training texts are learned
from and what moves is of fixed size a task. A task with few texts repeats them
until it has made ``STEPS`` steps.

Counts cover all training texts. The most frequent tokens, at most
``VOCABULARY``, reach the tasks as a table of bounded size; the others are
joined on their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._draw import most_frequent
from ._store import cut
from ._text import LOWER, SPACE, blocks, mix, words

#: Units: 0 is the end of a text, then TOP frequent tokens, then CLASSES classes of endings (a class is 1 to CLASSES).
TOP, CLASSES = 320, 191
UNITS = 1 + TOP + CLASSES
CONTEXT, RANK = 4, 32
#: Tokens of a minibatch, noise units drawn for it, noise a token that they stand for, steps a task makes at least, and its rate.
BATCH, NOISE, RATIO, STEPS, RATE = 1024, 128, 20.0, 1000, 0.1
#: Tokens that reach every task as a table.
VOCABULARY = 400_000
#: Distinct tokens a task counts before it passes them on.
HELD = 1_500_000
#: Tokens scored at once, by products of scores and by tables of their exponentials.
ROWS, FACTORED = 512, 128
#: Columns of a target vector, its bias and a zero (an even number); vectors of a line and tokens of a part, in which a minibatch is worked on.
WIDE, LINE, PART = RANK + 2, 32, 512
_MASK = np.uint64(255)


def keys_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token key with the ending's class in its low bits, text, first token of each text and the end)."""
    w = words(raw, at, SPACE)
    if not len(w.hash):
        return w.hash, w.doc, w.first
    data = LOWER[raw]
    before = np.where(w.end - w.start > 1, data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    ending = data[w.end - 1].astype(np.uint64) + (before << np.uint64(8))
    return (w.hash & ~_MASK) | (np.uint64(1) + mix(ending + np.uint64(1)) % np.uint64(CLASSES)), w.doc, w.first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of token keys; key 0 counts texts."""
    texts = 0
    held_keys: list[np.ndarray] = []
    held_counts: list[np.ndarray] = []

    def rows(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(key), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + (1 << 18)].view(np.int64)), pa.array(n[lo : lo + (1 << 18)])], ["key", "c"])

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k, at = np.unique(np.concatenate(held_keys), return_inverse=True)
        return k, np.bincount(at, np.concatenate(held_counts), len(k)).astype(np.int64)

    for batch in batches:
        for lo, hi, raw, at in blocks(batch.column(0)):
            texts += hi - lo
            k, n = np.unique(keys_of(raw, at)[0], return_counts=True)
            held_keys.append(k)
            held_counts.append(n)
            if sum(map(len, held_keys)) > 2 * HELD:
                k, n = merged()
                if len(k) > HELD:
                    yield from rows(k, n)
                    held_keys, held_counts = [], []
                else:
                    held_keys, held_counts = [k], [n]
    if held_keys:
        yield from rows(*merged())
    yield from rows(np.zeros(1, np.uint64), np.array([texts]))


@dataclass
class Network:
    """The parameters, and the most frequent tokens (in order) that are units by themselves."""

    top: np.ndarray
    context: np.ndarray  # UNITS x RANK
    target: np.ndarray  # UNITS x RANK
    position: np.ndarray  # CONTEXT x RANK
    bias: np.ndarray
    noise: np.ndarray  # frequencies of units, which sum to 1

    @classmethod
    def start(cls, top: np.ndarray, counts: np.ndarray) -> Network:
        rng = np.random.default_rng(4)
        noise = (counts + 0.5) / (counts + 0.5).sum()
        vectors = [rng.normal(0, 0.1, (UNITS, RANK)).astype(np.float32) for _ in range(2)]
        return cls(top, *vectors, np.full((CONTEXT, RANK), 1 / CONTEXT, np.float32), np.log(noise).astype(np.float32), noise)

    def sequence(self, key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, unit, units before) of every token of n texts, ends included; before a text stand ends."""
        unit = TOP + (key & _MASK).astype(np.int64)
        if len(self.top):
            place = np.minimum(np.searchsorted(self.top, key), len(self.top) - 1)
            unit = np.where(self.top[place] == key, 1 + place, unit)
        at = np.searchsorted(doc, np.arange(n), "right")
        unit, doc = np.insert(unit, at, 0), np.insert(doc, at, np.arange(n))
        before = np.zeros((len(unit), CONTEXT), np.int32)
        for j in range(1, min(CONTEXT, len(unit) - 1) + 1):
            before[j:, j - 1] = np.where(doc[j:] == doc[:-j], unit[:-j], 0)
        return doc, unit, before

    def predicted(self, before: np.ndarray) -> np.ndarray:
        out = self.context[before[:, 0]] * self.position[0]
        for j in range(1, CONTEXT):
            out += self.context[before[:, j]] * self.position[j]
        return out

    def log10(self, before: np.ndarray, unit: np.ndarray | None = None) -> np.ndarray:
        """log10 P(unit | units before), normalised over all units; a column for each if none is named."""
        if unit is not None and len(before) >= UNITS:
            return self._log10_by_factors(before, unit)
        columns, ones = np.ascontiguousarray(self.target.T), np.ones(UNITS, np.float32)
        out = np.zeros(len(before) if unit is not None else (len(before), UNITS))
        for lo in range(0, len(before), ROWS):
            s = self.predicted(before[lo : lo + ROWS]) @ columns
            s += self.bias
            np.clip(s, -60, 60, out=s)
            own = s.copy() if unit is None else s[np.arange(len(s)), unit[lo : lo + ROWS]]
            np.exp(s, out=s)
            total = np.log(s @ ones)
            out[lo : lo + ROWS] = own - (total[:, None] if unit is None else total)
        return out / np.log(10)

    def _log10_by_factors(self, before: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The same from a table for each position: a score is a sum over positions, so its exponential is a product.

        A table holds the exponentials of every unit's part of all scores, each
        row by its greatest. Where the rows' peaks lie so far apart that the
        products leave 32 bits, the scores are computed as they are.
        """
        parts = [(self.context * p) @ self.target.T for p in self.position]
        parts[0] += self.bias
        for x in parts:
            x -= x.max(axis=1, keepdims=True)
        tables = [np.exp(x) for x in parts]
        # By the two units before: the product of their rows is made once for all tokens after them.
        order, pair, first = _groups(before[:, 0].astype(np.int64) * UNITS + before[:, 1])
        which = np.repeat(np.arange(len(pair)), np.diff(first, append=len(order)))
        last, second = pair // UNITS, pair % UNITS
        rest, by_order = before[order, 2:].T.astype(np.intp), np.empty(len(before), np.float32)
        whole, one = (np.empty((FACTORED, UNITS), np.float32) for _ in range(2))
        for lo in range(0, len(order), FACTORED):
            at = which[lo : lo + FACTORED]
            a, b = whole[: len(at)], one[: len(at)]
            pairs = slice(at[0], at[-1] + 1)
            product = tables[0].take(last[pairs], axis=0)
            product *= tables[1].take(second[pairs], axis=0)
            product.take(at - at[0], axis=0, out=a, mode="clip")
            for j in range(2, CONTEXT):
                tables[j].take(rest[j - 2, lo : lo + FACTORED], axis=0, out=b, mode="clip")
                if j < CONTEXT - 1:
                    a *= b
            np.vecdot(a, b, out=by_order[lo : lo + len(at)])
        total = np.empty_like(by_order)
        total[order] = by_order
        far = np.flatnonzero(total < 1e-25)
        total[far] = 1
        out = sum(x.ravel().take(before[:, j] * UNITS + unit) for j, x in enumerate(parts)).astype(np.float64)
        out = (out - np.log(total)) / np.log(10)
        for lo in range(0, len(far), UNITS - 1):
            some = far[lo : lo + UNITS - 1]
            out[some] = self.log10(before[some], unit[some])
        return out


class Trainer:
    """Noise-contrastive steps on a network of its own, whose target vectors and biases are columns of one table."""

    def __init__(self, start: Network, seed: int):
        self.output = np.zeros((UNITS, WIDE), np.float32)
        self.output[:, :RANK], self.output[:, RANK] = start.target, start.bias
        self.net = Network(start.top, start.context.copy(), self.output[:, :RANK], start.position.copy(), self.output[:, RANK], start.noise)
        self.rng = np.random.default_rng(seed)
        self.cumulated = np.cumsum(start.noise)
        self.log_noise = np.log(RATIO * start.noise).astype(np.float32)
        self.squares = [np.full_like(x, 1e-6) for x in (start.context, self.output, start.position)]
        self.steps = self.tokens = 0
        # Arrays of a step, made once. A column of ones meets the biases.
        self.seen, self.weighed = (np.zeros((CONTEXT, BATCH, RANK), np.float32) for _ in range(2))
        self.plain, self.back = (np.zeros((BATCH, RANK), np.float32) for _ in range(2))
        self.h = np.zeros((BATCH, WIDE), np.float32)
        self.h[:, RANK] = 1
        self.line = np.zeros((CONTEXT, LINE, RANK), np.float32)
        self.odds = np.zeros((PART, NOISE), np.float32)

    def learn(self, unit: np.ndarray, before: np.ndarray) -> None:
        """Minibatches of all tokens given, in a random order."""
        order = self.rng.permutation(len(unit))
        unit, before = unit[order].astype(np.int32), before[order].T
        drawn = self.rng.random((-(-len(order) // BATCH), NOISE))
        drawn = np.minimum(np.searchsorted(self.cumulated, drawn), UNITS - 1).astype(np.int32)
        for k, lo in enumerate(range(0, len(order), BATCH)):
            self._step(unit[lo : lo + BATCH], np.ascontiguousarray(before[:, lo : lo + BATCH]), drawn[k])
        self.tokens += len(order)

    def _adagrad(self, values: np.ndarray, squares: np.ndarray, rows, sums: np.ndarray) -> None:
        gradient = np.zeros_like(values)
        gradient[rows] = sums
        squares += gradient * gradient
        gradient *= RATE
        gradient /= np.sqrt(squares)
        values += gradient

    def _step(self, unit: np.ndarray, before: np.ndarray, drawn: np.ndarray) -> None:
        net, n = self.net, len(unit)
        h, back = self.h[:n], self.back[:n]
        # What has a factor for each position is worked on in lines of many rows, as numpy is slow on short ones.
        for e, b in zip(self.seen, before, strict=True):
            net.context.take(b, axis=0, out=e[:n], mode="clip")
        self.line[:] = net.position[:, None]
        line = self.line.reshape(CONTEXT, -1)
        np.einsum("jkl,jl->kl", _lines(self.seen), line, out=_lines(self.plain))
        h[:, :RANK] = self.plain[:n]
        own, other = self.output.take(unit, axis=0), self.output.take(drawn, axis=0)
        data = np.einsum("ij,ij->i", h, own) - self.log_noise[unit]
        up = 1 / (1 + np.exp(np.clip(data, -30, 30))) / n
        # The gradient of noise is scale / (1 + exp(-score)) = scale / 2 * (1 + tanh(score / 2)).
        scale = -RATIO / NOISE / n
        other[:, RANK] -= self.log_noise[drawn]
        half, other = np.ascontiguousarray(other.T) * 0.5, other[:, :RANK] * (scale / 2)
        total = np.zeros((NOISE, WIDE), np.float32)
        for lo in range(0, n, PART):
            some = h[lo : lo + PART]
            down = np.matmul(some, half, out=self.odds[: len(some)])
            np.tanh(down, out=down)
            down += 1
            np.matmul(down, other, out=back[lo : lo + PART])
            total += down.T @ some
        gradient = np.empty((n + NOISE, WIDE), np.float32)
        np.multiply(up[:, None], h, out=gradient[:n])
        np.multiply(total, scale / 2, out=gradient[n:])
        own *= up[:, None]
        back += own[:, :RANK]
        self.back[n:] = 0
        order, rows, first = _groups(np.concatenate([unit, drawn]))
        by_position = np.einsum("jkl,kl->jl", _lines(self.seen), _lines(self.back)).reshape(CONTEXT, -1, RANK).sum(axis=1)
        place, units, starts = _groups(before.ravel())
        np.multiply(_lines(self.back), line[:, None], out=_lines(self.weighed))
        by_context = self.weighed[:, :n].reshape(-1, RANK).take(place, axis=0)
        self._adagrad(self.output, self.squares[1], rows, _sums(gradient.take(order, axis=0), first))
        self._adagrad(net.context, self.squares[0], units, _sums(by_context, starts))
        self._adagrad(net.position, self.squares[2], slice(None), by_position)
        self.steps += 1


def _lines(x: np.ndarray) -> np.ndarray:
    """The vectors of each BATCH, LINE of them in a row."""
    return x.reshape(*x.shape[:-2], -1, LINE * RANK)


def _sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows from each of ``first`` on; two columns at a time, as the parts of a complex number."""
    return np.add.reduceat(rows.view(np.complex64), first, axis=0).view(np.float32)


def _groups(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by code, the codes that occur, where each begins in that order); a code and its place are sorted as one number of the code's type."""
    bits = len(code).bit_length()
    both = np.sort((code << bits) | np.arange(len(code), dtype=code.dtype))
    order, code = both & ((1 << bits) - 1), both >> bits
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return order, code[first], first


def _train(start: Network):
    """Trains on the texts of a task; rows of (row of the parameters, tokens, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, held = Trainer(start, 4), []
        for batch in batches:
            for lo, hi, raw, at in blocks(batch.column(0)):
                key, doc, _ = keys_of(raw, at)
                _, unit, before = start.sequence(key, doc, hi - lo)
                trainer.learn(unit, before)
                if trainer.steps < STEPS:  # few enough to keep
                    held.append((unit, before))
        tokens = trainer.tokens
        while held and trainer.steps < STEPS:
            for unit, before in held:
                trainer.learn(unit, before)
        if tokens:
            net = trainer.net
            values = [*np.hstack([net.context, net.target, net.bias[:, None]]), *net.position]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array([tokens] * len(values), pa.int64()), pa.array([v.astype(np.float64) for v in values], pa.list_(pa.float64()))], ["row", "n", "values"])

    return run


def fit(texts: DataFrame, start: Network) -> Network:
    """The average of what all tasks learn from the column ``text``, weighted by their tokens."""
    rows = texts.select("text").mapInArrow(_train(start), "row int, n long, values array<double>").select("row", "n", F.posexplode("values").alias("i", "v"))
    mean = rows.groupBy("row", "i").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v")).toArrow()
    if not mean.num_rows:
        return start
    table = np.zeros((UNITS + CONTEXT, 2 * RANK + 1), np.float32)
    table[mean["row"].to_numpy(), mean["i"].to_numpy()] = mean["v"].to_numpy()
    units = table[:UNITS]
    return Network(start.top, units[:, :RANK].copy(), units[:, RANK:-1].copy(), table[UNITS:, :RANK].copy(), units[:, -1].copy(), start.noise)


@dataclass
class Model:
    """What scoring needs of the training texts; all but ``counts`` is of bounded size."""

    counts: DataFrame  # key, c of every training token
    key: np.ndarray  # of common tokens, in order
    c: np.ndarray
    least: int  # count of the common tokens
    net: Network
    total: np.ndarray  # of each class, but for the tokens that are units: tokens, types, discount
    tokens: int  # N, with ends
    types: int  # V, with the end
    texts: int  # ends

    def inside(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each class: log10 of its tokens, its discount, log10 P(an unseen token | class)."""
        n, types, discount = self.total
        size = np.log10(np.maximum(n, 1))
        return size, discount, np.where(n > 0, np.log10(np.maximum(discount * types, 1e-9)) - size, 0.0)


def train(texts: DataFrame) -> Model:
    """A model of the column ``text`` of all rows of ``texts``; null is empty."""
    counted, _ = cut(texts.select("text").mapInArrow(_count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")))
    counts = counted.where("key <> 0")
    ends = counted.where("key = 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    least = most_frequent(counts, "c", VOCABULARY)
    common = counts.where(F.col("c") >= least).toArrow()
    key, c = common["key"].to_numpy().view(np.uint64), common["c"].to_numpy()
    order = np.argsort(key)
    key, c = key[order], c[order]
    first = np.sort(np.lexsort((key, -c))[:TOP])
    is_class = F.col("key").bitwiseAND(F.lit(int(_MASK)))
    one = lambda k: F.count_if(F.col("c") == k)
    sums = np.zeros((4, CLASSES + 1))
    for r in counts.groupBy(is_class.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v"), one(1).alias("once"), one(2).alias("twice")).collect():
        sums[:, r["k"]] = r["n"], r["v"], r["once"], r["twice"]
    tokens, types = int(sums[0].sum()) + ends, int(sums[1].sum()) + (ends > 0)
    mine = (key[first] & _MASK).astype(np.int64)
    for row, value in zip(sums, (c[first], 1, c[first] == 1, c[first] == 2), strict=True):
        np.subtract.at(row, mine, value)
    n, v, once, twice = sums
    discount = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.05), 0.05, 0.95)
    units = np.zeros(UNITS)
    units[0], units[1 : 1 + len(first)], units[1 + TOP :] = ends, c[first], n[1:]
    net = fit(texts, Network.start(key[first], units))
    return Model(counts, key, c, least, net, np.stack([n, v, discount]), tokens, types, ends)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, base_score, score.

    Tokens are words (A-Z lowered) and one end; n_known have a count in
    training. base_score is the smoothed unigram's log10 probability, score the
    model's. Null texts are empty: one token, the end. Repeated rows are each
    returned. Only doc_id and text are read.
    """
    key_table, c_table, net = model.key, model.c, model.net
    size, discount, unseen = model.inside()
    tokens, types, texts = model.tokens, model.types, model.texts
    scale = float(np.log10(tokens + 0.1 * (types + 1)))
    end_base = float(np.log10(texts + 0.1) - scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in blocks(batch.column(1)):
                m = hi - lo
                key, doc, first = keys_of(raw, at)
                whose, unit, before = net.sequence(key, doc, m)
                score = np.bincount(whose, net.log10(before, unit), m)
                # Each distinct key is looked up once, and in order.
                kinds, kind = np.unique(key, return_inverse=True)
                place = np.minimum(np.searchsorted(key_table, kinds), max(0, len(key_table) - 1))
                known = (key_table[place] == kinds)[kind] if len(key_table) else np.zeros(len(key), bool)
                place = place[kind]
                d, c, k = doc[known], c_table[place[known]] if len(key_table) else np.zeros(0), (key[known] & _MASK).astype(np.int64)
                base = np.bincount(d, np.log10(c + 0.1) - scale, m) + end_base
                classed = (unit[np.delete(np.arange(len(unit)), first[1:] + np.arange(m))] > TOP)[known]
                d, c, k = d[classed], c[classed], k[classed]
                score += np.bincount(d, np.log10(c - discount[k]) - size[k], m)
                n_known = np.bincount(doc[known], minlength=m) + (texts > 0)
                ids = batch.column(0).slice(lo, m).cast(pa.int64())
                value = np.array(ids.fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
                cumulated = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key + np.arange(len(key), dtype=np.uint64)), dtype=np.uint64)])
                row = mix(mix(value.view(np.uint64)) + cumulated[first[1:]] - cumulated[first[:-1]]).view(np.int64)
                # A row for the document, whose key has class 0, which no word has; and one for each rare token.
                rare = ~known
                pairs = np.stack([doc[rare].astype(np.uint64), key[rare]], 1) if rare.any() else np.zeros((0, 2), np.uint64)
                order = np.lexsort((pairs[:, 1], pairs[:, 0]))
                pairs = pairs[order]
                new = np.ones(len(pairs), bool)
                new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(pairs)))
                pairs = pairs[starts]
                r = len(pairs)
                none = pa.nulls(r)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([(row.view(np.uint64) & ~_MASK), pairs[:, 1]]).view(np.int64)),
                        pa.array(np.concatenate([row, row[pairs[:, 0].astype(np.int64)]])),
                        pa.array(np.concatenate([np.zeros(m, np.int32), times.astype(np.int32)])),
                        pa.concat_arrays([ids, none.cast(pa.int64())]),
                        pa.concat_arrays([pa.array(np.diff(first) + 1, pa.int64()), none.cast(pa.int64())]),
                        pa.concat_arrays([pa.array(n_known, pa.int64()), none.cast(pa.int64())]),
                        pa.concat_arrays([pa.array(base, pa.float64()), none.cast(pa.float64())]),
                        pa.concat_arrays([pa.array(score, pa.float64()), none.cast(pa.float64())]),
                    ],
                    ["key", "row", "times", "doc_id", "n_tokens", "n_known", "base", "score"],
                )

    schema = "key long, row long, times int, doc_id long, n_tokens long, n_known long, base double, score double"
    parts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, schema)
    joined = parts.join(model.counts.where(F.col("c") < model.least), "key", "left")
    k = (F.col("key").bitwiseAND(F.lit(int(_MASK))) + 1).cast("int")
    look = lambda values: F.element_at(F.lit([float(v) for v in values]), k)
    rare, c = F.col("times"), F.coalesce(F.col("c"), F.lit(0))
    inside = F.when(c > 0, F.log10(c - look(discount)) - look(size)).otherwise(look(unseen))
    own = F.col("n_tokens").isNotNull()
    sums = joined.select(
        "row", "doc_id", "n_tokens",
        F.when(own, F.col("n_known")).otherwise(F.when(c > 0, rare).otherwise(0)).alias("n_known"),
        F.when(own, F.col("base")).otherwise(rare * (F.log10(c + 0.1) - scale)).alias("base"),
        F.when(own, F.col("score")).otherwise(rare * inside).alias("score"),
    ).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.count("n_tokens").alias("copies"), *[F.sum(x).alias(x) for x in ("n_known", "base", "score")])
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", "n_tokens", (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"), (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))


def held_out() -> Column:
    """Whether a text is kept from training: crc32 of its id as text, modulo 10, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    out = score_texts(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
ORACLES: dict[str, str] = {}
