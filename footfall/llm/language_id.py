"""Language identification with string kernels.

A text's blended spectrum is the set of its byte n-grams of 1 to 4 bytes
(A-Z lowered), hashed to ``DIMS`` presence bits that are kept sparse. Only bits
of the landmarks, ``LANDMARKS`` training texts, are columns; what else a text
holds (hex, base64, other scripts) doesn't count. The kernel of two texts is
the number of columns they share over the root of the product of their column
counts. The landmarks span the Nyström approximation; one ridge regression for
each language against the rest is fitted on it. As a kernel is a sum over
columns, landmarks and regression fold into one weight for each column and
language, and scoring adds up the weights of a text's columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._draw import draw, once
from ._text import LOWER, blocks

DIM_BITS, GRAMS, LANDMARKS, RIDGE = 22, (1, 2, 3, 4), 256, 1e-3
DIMS = 1 << DIM_BITS
#: Distinct training texts of each language; all of a language that has fewer.
SAMPLE = 600
#: Texts whose letters are looked for at once.
ROWS = 512
#: Presence marks (text by column) that scoring holds at once; one text may need more.
MARKS = 1 << 23
UNDETERMINED = "und"


def _grams(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bit) of all n-grams, for each n in turn."""
    data = LOWER[raw]
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    value = np.zeros(len(data), np.uint32)
    for k in GRAMS:
        m = len(data) - k + 1
        if m <= 0:
            break
        value = (value[:m] << np.uint32(8)) | data[k - 1 :]
        bit = ((value + np.uint32(k)) * np.uint32(0x9E3779B1)) ^ np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)
        bit = (bit ^ (bit >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - DIM_BITS)
        same = doc[:m] == doc[k - 1 :]
        yield doc[:m][same], bit[same]


class Spectrum:
    """The presence bits of a text, in order; a sparse vector of 0 and 1."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def sum(self) -> int:
        return len(self.bits)

    def __matmul__(self, other: Spectrum) -> int:
        return len(np.intersect1d(self.bits, other.bits, assume_unique=True))


def spectra(raw: np.ndarray, at: np.ndarray) -> list[Spectrum]:
    """The spectrum of each text."""
    keys = [(doc.astype(np.uint64) << np.uint64(DIM_BITS)) | bit for doc, bit in _grams(raw, at)]
    keys = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]))
    cut = np.searchsorted(keys, np.arange(len(at), dtype=np.uint64) << np.uint64(DIM_BITS))
    bits = (keys & np.uint64(DIMS - 1)).astype(np.uint32)
    return [Spectrum(bits[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


@cache
def _column_of(columns: bytes) -> np.ndarray:
    """The column of each bit, -1 for none."""
    bits = np.frombuffer(columns, np.uint32)
    table = np.full(DIMS, -1, np.int32)
    table[bits] = np.arange(len(bits))
    return table


@dataclass
class Model:
    """The landmarks' bits in order, a weight for each and each language, and the languages."""

    columns: bytes
    weights: np.ndarray
    bias: np.ndarray
    languages: list[str]

    def decide(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Regression values, a row for each text and a column for each language."""
        table, n, width = _column_of(self.columns), len(at) - 1, len(self.weights)
        out = np.zeros((n, len(self.languages)))
        step = max(1, MARKS // width)
        present = np.zeros(min(step, n) * width, bool)
        for lo in range(0, n, step):
            hi = min(lo + step, n)
            for doc, bit in _grams(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]):
                column = table[bit]
                seen = column >= 0
                present[doc[seen].astype(np.int64) * width + column[seen]] = True
            place = np.flatnonzero(present)
            present[place] = False
            cut = np.searchsorted(place, np.arange(hi - lo + 1) * width)
            for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                if a < b:
                    out[lo + i] = self.weights[place[a:b] - i * width].sum(axis=0, dtype=np.float64) / np.sqrt(b - a)
        return out + self.bias


def fit(texts: list[Spectrum], labels: list[str]) -> Model:
    """Nyström landmarks dealt evenly over languages, and one-versus-rest kernel ridge regression."""
    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels])
    turn = np.concatenate([np.arange((y == k).sum()) for k in range(len(names))])
    by_language = np.argsort(y, kind="stable")
    chosen = by_language[np.lexsort((y[by_language], turn))][:LANDMARKS]
    columns = np.unique(np.concatenate([texts[i].bits for i in chosen]))
    table = _column_of.__wrapped__(columns.tobytes())
    rows = [(c := table[t.bits])[c >= 0] for t in texts]
    size = np.maximum(np.sqrt([len(r) for r in rows]), 1)
    mark = np.zeros((len(columns), len(chosen)), np.uint8)
    for j, i in enumerate(chosen):
        mark[rows[i], j] = 1
    scale = 1 / size[chosen]
    cross = np.stack([mark[r].sum(axis=0, dtype=np.int32) for r in rows]) * scale / size[:, None]
    values, vectors = np.linalg.eigh(cross[chosen])
    keep = values > 1e-6 * values.max()
    basis = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.hstack([cross @ basis, np.ones((len(texts), 1))])
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=len(names))[y]
    gram = (phi * weight[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1])
    solved = np.linalg.solve(gram, (phi * weight[:, None]).T @ target)
    folded = scale[:, None] * (basis @ solved[:-1])
    weights = np.concatenate([mark[a : a + 8192] @ folded for a in range(0, len(mark), 8192)]).astype(np.float32)
    return Model(columns.tobytes(), weights, solved[-1], names)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in once(batches):
        for lo, hi, raw, at in blocks(batch.column(1)):
            bits = [x.bits.tobytes() for x in spectra(raw, at)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(bits, pa.binary())], ["lang", "hash", "bits"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of (text, lang), from the ``sample`` distinct texts of each language whose hashes are the least.

    None if no language has a text. Texts without a letter and null
    languages are not learned from; copies count once.
    """
    some = docs.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select(F.col("lang").cast("string").alias("lang"), "text")
    drawn, sizes = draw(some, "lang", sample)
    if not sizes:
        return None
    rows = drawn.mapInArrow(_presence, "lang string, hash long, bits binary").dropDuplicates(["lang", "hash"]).toPandas()
    rows = rows.sort_values(["lang", "hash"])
    return fit([Spectrum(np.frombuffer(b, np.uint32)) for b in rows["bits"]], rows["lang"].tolist())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (0 to 1).

    ``und`` with a score of 0 where the text is null or has no letter, and for
    every text if there is no model. Repeated rows are each returned; only
    doc_id and text are read, and doc_id is only passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo, hi, raw, at in blocks(texts):
                for a in range(0, hi - lo, ROWS):
                    b = min(a + ROWS, hi - lo)
                    letters = np.array([t is not None and any(c.isalpha() for c in t) for t in texts.slice(lo + a, b - a).to_pylist()], bool)
                    langs, score = [UNDETERMINED] * (b - a), np.zeros(b - a)
                    if model is not None and letters.any():
                        p = np.clip((model.decide(raw[at[a] : at[b]], at[a : b + 1] - at[a]) + 1) / 2, 1e-3, 1)
                        best = p.argmax(axis=1)
                        score = np.where(letters, p[np.arange(b - a), best] / p.sum(axis=1), 0.0)
                        langs = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, letters, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo + a, b - a).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
