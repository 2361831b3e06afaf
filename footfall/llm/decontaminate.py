"""Benchmark decontamination by winnowed fingerprints.

Words are hashed, ``GRAM`` consecutive words make a k-gram, and of every
``WINDOW`` consecutive k-gram hashes the least is kept (the last of equals).
As ``GRAM + WINDOW - 1 == SPAN``, two texts that share SPAN words share a kept
fingerprint inside them. Both sides become tables of fingerprints, each with
the hash of every SPAN-word window that it was kept for. They are joined on
the fingerprint, a hit is extended over its windows as far as they are equal,
too, and hits that overlap or touch are joined to longer spans. Items of fewer
words than SPAN are whole windows of their own.

Fingerprints of documents whose leading bits no item's has are dropped before
the join, by a bitmap of bounded size. The benchmark's table has one row a
window, with the items that have it, so a passage in many documents and many
items is no product of both. A match needs 128 equal bits of two hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import cut
from ._text import MULTIPLIERS, NON_ALNUM, blocks, gram_hash, mix, words

SPAN, GRAM = 13, 6
WINDOW = SPAN - GRAM + 1
#: Bits of the bitmap: sixteen for each fingerprint of the benchmark, within these bounds (2 ** 26 bits are 8 MB).
LEAST_BITS, MOST_BITS = 16, 26
_SALT = np.uint64(0x5851F42D4C957F2D)
_HIT = pa.struct([("print", pa.int64()), ("window", pa.int64()), ("start", pa.int64()), ("size", pa.int32())])


def winnow(h: np.ndarray, doc: np.ndarray, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word of the k-gram kept, its hash) of each window of texts laid end to end.

    ``doc`` is each word's text; no k-gram and no window spans two texts, and a
    text with fewer than k + w - 1 words has none.
    """
    span = k + w - 1
    i = np.arange(max(0, len(h) - span + 1))
    i = i[doc[i] == doc[i + span - 1]]
    if not len(i):
        return i, i, np.zeros(0, np.uint64)
    g = gram_hash(h, k)
    m = len(g) - w + 1
    best, at = g[w - 1 :].copy(), np.full(m, w - 1, np.int8)
    for j in range(w - 2, -1, -1):
        less = g[j : j + m] < best
        best[less] = g[j : j + m][less]
        at[less] = j
    return i, i + at[i], best[i]


def _window_hash(h: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words from each of ``start``, not those of gram_hash."""
    out = np.zeros(len(start), np.uint64)
    for j in range(n):
        out += mix(h[start + j] ^ _SALT) * MULTIPLIERS[j]
    return mix(out + np.uint64(n))


def fingerprints(h: np.ndarray, doc: np.ndarray, sizes: list[int], maybe: Bitmap | None = None) -> tuple[np.ndarray, ...]:
    """(text, print, window, first word, size) of the windows of SPAN words, and of all runs of each shorter size, whose print may be another's."""
    out = []
    for n in [*sizes, SPAN]:
        if n == SPAN:
            start, _, g = winnow(h, doc)
        else:
            start = np.arange(max(0, len(h) - n + 1))
            start = start[doc[start] == doc[start + n - 1]]
            g = gram_hash(h, n)[start]
        if maybe is not None:
            keep = np.flatnonzero(maybe.has(g))
            start, g = start[keep], g[keep]
        out.append((doc[start], g.view(np.int64), _window_hash(h, start, n).view(np.int64), start, np.full(len(start), n, np.int32)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Bitmap:
    """Which leading bits occur among the benchmark's prints; others are passed over cheaply."""

    def __init__(self, bits: int, cells: np.ndarray):
        self.shift, self.cells = np.uint64(64 - bits), cells

    def has(self, g: np.ndarray) -> np.ndarray:
        at = g >> self.shift
        return (self.cells[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _bitmap(prints: DataFrame, n: int) -> Bitmap:
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(n, 1)))))
    at = F.shiftrightunsigned("print", 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    rows = prints.groupBy(F.shiftrightunsigned(at, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    cells = np.zeros(1 << (bits - 6), np.uint64)
    cells[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Bitmap(bits, cells)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, at in blocks(batch.column(1)):
            w = words(raw, at, NON_ALNUM)
            n = np.diff(w.first)
            doc, g, window, _, size = fingerprints(w.hash, w.doc, sorted(set(n[(n > 0) & (n < SPAN)].tolist())))
            # Of a short item only its whole sequence counts, and of longer ones only whole windows.
            keep = size == np.minimum(n[doc], SPAN)
            doc = doc[keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(g[keep]), pa.array(window[keep]), pa.array(size[keep])], ["item", "print", "window", "size"])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """print, window, size and the sorted item ids of each distinct window of ``benchmark`` (item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    each = items.mapInArrow(_item_windows, "item string, print long, window long, size int")
    return each.groupBy("print", "window", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _scan(sizes: list[int], maybe: Bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in blocks(batch.column(1)):
                w = words(raw, at, NON_ALNUM)
                doc, *cols = fingerprints(w.hash, w.doc, sizes, maybe)
                order = np.argsort(doc, kind="stable")
                doc, (g, window, start, size) = doc[order], (c[order] for c in cols)
                hits = pa.StructArray.from_arrays([pa.array(g), pa.array(window), pa.array(start - w.first[doc], pa.int64()), pa.array(size)], fields=list(_HIT))
                ends = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32())
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), pa.array(np.diff(w.first), pa.int64()), pa.ListArray.from_arrays(ends, hits)], ["doc_id", "t1", "t2", "n_words", "hits"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (ids with an
    occurring window, in order), spans (hit word ranges) and contaminated.

    ``benchmark`` (item_id, text) and ``docs`` may be of any size: both are
    joined as tables of fingerprints. What is found depends on a row's text
    alone, so copies are compared once, and rows with one id or none but
    different texts stay apart. Null and empty texts have no words and are
    clean; null item ids or texts are no items; repeated items count once for
    each distinct id; repeated rows of ``docs`` are each returned; other
    columns are not read.
    """
    windows, _ = cut(benchmark_windows(benchmark))
    sizes = sorted(r["size"] for r in windows.where(F.col("size") < SPAN).select("size").distinct().collect())  # at most SPAN - 1
    maybe = _bitmap(windows, windows.count())
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("t1"), F.xxhash64(F.lit(1), docs["text"]).alias("t2"))
    scanned, _ = cut(base.mapInArrow(_scan(sizes, maybe), "doc_id long, t1 long, t2 long, n_words long, hits array<struct<print:long,window:long,start:long,size:int>>"))
    text = ["t1", "t2"]
    once = scanned.where("size(hits) > 0").select(*text, "hits").dropDuplicates(text).select(*text, F.inline("hits"))
    found, _ = cut(once.join(windows, ["print", "window", "size"]).select(*text, "start", (F.col("start") + F.col("size")).alias("end"), "items"))
    before = Window.partitionBy(*text).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    marked = found.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    marked = marked.withColumn("run", F.sum("new").over(Window.partitionBy(*text).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy(*text, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy(*text).agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    items = found.groupBy(*text).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = scanned.select("doc_id", *text, "n_words").join(spans.join(items, text), text, "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0)), "CAST(array() AS %s)"
    return out.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.coalesce("items", F.expr(none % "array<string>")).alias("items"),
        F.coalesce("spans", F.expr(none % "array<struct<start:long,end:long>>")).alias("spans"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of all ``documents`` by all ``benchmark`` items, as the contract's digest columns."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLES = {"op6_decontaminate": OP6_SQL}
