"""Quality by importance resampling over hashed n-gram models.

Words (case kept) and word pairs are hashed to ``BUCKETS`` buckets. A target
model counts them in texts known to be good, a raw model in all texts. A text's
weight is the ratio of its probabilities under both, and the texts kept are a
sample by that weight without replacement: the top k of log weight plus Gumbel
noise, which is drawn from a hash of the id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import cut
from ._text import SPACE, blocks, gram_hash, words

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
PRIOR = 0.5
#: Target texts that the target model is fitted on, those of least hash of the id; the raw model counts all texts.
TARGETS = 20_000
#: Of the search for the k-th key: cells of each round, and rows that are put in order at the end.
CELLS, ORDERED = 2048, 10_000


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and word pair."""
    w = words(raw, at, SPACE, lower=False)
    two = np.flatnonzero(w.doc[:-1] == w.doc[1:]) if len(w.doc) > 1 else np.zeros(0, np.int64)
    shift = np.uint64(64 - BUCKET_BITS)
    return np.concatenate([w.doc, w.doc[two]]), np.concatenate([w.hash, gram_hash(w.hash, 2)[two] if len(two) else np.zeros(0, np.uint64)]) >> shift


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        good = np.array(batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)) == 1
        for lo, hi, raw, at in blocks(batch.column(0)):
            doc, b = grams(raw, at)
            total[0] += np.bincount(b, minlength=BUCKETS)
            total[1] += np.bincount(b[good[lo:hi][doc]], minlength=BUCKETS)
    cells = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[0][cells]), pa.array(total[1][cells])], ["bucket", "raw", "target"])


def log_ratios(texts: DataFrame) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw), from all rows of ``texts`` (text, good: 1 marks target texts)."""
    rows = texts.select("text", F.col("good").cast("int").alias("good")).mapInArrow(_count, "bucket long, raw long, target long")
    table = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    n = np.zeros((2, BUCKETS))
    n[:, table["bucket"].to_numpy()] = table["raw"].to_numpy(), table["target"].to_numpy()
    if not n[1].any():
        return np.zeros(BUCKETS)
    p = (n + PRIOR) / (n.sum(axis=1, keepdims=True) + PRIOR * BUCKETS)
    return np.log(p[1]) - np.log(p[0])


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_grams, log_weight of every row of ``docs``."""
    table = ratios.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in blocks(batch.column(1)):
                doc, b = grams(raw, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(np.bincount(doc, minlength=hi - lo), pa.int64()), pa.array(np.bincount(doc, table[b], hi - lo), pa.float64())],
                    ["doc_id", "n_grams", "log_weight"],
                )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def top_k(rows: DataFrame, k: int, key: str = "key", tie: str = "doc_id") -> DataFrame:
    """``rows`` with a column kept: whether a row is one of the k of largest key.

    Ties go to the smaller id. Narrows the range of the k-th key by counts of
    CELLS cells a round; only the last cell's rows are put in order.
    """
    ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")).first()
    if k <= 0 or not ends["n"]:
        return rows.withColumn("kept", F.lit(False))
    if k >= ends["n"]:
        return rows.withColumn("kept", F.lit(True))
    lo, hi, above, inside = ends["lo"], ends["hi"], 0, ends["n"]
    while inside > ORDERED:
        step = (hi - lo) / CELLS
        if not step or lo + step == lo or hi - step == hi:
            break
        cell = F.least(F.floor((F.col(key) - F.lit(lo)) / F.lit(step)), F.lit(CELLS - 1))
        counts = rows.where(F.col(key).between(lo, hi)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r["cell"]):
            if above + r["n"] >= k:
                lo, hi, inside = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
    edge = rows.where(F.col(key).between(lo, hi))
    order = F.row_number().over(Window.orderBy(F.col(key).desc(), F.col(tie).asc_nulls_last()))
    sure = rows.where(F.col(key) > hi).withColumn("kept", F.lit(True)).unionByName(rows.where(F.col(key) < lo).withColumn("kept", F.lit(False)))
    return sure.unionByName(edge.withColumn("kept", order <= k - above))


def resample(docs: DataFrame, good: DataFrame, share: float | None = None, seed: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_grams, log_weight, key, kept.

    ``good`` (doc_id, good 0, 1 or null) marks the target texts; ``share`` of
    all rows are kept (by default, the share of 1 among the rows marked 0 or
    1; all rows if none is). Null and empty texts have a weight of 1 (log 0).
    Rows marked more than once count as target if any mark is 1. Repeated rows
    have one key, and may fall on both sides of the cut. Without target texts
    all weights are 1.
    """
    marks = good.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("good").cast("int").alias("good")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"))
    if share is None:
        share = marks.where("good IN (0, 1)").agg(F.avg("good")).first()[0]
        share = 1.0 if share is None else share
    marked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    # At most TARGETS ids, so that they can be broadcast and no text is shuffled.
    target = marks.where("good = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGETS).select("doc_id", "good")
    weighed = weigh(docs, log_ratios(marked.join(F.broadcast(target), "doc_id", "left")))
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rows, _ = cut(weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(draw))))
    return top_k(rows, math.floor(share * rows.count() + 0.5))


def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, resampled towards those that ``labels`` call good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("good"))
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)


QUERIES = {"op3_importance": op3_importance}
ORACLES: dict[str, str] = {}
