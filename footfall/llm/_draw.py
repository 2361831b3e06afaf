"""Samples of distinct texts, exactly so many for each value of a column."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAST, _SPAN = -(1 << 63), 1 << 64


def _below(by: str, bounds: dict) -> Column:
    """Whether a row's hash is at most the bound of its value of ``by``."""
    chosen = F.lit(False)
    for value, bound in bounds.items():
        chosen = chosen | ((F.col(by) == value) & (F.col("hash") <= bound))
    return chosen


def draw(rows: DataFrame, by: str, n: int) -> tuple[DataFrame, dict]:
    """The rows of the ``n`` distinct texts with the least hashes of each value of ``by``, and about how many distinct texts each value has.

    Returns ``by``, text and hash. All copies of a drawn text are returned, as
    a hash alone decides; ``once`` leaves one. Of a value with at most n texts
    all are drawn, and their number is exact. Nulls of ``by`` are not drawn.
    Where ``rows`` are a join, give them a column ``hash`` (xxhash64 of the
    text) from before it, so that only drawn texts go through the join.
    """
    joined = "hash" in rows.columns
    rows = rows.where(F.col(by).isNotNull()).select(by, "text", F.col("hash") if joined else F.xxhash64("text").alias("hash"))
    sizes = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.approx_count_distinct("hash").alias("n")).collect()}
    bounds, chosen, open_, factor = {}, set(), dict(sizes), 1.5
    while open_:
        rates = {v: min(1.0, factor * (n + 50) / max(k, 1)) for v, k in open_.items()}
        limits = {v: min(_LEAST + int(rate * _SPAN), -_LEAST - 1) for v, rate in rates.items()}
        found: dict = {v: [] for v in open_}
        for r in rows.where(_below(by, limits)).select(by, "hash").distinct().collect():
            found[r[by]].append(r["hash"])
        for v, hashes in found.items():
            whole = rates[v] == 1.0
            if whole or len(hashes) >= n:
                least = sorted(hashes)[:n]
                bounds[v] = least[-1]
                chosen.update(least)
                if whole:
                    sizes[v] = len(hashes)
                del open_[v]
        factor *= 4
    if joined and chosen:  # a condition on the hash alone is checked before the join
        rows = rows.where(f"hash IN ({','.join(f'{h}L' for h in sorted(chosen))})")
    return rows.where(_below(by, bounds)), sizes


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each (value, hash) of a task, of batches of (value, text, hash)."""
    seen: set = set()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
        new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
        if new:
            yield batch.take(pa.array(new))


def most_frequent(counts: DataFrame, by: str, room: int) -> int:
    """The least count of ``by`` such that at most ``room`` rows have it or more; decided on sixteenths of powers of 2."""
    cells = counts.groupBy(F.floor(F.log2(by) * 16).alias("cell")).agg(F.count("*").alias("n"), F.min(by).alias("least"), F.max(by).alias("most")).collect()
    least = 1 + max((r["most"] for r in cells), default=0)
    for r in sorted(cells, key=lambda r: -r["cell"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["least"]
    return least
