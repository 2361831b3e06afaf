"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, drop


def _checksum(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) for every node of ``links`` (u, v: long), and the table's path.

    ``root`` is the smallest node reachable. Alternates the large-star and
    small-star steps, each a minimum for each node and a join back, until
    every node points at its root; the number of rounds grows with the
    logarithm of the longest path. Only shuffles by key: nothing reaches the
    driver but a count and a checksum. Links of a node to itself and repeated
    links are allowed; no links give no rows.
    """
    spark = links.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one, path = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _checksum(one)
    while seen[0]:
        both = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Dealt out anew, so that the join shuffles both sides itself and a node with many links can be split.
        least = both.groupBy("u").agg(F.min("v").alias("m")).repartition(parts)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).repartition(parts)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        two, to = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = _checksum(two)
        drop(spark, path)
        one, path = two, to
        if now == seen:
            break
        seen = now
    roots = one.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), path
