"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Targets are filled like water: every source gets the same multiple of its
weight, up to ``CAP`` times its size. The mix is a row of slots of equal words.
Slot i stands at the golden-ratio point of i, which is mapped through the
cumulative slots to a source, and takes that source's next block; blocks are
equal runs of words of the source's documents in shuffled order, taken round
and round. A source of a small target has blocks that are shorter, so that its
words, too, come near the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import cut, drop

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
#: Words of a block: the total over SLOTS, from 1 to BLOCK_WORDS, and at most a LEAST_SLOTS-th of the source's target.
SLOTS, BLOCK_WORDS, LEAST_SLOTS = 20_000, 4096, 256
GOLDEN = 0.6180339887498949
#: Parts of a source's shuffled order, and cells of the unit interval that points are joined by.
PARTS, CELLS = 4096, 4096


def source_targets(sized: DataFrame, words: int) -> DataFrame:
    """sid, source, source_size, target, words of a block, blocks, the source's stretch lo to hi of the unit interval, and slots of all.

    ``sized``: source, size. One row for each source, in code point order with null last.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    rows = sizes.withColumn("sid", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(weights, (F.col("sid") % len(WEIGHTS) + 1).cast("int")).cast("long")).withColumn("cap", CAP * F.col("source_size"))
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("sid").asc())
    every = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", left / weight).withColumn("level", F.max("level").over(every))
    rows = rows.withColumn("target", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    block = F.greatest(F.lit(1), F.least(F.lit(words), F.floor(F.col("target") / LEAST_SLOTS))).cast("long")
    rows = rows.withColumn("words", block).withColumn("blocks", F.ceil(F.col("source_size") / F.col("words")))
    # Slots that a source needs: its last block may be shorter than the others.
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    need = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("upto", F.sum(need).over(upto)).withColumn("all", F.max("upto").over(every))
    rows = rows.withColumn("hi", F.when(F.col("all") > 0, F.col("upto") / F.col("all")).otherwise(0.0))
    lo = F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0))
    return rows.select("sid", "source", "source_size", "target", "words", "blocks", lo.alias("lo"), "hi", F.ceil("all").alias("slots"))


def schedule(spark: SparkSession, slots: int, targets: DataFrame) -> DataFrame:
    """sid, rank (from 0, in order of the slots) of each slot: golden-ratio points through the cumulative targets."""
    side = max(512, int(slots**0.5))
    point = F.expr(f"((id + 1) * {GOLDEN}D) % 1.0D")
    points = spark.range(slots).select("id", point.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    last = F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))
    cells = targets.where("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), last)).alias("cell"))
    placed = points.join(cells, "cell").where("u >= lo AND u < hi").select("id", "sid", F.floor(F.col("id") / side).alias("part"))
    counts = placed.groupBy("sid", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("sid", "part").orderBy("id"))
    return placed.withColumn("inside", inside).join(counts, ["sid", "part"]).select("sid", (F.col("before") + F.col("inside") - 1).alias("rank"))


def mix_sources(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, source.

    size is the number of words; sources weigh WEIGHTS in code point order,
    null last, and share all words; no source gets more than CAP times its
    size, the rest being shared anew. taken counts the words the mix takes of
    the document, repeats included, at most CAP times its size; reruns agree.
    Null, empty and blank texts have size 0 and give nothing. Rows with the
    same id and source keep rows of their own; where their sizes differ, the
    smaller comes first. Other columns are not read. An empty table gives none.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized, sized_path = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    words = min(max(1, total // SLOTS), BLOCK_WORDS)
    targets, targets_path = cut(source_targets(sized, words))
    slots = (targets.agg(F.max("slots")).first()[0] or 0) if total else 0

    key = F.md5(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string")))
    rows = sized.withColumn("key", key).withColumn("part", F.conv(F.substring("key", 1, 3), 16, 10).cast("int") % PARTS)
    inside = Window.partitionBy("source", "part").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    rows = rows.withColumn("row", F.row_number().over(inside)).withColumn("start", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    parts = sized.withColumn("key", key).groupBy("source", (F.conv(F.substring("key", 1, 3), 16, 10).cast("int") % PARTS).alias("part")).agg(F.sum("size").alias("n"))
    parts = parts.withColumn("from", F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    parts = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.source", "p.part", "p.from", "t.sid", "t.source_size", "t.target", "t.words")
    rows = rows.alias("r").join(parts.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part")))
    # Tables, so that the places are computed once and no plan holds all: adaptive execution plans what is left anew after every stage, on the driver.
    rows, _ = cut(rows.select("r.doc_id", "r.source", "r.size", "p.part", "r.row", "p.sid", "p.source_size", "p.target", "p.words", (F.col("p.from") + F.col("r.start")).alias("start")))
    drop(spark, sized_path)

    taken = schedule(spark, slots, targets).join(targets.select("sid", "blocks"), "sid").where(F.col("rank") < CAP * F.col("blocks"))
    taken, _ = cut(taken.groupBy("sid", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times")))
    drop(spark, targets_path)
    first, last = F.floor(F.col("start") / F.col("words")), F.floor((F.col("start") + F.col("size") - 1) / F.col("words"))
    spread = rows.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    share = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("words")) - F.greatest("start", F.col("block") * F.col("words"))
    keys = ["sid", "part", "row"]
    got = spread.join(taken, ["sid", "block"]).groupBy(*keys).agg(F.sum(share * F.col("times")).alias("taken"))
    return rows.join(got, keys, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+')) AS BIGINT) AS size FROM documents),
z AS (SELECT least(greatest(CAST(sum(size) // 20000 AS BIGINT), 1), 4096) AS b, CAST(sum(size) AS BIGINT) AS t FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
s1 AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, CAST((SELECT t FROM z) - coalesce(sum(cap) OVER w, 0) AS DOUBLE) / CAST((SELECT sum(weight) FROM s1) - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS lev
  FROM s1 WINDOW w AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, least((SELECT max(lev) FROM s2) * weight, CAST(cap AS DOUBLE)) AS target FROM s2),
s4 AS (SELECT *, CAST(ceil(source_size / words) AS BIGINT) AS blocks FROM (SELECT *, greatest(1, least((SELECT b FROM z), CAST(floor(target / 256) AS BIGINT))) AS words FROM s3)),
s5 AS (SELECT *, sum(CASE WHEN source_size > 0 THEN target * blocks / source_size ELSE 0.0::DOUBLE END) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) AS upto FROM s4),
s6 AS (SELECT *, CASE WHEN upto > 0 THEN upto / (SELECT max(upto) FROM s5) ELSE 0 END AS hi FROM s5),
s AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo FROM s6),
p AS (SELECT i, (CAST(i + 1 AS DOUBLE) * CAST(0.6180339887498949 AS DOUBLE)) % CAST(1 AS DOUBLE) AS u FROM (SELECT CAST(ceil(max(upto)) AS BIGINT) AS m FROM s5), unnest(range(m)) AS x(i)),
r AS (SELECT sid, blocks, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS k FROM p JOIN s ON u >= lo AND u < hi),
n AS (SELECT sid, k % blocks AS block, count(*) AS times FROM r WHERE k < 3 * blocks GROUP BY ALL),
o AS (SELECT doc_id, size, sid, source_size, target, words, sum(size) OVER (PARTITION BY sid ORDER BY md5('mix/' || CAST(doc_id AS VARCHAR)), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
e AS (SELECT *, unnest(range(CAST(start // words AS BIGINT), CAST((start + size - 1) // words + 1 AS BIGINT))) AS block FROM o WHERE size > 0),
g AS (SELECT e.doc_id, sum((least(start + size, (block + 1) * words) - greatest(start, block * words)) * times) AS taken FROM e JOIN n USING (sid, block) GROUP BY e.doc_id)
SELECT o.doc_id, o.size, o.source_size, o.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken, s.source FROM o JOIN s USING (sid) LEFT JOIN g USING (doc_id)
"""

QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLES = {"op2_mix_sources": OP2_SQL}
