"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document's measures are one projection over its whole text. Mergeable
quantile sketches of every measure's share are kept for each language and
source; those of a language are the merged ones of its sources, and those of
all documents the merged ones of the languages. A group's threshold is its
85 % quantile plus ``SPREADS`` times the distance to its median. It is drawn
towards the language's as if ``PRIOR`` documents had that one, and the
language's towards that of all in the same way, so small groups lean on more
documents without a limit at which they change. A document goes if a count of
its own is significantly more than its group's threshold allows for its length:
by ``ERRORS`` standard errors. No cutoff of a share is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import cut

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Measured shares: the count, and what it is a share of.
MEASURES = {"symbol_share": ("n_symbols", "word_chars"), "shout_share": ("n_shouts", "word_chars"), "upper_share": ("n_upper", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words")}
#: Clean texts this short have few characters to take shares of.
MIN_WORDS = 50
QUANTILES, SPREADS = (0.5, 0.85), 2.0
#: Documents' worth of the wider group's threshold in each group's own.
PRIOR = 25
#: Standard errors by which a count is above what the threshold allows; of a threshold of 0, its square is the count allowed.
ERRORS = 5.0
#: Of the sketches: exact for groups of up to this many documents, else a rank error of about 2.3 / SKETCH_K.
SKETCH_K = 4096


def repeat_words(words: Column, n: Column) -> Column:
    """Words covered by windows of three words that occur twice or more."""
    bits = F.greatest(F.ceil(F.log2(n + 1)), F.lit(1)).cast("int")
    return F.transform(F.array(F.struct(words.alias("w"), n.alias("n"), bits.alias("b"))), _repeats)[0]


def _repeats(x: Column) -> Column:
    def fold(f, value: Column) -> Column:
        # Names a value once, so that it is evaluated once.
        return F.get(F.transform(F.array(value), f), F.lit(0))

    mask = F.call_function("shiftleft", F.lit(1).cast("long"), x["b"]) - 1

    def keys(w: Column) -> Column:
        # The hash's high bits, and the window's place in as many low bits as places need.
        def one(_, i):
            h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))

        return F.sort_array(F.transform(F.slice(w, F.lit(1), x["n"] - 2), one))

    def places(k: Column) -> Column:
        def high(c):
            return c.bitwiseAND(F.bitwise_not(mask))

        twice = F.filter(k, lambda c, j: (high(F.get(k, j - 1)).eqNullSafe(high(c))) | (high(F.get(k, j + 1)).eqNullSafe(high(c))))
        return F.sort_array(F.transform(twice, lambda c: c.bitwiseAND(mask)))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("sum"))
        step = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.least(F.lit(3).cast("long"), c - acc["last"])).alias("sum"))
        return F.aggregate(p, start, step)["sum"]

    return F.when(x["n"] < 4, F.lit(0).cast("long")).otherwise(fold(lambda k: fold(covered, places(k)), keys(x["w"])))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the contract's counts, and the shares the thresholds are for."""
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), text.alias("text"))
    base = base.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    base = base.withColumn("n_words", F.size("words").cast("long")).withColumn("joined", F.array_join("words", ""))
    base = base.select(
        "doc_id", "lang", "source", "n_words",
        F.char_length("joined").cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words"), F.size("words")).alias("n_repeat_words"),
        F.char_length(F.regexp_replace("joined", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.char_length(F.regexp_replace("joined", "[^!]+", "")).cast("long").alias("n_shouts"),
    )
    return base.select("*", *[(F.col(x) / F.greatest(F.col(n), F.lit(1))).alias(m) for m, (x, n) in MEASURES.items()])


def _raw(sketch: Column) -> Column:
    """A threshold from one sketch."""
    mid, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in QUANTILES)
    return high + F.lit(SPREADS) * (high - mid)


def _drawn(n: Column, own: Column, wider: Column) -> Column:
    return (n * own + F.lit(PRIOR) * wider) / (n + F.lit(PRIOR))


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source and each measure's threshold ``<measure>_max``, from sketches of all documents with words."""
    some = measured.where("n_words > 0")
    group, _ = cut(some.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, SKETCH_K).alias(m) for m in MEASURES]))
    wider = group.groupBy("lang").agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, SKETCH_K).alias(m) for m in MEASURES])
    # One value, so a scalar subquery and no join.
    every = wider.agg(F.struct(*[_raw(F.kll_merge_agg_double(m, SKETCH_K)).alias(m) for m in MEASURES])).scalar()
    wide = wider.withColumn("a", every).select("lang", *[_drawn(F.col("n"), _raw(F.col(m)), F.col(f"a.{m}")).alias(m) for m in MEASURES])
    both = group.alias("g").join(wide.alias("w"), F.col("g.lang").eqNullSafe(F.col("w.lang")))
    return both.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), *[_drawn(F.col("g.n"), _raw(F.col(f"g.{m}")), F.col(f"w.{m}")).alias(f"{m}_max") for m in MEASURES])


def _beyond(m: str) -> Column:
    """Whether a count is more than a threshold allows, by ERRORS standard errors (of a binomial, and of a count of few)."""
    x, n = (F.col(f"m.{c}") for c in MEASURES[m])
    most = F.least(F.col(f"t.{m}_max"), F.lit(1.0))
    return F.coalesce(x > n * most + F.lit(ERRORS) * F.sqrt(n * most * (1 - most)) + F.lit(ERRORS * ERRORS), F.lit(False))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, shares, thresholds, base_failed and kept.

    base_failed: fewer than 50 words, or more than half of them in repeated
    three-word windows. kept: not base_failed and no count beyond its group's
    threshold. Null and empty texts have no words and fail. Null languages and
    sources are groups of their own. Repeated rows are each returned; columns
    but doc_id, text, lang and source are not read. In groups of equal values
    the threshold is that value, drawn to the wider group's.
    """
    measured, _ = cut(measures(docs))
    limits = thresholds(measured)
    joined = measured.alias("m").join(limits.alias("t"), F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source")), "left")
    failed = (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    beyond = F.lit(False)
    for m in MEASURES:
        beyond = beyond | _beyond(m)
    return joined.select("m.*", *[f"t.{m}_max" for m in MEASURES], failed.alias("base_failed"), (~failed & ~beyond).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules over all ``documents``."""
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SHARES = {m: f"{x} / greatest({n}, 1)" for m, (x, n) in MEASURES.items()}


def _raw_sql(m: str) -> str:
    """A threshold in SQL; the sketches are exact for groups of up to SKETCH_K documents."""
    return f"({m}[2] + {SPREADS}::DOUBLE * ({m}[2] - {m}[1]))"


def _quantiles_sql(by: str) -> str:
    by_, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    inner = f"SELECT {by_}count(*) AS n, {', '.join(f'quantile_disc({m}, {list(QUANTILES)}) AS {m}' for m in MEASURES)} FROM m WHERE n_words > 0 {group}"
    return f"SELECT {by_}n, {', '.join(f'{_raw_sql(m)} AS {m}' for m in MEASURES)} FROM ({inner})"


def _drawn_sql(m: str, own: str, wider: str) -> str:
    return f"({own}.n * {own}.{m} + {PRIOR} * {wider}.{m}) / ({own}.n + {PRIOR}) AS {m}"


def _beyond_sql(m: str) -> str:
    x, n = MEASURES[m]
    most = f"least(l.{m}, 1::DOUBLE)"
    return f"coalesce({x} > {n} * {most} + {ERRORS}::DOUBLE * sqrt({n} * {most} * (1 - {most})) + {ERRORS * ERRORS}::DOUBLE, false)"


OP10_SQL = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x{{20}}\x{{09}}-\x{{0D}}]+') AS w FROM documents),
g3 AS (SELECT doc_id, i, w[i:i + 2] AS g FROM t, unnest(range(1, len(w) - 1)) AS x(i)),
g2 AS (SELECT doc_id, i FROM g3 QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g2, range(3) AS y(j) GROUP BY doc_id),
c AS (SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x{{20}}\x{{09}}-\x{{0D}}]')) AS lines,
  coalesce(r.n, 0) AS n_repeat_words, length(regexp_replace(array_to_string(w, ''), '\P{{Lu}}', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts FROM t LEFT JOIN r USING (doc_id)),
k AS (SELECT *, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM c),
m AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _SHARES.items())} FROM k),
g AS ({_quantiles_sql("lang, source")}), w AS ({_quantiles_sql("lang")}), a AS ({_quantiles_sql("")}),
v AS (SELECT w.lang, {', '.join(_drawn_sql(m, "w", "a") for m in MEASURES)} FROM w, a),
l AS (SELECT g.lang, g.source, {', '.join(_drawn_sql(m, "g", "v") for m in MEASURES)} FROM g JOIN v ON g.lang IS NOT DISTINCT FROM v.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({' OR '.join(map(_beyond_sql, MEASURES))}) AS kept
FROM m LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang AND m.source IS NOT DISTINCT FROM l.source
"""

QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": OP10_SQL}
