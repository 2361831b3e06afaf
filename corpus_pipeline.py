"""Corpus preparation in stages, each read from and written to Parquet.

Every stage works on all that the one before it kept. All but the last return
the columns of ``documents``; documents with a null id, which no stage could
tell apart, go at the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import language_id
from footfall.llm._store import cut
from footfall.llm.decontaminate import contamination
from footfall.llm.near_dedup import near_duplicates
from footfall.llm.quality_rules import quality_rules
from footfall.llm.source_mix import mix_sources

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is among ``ids``."""
    return docs.join(ids.select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter in the text) go; a null lang becomes the one found, if there is any to learn."""
    model = language_id.train(docs.where(~language_id.held_out()))
    if model is None:
        return docs.where("doc_id IS NOT NULL AND text RLIKE '\\\\p{L}'").select(*COLUMNS)
    found = language_id.identify(docs, model).where(F.col("lang_pred") != language_id.UNDETERMINED)
    found = found.groupBy("doc_id").agg(F.min("lang_pred").alias("lang_pred"))
    joined = docs.join(found, "doc_id")
    return joined.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _keep(docs, quality_rules(docs).where("kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, and one row of each id."""
    return _keep(docs, near_duplicates(docs).where("kept")).dropDuplicates(["doc_id"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return _keep(docs, contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("NOT contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminate),
    ("source_mix", mix),
]

#: String kernels and their regression are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = cut(docs)
    return docs
