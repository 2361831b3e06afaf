"""Operators for training-data pipelines over ``documents`` and its side tables.

Nothing outside this subpackage imports it. Each operator has a module with a
general function over DataFrames, a query that applies it to the tables of a
folder (``QUERIES``), and DuckDB SQL where SQL can express it (``ORACLES``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, importance, language_id, license_scan, lm_scoring, near_dedup, quality_rules, source_mix, token_counts, toxicity

MODULES = (license_scan, source_mix, importance, lm_scoring, toxicity, decontaminate, token_counts, language_id, near_dedup, quality_rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the operators, by name."""
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those queries that SQL can express."""
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
