"""All queries of the core by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.plans import analysis, comparison, evidence, retrieval

MODULES = (retrieval, analysis, evidence, comparison)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.bm25_topk(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
