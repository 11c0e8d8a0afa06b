"""All queries of the library and their DuckDB equivalents, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosemill.plans import feature_queries, job_queries, lexical_queries, stat_queries, table_queries, text_queries
from prosemill.plans.base import Query

MODULES = (text_queries, feature_queries, table_queries, lexical_queries, stat_queries, job_queries)


def queries() -> dict[str, Query]:
    return {k: q for m in MODULES for k, q in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.R.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style of the documents by quality label."""
    return queries()["flagship_style_by_quality"](spark, sf_dir)
