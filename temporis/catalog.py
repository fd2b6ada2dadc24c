"""Every query of the engine proper, and the SQL it equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from temporis.plans import media_queries, relational_queries, source_queries, tool_queries, vector_queries
from temporis.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship", "media_queries", "relational_queries", "source_queries", "tool_queries", "vector_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best clips of the query that clip 0 is."""
    return vector_queries.flagship(spark, sf_dir)
