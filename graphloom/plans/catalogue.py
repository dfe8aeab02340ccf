"""Named queries over the shared test tables, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import queries_delta, queries_graph, queries_ingest, queries_lookup, queries_service, queries_text, queries_vector
from graphloom.plans.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
MODULES = (queries_vector, queries_graph, queries_lookup, queries_ingest, queries_delta, queries_text, queries_service)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector query: search, traversal, scores and the ranked context."""
    return queries_graph.vector_query_full(spark, sf_dir)
