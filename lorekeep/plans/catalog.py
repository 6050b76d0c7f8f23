"""All queries of the core by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.plans import entity_queries, graph_queries, list_queries, memory_queries, report_queries, search_queries, store_queries
from lorekeep.plans import record_queries as R

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    own = (R.p1_found, R.p1_paths, R.p1_descendants, R.p2_found, R.p2_lifespans, R.p2_records, R.p3_found, R.p3_records, R.p3_entities, R.p3_relationships, R.p3_code)
    return {f.__name__: f for f in own} | list_queries.QUERIES | memory_queries.QUERIES | graph_queries.QUERIES | store_queries.QUERIES | report_queries.QUERIES | search_queries.QUERIES | entity_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return R.SQL | list_queries.SQL | memory_queries.SQL | graph_queries.SQL | store_queries.SQL | report_queries.SQL | search_queries.SQL | entity_queries.SQL
