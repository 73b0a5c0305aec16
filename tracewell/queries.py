"""All queries of the library but those of the llm package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.functions import scalar
from tracewell.operators import graph_queries, lineage_queries, relational, report_queries, store_queries
from tracewell.operators.registry import Tables
from tracewell.plans.lineage import column_lineage

REGISTRIES = [relational.REGISTRY, scalar.REGISTRY, graph_queries.REGISTRY, lineage_queries.REGISTRY, store_queries.REGISTRY, report_queries.REGISTRY]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column lineage of an INSERT with a left join, a filter and conditional sums."""
    lineage_queries.views(Tables(spark, sf_dir))
    return column_lineage(spark, lineage_queries.JOIN_FILTER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for r in REGISTRIES for name, f in r.functions.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in REGISTRIES for name, sql in r.sql.items()}
