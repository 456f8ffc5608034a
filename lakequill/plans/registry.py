"""All queries of the library proper, by name, each with the SQL it is held against where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ["q_retrieval", "q_graph", "q_time", "q_resolve", "q_extract", "q_ledger", "q_more", "q_pages", "q_incremental", "q_claims", "q_related", "q_lens", "q_merges", "q_excerpt", "q_references", "q_candidates", "q_health", "q_lint"]


def SQL(text: str) -> str:  # noqa: N802
    """Marks a string as SQL of the other engine."""
    return text


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    """Registers ``f(spark, sf_dir)`` under ``name``."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def tbl(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"lakequill.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
