"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import engine_queries, retrieval_queries, routing_queries, state_queries, task_queries, text_queries

ALL = {**text_queries.QUERIES, **retrieval_queries.QUERIES, **state_queries.QUERIES, **routing_queries.QUERIES, **task_queries.QUERIES, **engine_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
