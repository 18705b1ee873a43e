"""Registry of named queries and their DuckDB oracles.

A query is ``(spark, sf_dir) -> DataFrame``.  ``register`` records it with its
oracle SQL (``None`` for operators SQL cannot express, e.g. the responder).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None):
    def deco(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from evalframe.plans import (  # noqa: F401
        q_assets, q_chat, q_evaluate, q_params, q_task_plans, q_prompts, q_runs, q_scoring, q_sources, q_streaming,
    )
