"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)``, reads the driver tables (directly or
through a fixture view) and returns a DataFrame; nothing is collected. The
oracle SQL restates the same result for DuckDB over the same parquet files.
Modules under ``polyeval.plans.q_*`` register themselves on import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # import for side effects: each module registers its queries
    from polyeval.plans import (  # noqa: F401
        q_scoring, q_text, q_prompts, q_analysis, q_tokens, q_repair, q_joins,
        q_io, q_runner, q_streaming, q_more, q_learned,
    )
    return REGISTRY
