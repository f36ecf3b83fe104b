"""Registry of checkable queries: name -> (Spark builder, DuckDB SQL or None).

A builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
test tables. The SQL twin computes the same rows on DuckDB; ``None`` marks
stochastic / iterative operators that only get a rows check.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # Importing the modules registers their queries.
    from cairn.plans import (q_basic, q_sessions, q_reports, q_similarity,  # noqa: F401
                             q_counts, q_recommend, q_features, q_models,
                             q_graph, q_catalog, q_streaming, q_sources, q_rules, q_more)
    return REGISTRY
