"""Registry of named queries: name → (Spark builder, DuckDB SQL or None).

A query builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame
over the driver tables.  The SQL text is an independent formulation of
the same result for DuckDB (tables registered as views); ``None`` marks
an operator that SQL cannot express (iterative solvers, streams), which
is tested against a brute-force numpy reference instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # importing the modules fills the registry
    from . import arma_queries, core_queries, text_queries, vector_queries, stats_queries, stream_queries, io_queries, model_queries, service, form_queries  # noqa: F401
    return REGISTRY
