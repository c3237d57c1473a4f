"""Aggregations (A1-A3, A8-A11).  All are hash aggregates with a partial
(map-side) stage, so a hot day or key is pre-reduced inside each task
before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lagged import q

_HOW = {"mean": F.avg, "avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min}


def daily(df: DataFrame, cols: Sequence[str], how: str = "mean", by: Sequence[str] = ("Date",),
          keys: Sequence[str] = ()) -> DataFrame:
    """A1-A3: per-day mean / sum / max of numeric columns (names kept)."""
    agg = _HOW[how]
    return df.groupBy(*keys, *by).agg(*[agg(q(c)).alias(c) for c in cols])


def pivot_fields(df: DataFrame, fields: Sequence[str], row_key: str = "Date", field: str = "field",
                 value: str = "value", keys: Sequence[str] = (), how: str = "mean") -> DataFrame:
    """Long → wide with an explicit value list (no distinct job)."""
    return df.groupBy(*keys, row_key).pivot(field, list(fields)).agg(_HOW[how](value))


def unpivot_fields(df: DataFrame, fields: Sequence[str], ids: Sequence[str] = ("Date",),
                   field: str = "field", value: str = "value") -> DataFrame:
    """wide → long (inverse of A8; used by K4)."""
    return df.unpivot(list(ids), list(fields), field, value)


def summarize_folds(df: DataFrame, metrics: Sequence[str], ddof: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Mean and std over folds; ``ddof=0`` population (ML path),
    ``ddof=1`` sample (time-series path)."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    exprs = []
    for m in metrics:
        exprs += [F.avg(m).alias(f"{m}_mean"), sd(m).alias(f"{m}_std")]
    return df.groupBy(*by).agg(*exprs)


def term_counts(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """A10: occurrences per term."""
    return tokens.groupBy(F.col(token_col).alias("term")).agg(F.count(F.lit(1)).alias("cnt"))


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Min / max / mean of every column in one pass (one row)."""
    exprs = []
    for c in cols:
        exprs += [F.min(q(c)).alias(f"{c}__min"), F.max(q(c)).alias(f"{c}__max"), F.avg(q(c)).alias(f"{c}__mean")]
    return df.agg(*exprs)
