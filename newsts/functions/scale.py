"""Scaling and row arithmetic.

``minmax_fit`` returns a one-row parameter DataFrame (it can be saved with
K7); ``minmax_apply``/``minmax_invert`` read that row once, which runs the
fit, and inline the bounds, so nothing is fitted on the rows being transformed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lagged import q


def minmax_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F11 fit: per-column min and max (fit on the training rows only)."""
    exprs = []
    for c in cols:
        exprs += [F.min(q(c)).cast("double").alias(f"{c}__min"), F.max(q(c)).cast("double").alias(f"{c}__max")]
    return df.agg(*exprs)


def _bounds(params, c: str) -> tuple[Column, Column]:
    """Fitted bounds of one column as literals.  ``params`` is the one-row
    fit result (2 numbers per column, a bounded artefact); it is read once
    per transform, like a fitted Spark ML scaler holds its bounds."""
    row = params if isinstance(params, dict) else params.first().asDict()
    return F.lit(row[f"{c}__min"]).cast("double"), F.lit(row[f"{c}__max"]).cast("double")


def _row(params: DataFrame) -> dict:
    return params.first().asDict()


def minmax_apply(df: DataFrame, params: DataFrame, cols: Sequence[str], lo: float = 0.0, hi: float = 1.0,
                 suffix: str = "") -> DataFrame:
    """F11 transform: (x-min)/(max-min)·(hi-lo)+lo; a constant training
    column has range 1, so it maps to ``lo`` (as scikit-learn does)."""
    row = _row(params)
    out = {}
    for c in cols:
        mn, mx = _bounds(row, c)
        rng = F.when(mx - mn == 0, F.lit(1.0)).otherwise(mx - mn)
        out[c + suffix] = (q(c) - mn) / rng * (hi - lo) + lo
    return df.withColumns(out)


def minmax_invert(df: DataFrame, params: DataFrame, cols: Sequence[str], lo: float = 0.0, hi: float = 1.0,
                  suffix: str = "") -> DataFrame:
    """F11 inverse transform."""
    row = _row(params)
    out = {}
    for c in cols:
        mn, mx = _bounds(row, c)
        rng = F.when(mx - mn == 0, F.lit(1.0)).otherwise(mx - mn)
        out[c + suffix] = (q(c) - lo) / (hi - lo) * rng + mn
    return df.withColumns(out)


def mean_impute(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """nulls replaced by the column mean (of ``fit_on``, default df)."""
    src = fit_on if fit_on is not None else df
    return df.withColumns({c: F.coalesce(q(c), src.select(F.avg(q(c))).scalar()) for c in cols})


def row_sum(cols: Sequence[str]) -> Column:
    """sum across columns (null if any is null, like numpy)."""
    return F.aggregate(F.array(*[q(c) for c in cols]), F.lit(0.0), lambda a, x: a + x)


def undo_diff(pred: Column | str, prev: Column | str) -> Column:
    """prediction of a difference + the previous level."""
    p = F.col(pred) if isinstance(pred, str) else pred
    b = F.col(prev) if isinstance(prev, str) else prev
    return p + b


def cast_all(df: DataFrame, cols: Sequence[str], t: str = "double") -> DataFrame:
    """F15."""
    return df.withColumns({c: q(c).cast(t) for c in cols})


def combined_sentiment(p: Column | str, s: Column | str, mode: str = "service") -> Column:
    """P·(1+S) (service) or P·S (early script)."""
    p = F.col(p) if isinstance(p, str) else p
    s = F.col(s) if isinstance(s, str) else s
    return p * (F.lit(1.0) + s) if mode == "service" else p * s


def shares(arr: Column | str) -> Column:
    """row-normalise an array to shares of its sum."""
    a = F.col(arr) if isinstance(arr, str) else arr
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(a, lambda x: x / total)
