"""Projections/filters (P), key joins (J), set stacking (U), sort/limit (O).

Joins are key equi-joins; Catalyst picks broadcast hash join only when the
measured side is below ``spark.sql.autoBroadcastJoinThreshold`` and a
sort-merge (or shuffled hash) join otherwise, so no side is broadcast on a
guess.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lagged import q


# P --------------------------------------------------------------------------
def project(df: DataFrame, mapping: dict[str, str] | Sequence[str]) -> DataFrame:
    """Select / reorder / rename (``{old: new}`` keeps the dict order)."""
    if isinstance(mapping, dict):
        return df.select(*[q(o).alias(n) for o, n in mapping.items()])
    return df.select(*[q(c) for c in mapping])


def exclude_value(df: DataFrame, col: str, value) -> DataFrame:
    """Keep rows whose ``col`` is not ``value``; missing values kept
    (null-safe not-equal)."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(value)))


def between_dates(df: DataFrame, a, b, col: str = "Date") -> DataFrame:
    """Both ends inclusive."""
    return df.filter(F.col(col).between(F.lit(a).cast("date"), F.lit(b).cast("date")))


def recent(df: DataFrame, days: int = 10, as_of: Column | None = None, col: str = "ts") -> DataFrame:
    """Rows in ``[as_of - days, as_of]``.  ``as_of`` defaults to
    ``now()``; pass a scalar subquery for reproducible runs."""
    as_of = F.current_timestamp() if as_of is None else as_of
    return df.filter((F.col(col) >= as_of - F.make_dt_interval(F.lit(days))) & (F.col(col) <= as_of))


def points_filter(df: DataFrame, field: str | None = None, tags: dict | None = None,
                  measurement: str | None = None) -> DataFrame:
    """P5: field + tag predicate on a point table."""
    cond = F.lit(True)
    if measurement is not None:
        cond = cond & (F.col("measurement") == measurement)
    if field is not None:
        cond = cond & (F.col("field") == field)
    for k, v in (tags or {}).items():
        cond = cond & (F.col("tags")[k] == v)
    return df.filter(cond)


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any null."""
    return df.dropna("any", subset=list(cols) if cols else None)


def drop_current(df: DataFrame, label: str | None = None) -> DataFrame:
    """Drop columns whose name contains ``(t)`` except the last (label)."""
    cols = df.columns
    label = label or cols[-1]
    return df.select(*[q(c) for c in cols if "(t)" not in c or c == label])


def keep_selected(df: DataFrame, cols: Sequence[str], mask: Sequence[bool], keep=("Date",)) -> DataFrame:
    """Keep the columns whose mask entry is true."""
    chosen = [c for c, m in zip(cols, mask) if m]
    return df.select(*keep, *[q(c) for c in chosen])


def numeric_only(df: DataFrame, keep=("Date",)) -> DataFrame:
    """Drop text / vector columns before aggregation."""
    num = [f.name for f in df.schema.fields
           if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")
           and f.name not in keep]
    return df.select(*keep, *[q(c) for c in num])


def keep_series(df: DataFrame, names: Sequence[str], col: str = "field") -> DataFrame:
    """P10: panel column filter."""
    return df.filter(F.col(col).isin(list(names)))


def align_semi(left: DataFrame, right: DataFrame, on: Sequence[str] | str = "Date") -> DataFrame:
    """Rows of ``left`` whose key exists in ``right``."""
    return left.join(right.select(*([on] if isinstance(on, str) else on)).distinct(), on=on, how="left_semi")


def align_anti(left: DataFrame, right: DataFrame, on="Date") -> DataFrame:
    """Rows of ``left`` whose key is absent from ``right``."""
    return left.join(right.select(*([on] if isinstance(on, str) else on)).distinct(), on=on, how="left_anti")


def align_inner(left: DataFrame, right: DataFrame, on="Date") -> DataFrame:
    """J3."""
    return left.join(right, on=on, how="inner")


def align_outer(left: DataFrame, right: DataFrame, on="Date") -> DataFrame:
    """Full outer join with a coalesced key (``using`` join)."""
    return left.join(right, on=on, how="full")


def columns_outer(dfs: Sequence[DataFrame], on="Date") -> DataFrame:
    """Outer column-align of several daily tables."""
    return functools.reduce(lambda a, b: a.join(b, on=on, how="full"), dfs)


def columns_inner(dfs: Sequence[DataFrame], on="Date") -> DataFrame:
    """N-way inner column-align."""
    return functools.reduce(lambda a, b: a.join(b, on=on, how="inner"), dfs)


def common_keys(left: DataFrame, right: DataFrame, on="Date") -> DataFrame:
    """The key intersection."""
    cols = [on] if isinstance(on, str) else list(on)
    return left.select(*cols).distinct().join(right.select(*cols).distinct(), on=cols, how="inner")


def join_by_id(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Positional zip re-expressed as a join on a real id."""
    return left.join(right, on=id_col, how="inner")


def back_to_rows(rows: DataFrame, daily: DataFrame, on="Date") -> DataFrame:
    """Attach each day's value to the rows of that day.  The daily
    side has one row per key, so it is small next to ``rows``; the planner
    broadcasts it when its measured size allows."""
    return rows.join(daily, on=on, how="left")


def align_predictions(df: DataFrame, preds: DataFrame, offset: int, rn: str = "rn") -> DataFrame:
    """Prediction j belongs to row ``offset + j``; outer-aligned."""
    p = preds.withColumn(rn, F.col("j") + F.lit(offset)).drop("j")
    return df.join(p, on=rn, how="full")


# U --------------------------------------------------------------------------
def stack(*dfs: DataFrame) -> DataFrame:
    """Union by column name; missing columns become null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


# O --------------------------------------------------------------------------
def sort(df: DataFrame, by: Sequence[str] | str, ascending: bool | Sequence[bool] = True) -> DataFrame:
    return df.orderBy(by, ascending=ascending)


def last_n(df: DataFrame, n: int, order_by: str = "Date") -> DataFrame:
    """O3: last n rows by ``order_by`` (TakeOrderedAndProject: each task
    keeps n rows, the driver merges n·tasks)."""
    return df.orderBy(F.col(order_by).desc()).limit(n)


def head_ratio(df: DataFrame, ratio: float, keys=(), order_by: str = "Date") -> DataFrame:
    """First ``floor(n·ratio)`` rows of each series."""
    from .split import number_rows
    res = number_rows(df, keys, order_by)
    return res.filter(F.col("rn") <= F.floor(F.col("n") * F.lit(ratio))).drop("rn", "n")


def top_by(df: DataFrame, col: str, n: int, ascending: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """Top-n rows by ``col`` (a report-sized limit)."""
    c = F.col(col).asc() if ascending else F.col(col).desc()
    return df.orderBy(c, *[F.col(t) for t in tie]).limit(n)


def best_config(df: DataFrame, metrics: Sequence[str] = ("rmse", "mae", "mape"), by: Sequence[str] = (),
                config: Sequence[str] = ("config",)) -> DataFrame:
    """Arg-min configuration by the mean of the metrics (per group)."""
    score = sum((F.col(m) for m in metrics), F.lit(0.0)) / len(metrics)
    s = df.withColumn("_score", score)
    packed = F.struct(*[F.col(c) for c in config], F.col("_score").alias("score"))
    res = s.groupBy(*by).agg(F.min_by(packed, F.struct(F.col("_score"), *[F.col(c) for c in config])).alias("_best"))
    return res.select(*by, "_best.*")
