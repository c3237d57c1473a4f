"""Sinks (K1-K9).  Writes are idempotent where the reference relies on a
store's key semantics: keep-first insert (K5) and publish without
rewriting earlier points (K6) are anti-joins against the target, never a
driver-side membership test."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """K1: overwrite a table (no index column exists in Spark)."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def append_table(df: DataFrame, path: str, fmt: str = "parquet", header: bool = False) -> None:
    """K2: append rows (CSV without header, as the reference appends)."""
    w = df.write.mode("append").format(fmt)
    if fmt == "csv":
        w = w.option("header", header)
    w.save(path)


def write_vectors(df: DataFrame, path: str, stamp: bool = False) -> str:
    """K3: vector / feature tables as parquet (``array<float>`` kept);
    optional timestamped folder name."""
    if stamp:
        path = f"{path}_{_dt.datetime.now(_dt.timezone.utc):%Y%m%d%H%M%S}"
    df.write.mode("overwrite").parquet(path)
    return path


def points_long(df: DataFrame, measurement: str, fields: Sequence[str], time_col: str = "Date",
                tags: dict | None = None) -> DataFrame:
    """K4 frame: wide → tagged points (time, measurement, tags, field, value)."""
    long = df.unpivot([time_col], list(fields), "field", "value")
    tag_map = F.create_map(*[x for k, v in (tags or {}).items() for x in (F.lit(k), F.lit(str(v)))]) \
        if tags else F.create_map().cast("map<string,string>")
    return long.select(F.col(time_col), F.lit(measurement).alias("measurement"), tag_map.alias("tags"),
                       "field", F.col("value").cast("double").alias("value"))


def write_points(df: DataFrame, path: str) -> None:
    """K4: append points partitioned by measurement (partition pruning for
    the S6 range/measurement filter)."""
    df.write.mode("append").partitionBy("measurement").parquet(path)


def insert_new(df: DataFrame, target: DataFrame | None, id_col: str = "ID") -> DataFrame:
    """K5 frame: keep-first insert.  Duplicate ids inside the batch keep
    one row (the smallest Date, then text, deterministically); ids
    already in the target are dropped by an anti-join."""
    from pyspark.sql import Window
    w = Window.partitionBy(id_col).orderBy(*[c for c in df.columns if c != id_col])
    first = df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    if target is None:
        return first
    return first.join(target.select(id_col).distinct(), on=id_col, how="left_anti")


def publish_frame(forecasts: DataFrame, published: DataFrame | None, value_col: str = "yhat",
                  last_n: int = 20, hour: int = 22, field: str = "CLC1", kind: str = "forecast",
                  h: int = 1) -> DataFrame:
    """K6 frame: last ``last_n`` forecast days → weekend roll (a rolled day
    that collides keeps the latest source day, as a point store overwrites)
    → anti-join against every published day in the sent range → stamp the
    wall time → point columns with tags (type, h)."""
    last = forecasts.orderBy(F.col("Date").desc()).limit(last_n)
    rolled = last.select(C.roll_weekend("Date").alias("Date"), F.col("Date").alias("_orig"), F.col(value_col).alias("value"))
    dedup = rolled.groupBy("Date").agg(F.max_by("value", "_orig").alias("value"))
    if published is not None:
        dedup = dedup.join(published.select("Date").distinct(), on="Date", how="left_anti")
    return dedup.select(C.at_time("Date", hour).alias("time"), F.lit(kind).alias("type"), F.lit(str(h)).alias("h"),
                        F.lit(field).alias("field"), F.col("value").cast("double").alias("value"))


def publish(df: DataFrame, path: str, published: DataFrame | None, **kw) -> None:
    """K6: append only the new points."""
    publish_frame(df, published, **kw).write.mode("append").parquet(path)


def save_params(params: DataFrame, path: str) -> None:
    """K7: fitted artefacts (scaler bounds, masks, coefficients) are small
    parquet tables; Spark ML models use their own ``save``."""
    params.coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ledger_append(row_df: DataFrame, path: str, description: str = "") -> None:
    """K8: result ledger: time, descriptions, h, mae, rmse, mape, appended; a
    row without one of them gets a null, other columns are not kept."""
    have = {"time": F.current_timestamp(), "descriptions": F.lit(description)}
    kinds = {"h": "int", "mae": "double", "rmse": "double", "mape": "double"}
    for c, kind in kinds.items():
        have[c] = (F.col(c) if c in row_df.columns else F.lit(None)).cast(kind)
    row_df.select(*[e.alias(c) for c, e in have.items()]).write.mode("append").parquet(path)


def write_terms(df: DataFrame, path: str, cols: Sequence[str] = ("term",), sep: str = " ") -> None:
    """K9: vocabulary / id lists / factor rows as text lines."""
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]).alias("value")).write.mode("overwrite").text(path)
