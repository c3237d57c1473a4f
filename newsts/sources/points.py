"""Time-series point store query (range → measurement → tags → pivot
fields to columns → fixed column order → date key).  Points are stored
partitioned by ``measurement``, so the measurement filter prunes
partitions and the time range is a pushed parquet filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points_wide(points: DataFrame, measurement: str, tags: dict | None, fields: Sequence[str],
                start=None, stop=None, how: str = "mean") -> DataFrame:
    p = points.filter(F.col("measurement") == measurement)
    if start is not None:
        p = p.filter(F.col("time") >= F.lit(start).cast("timestamp"))
    if stop is not None:
        p = p.filter(F.col("time") < F.lit(stop).cast("timestamp"))
    for k, v in (tags or {}).items():
        p = p.filter(F.col("tags")[k] == F.lit(v))
    agg = {"mean": F.avg, "first": F.first, "last": F.last, "max": F.max}[how]
    wide = p.groupBy(F.to_date("time").alias("Date")).pivot("field", list(fields)).agg(agg("value"))
    return wide.select("Date", *fields)
