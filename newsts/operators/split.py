"""Ordered splits and time-series folds (V1-V4).

Folds are a tiny table (one row per fold) joined to rows by row number, so
a fold never copies rows through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, keys: Sequence[str] = (), order_by: str = "Date") -> DataFrame:
    """``rn`` (1-based) and series length ``n``; n comes from a grouped
    count joined back (or a scalar subquery for one series), not from an
    unordered window over the series."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order_by)
    res = df.withColumn("rn", F.row_number().over(w))
    if keys:
        cnt = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return res.join(cnt, on=list(keys), how="inner")
    return res.withColumn("n", df.select(F.count(F.lit(1))).scalar())


def ordered_split(df: DataFrame, r: float = 0.7, val: int = 0, keys: Sequence[str] = (),
                  order_by: str = "Date") -> DataFrame:
    """V1: ``role`` = train for rn ≤ floor(n·r), else test; with ``val`` > 0
    the last ``val`` train rows become ``val``."""
    res = number_rows(df, keys, order_by)
    cut = F.floor(F.col("n") * F.lit(r))
    role = (F.when(F.col("rn") > cut, "test")
             .when(F.col("rn") > cut - val, "val") if val else F.when(F.col("rn") > cut, "test"))
    return res.withColumn("role", role.otherwise("train"))


def time_folds(spark: SparkSession, n: int, k: int = 5, test_size: int | None = None, gap: int = 0) -> DataFrame:
    """V2/V3: fold i = 0..k−1 tests rows [n − (k−i)·ts + 1, … + ts] (1-based
    rn); train = rows up to test_start − 1 − gap.  ts defaults to
    n div (k+1).  A negative gap is rejected."""
    if gap < 0:
        raise ValueError("negative gap lets the train rows overlap the test rows")
    ts = test_size or n // (k + 1)
    rows = [(i, n - (k - i) * ts + 1, n - (k - i) * ts + ts, n - (k - i) * ts - gap) for i in range(k)]
    return spark.createDataFrame(rows, "fold int, test_start int, test_end int, train_end int")


def time_folds_df(lengths: DataFrame, k: int = 5, test_size: int | None = None, gap: int = 0,
                  keys: Sequence[str] = ()) -> DataFrame:
    """V2 for many series at once: ``lengths`` holds (keys…, n)."""
    if gap < 0:
        raise ValueError("negative gap lets the train rows overlap the test rows")
    ts = F.lit(test_size) if test_size else F.floor(F.col("n") / (k + 1)).cast("int")
    f = lengths.select(*keys, "n", ts.alias("ts"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    start = F.col("n") - (F.lit(k) - F.col("fold")) * F.col("ts") + 1
    return f.select(*keys, "fold", start.cast("int").alias("test_start"),
                    (start + F.col("ts") - 1).cast("int").alias("test_end"),
                    (start - 1 - gap).cast("int").alias("train_end"))


def assign_folds(df: DataFrame, folds: DataFrame, keys: Sequence[str] = (), rn: str = "rn") -> DataFrame:
    """Label each row with the fold whose test range holds it (ranges are
    disjoint).  Equi-join on an exploded rn list of the test ranges."""
    t = folds.select(*keys, "fold", F.explode(F.sequence("test_start", "test_end")).alias(rn))
    return df.join(t, on=[*keys, rn], how="left")


def repeated_folds(df: DataFrame, k: int = 3, repeats: int = 10, seed: int = 42, id_col: str = "rn") -> DataFrame:
    """V4: repeated random k-fold with folds of equal size (± 1): in each
    repeat the rows are ordered by a hash of (id, repeat, seed) and cut into
    ``k`` tiles — deterministic (different RNG from the reference, declared)."""
    reps = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    res = df.withColumn("repeat", reps)
    w = Window.partitionBy("repeat").orderBy(F.xxhash64(F.col(id_col), F.col("repeat"), F.lit(seed)), F.col(id_col))
    return res.withColumn("fold", (F.ntile(k).over(w) - 1).cast("int"))
