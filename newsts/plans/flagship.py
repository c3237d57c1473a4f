"""The end-to-end slice (§3.1 in small): daily mean per event type →
linear decay of the drivers → one-row lag matrix → ordered 70/30 split →
linear model fitted on the train Gram → test errors next to the random
walk baseline.

Shuffles: one aggregate on Date (partial per task), then every later step
works on the daily table (one row per day).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..operators import gram as G
from ..operators import lagged as W
from ..operators import models as M
from ..operators.split import ordered_split
from ..sources import tables as S

DRIVERS = ["click", "view", "signup", "error"]
LABEL = "purchase"


def flagship_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = S.events_daily_wide(spark, sf_dir)
    dec = W.linear_decay(daily, DRIVERS + [LABEL])
    feats = [f"Decay_{c}" for c in DRIVERS + [LABEL]]
    sup = W.supervised(dec.select("Date", *feats, LABEL), feats, n_in=1, n_out=0, drop=True)
    xy = sup.join(dec.select("Date", F.col(LABEL).alias("y")), on="Date", how="inner")
    x_cols = [W.lag_name(c, 1) for c in feats]
    split = ordered_split(xy, 0.7)
    g = G.gram(split.filter(F.col("role") == "train"), x_cols, "y")
    params = M.linear_fit(g, kind="ols")
    test = split.filter(F.col("role") == "test")
    lin = M.linear_apply(test, params, x_cols).withColumn("model", F.lit("linear"))
    # random walk: yesterday's label value
    rw_base = M.random_walk(xy.select("Date", "y"), "y")
    rw = test.select("Date", "y").join(rw_base.select("Date", "yhat"), on="Date").withColumn("model", F.lit("random_walk"))
    both = lin.select("model", "Date", "y", "yhat").unionByName(rw.select("model", "Date", "y", "yhat"))
    res = V.errors(both, "y", "yhat", by=["model"])
    return res.select("model", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "mape", "r2")])
