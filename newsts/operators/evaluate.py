"""Error metrics and cross-validation (V5-V12).  Metrics are one grouped
aggregate (partial aggregation per task)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gram as G
from . import models as M
from .aggregate import summarize_folds

# fixed value: the floor on |y| used by the usual MAPE definition (float64 eps)
MAPE_EPS = 2.220446049250313e-16


def error_exprs(y: str = "y", yhat: str = "yhat", zero: float | None = None) -> list[Column]:
    """V5/V6/V7 as aggregate expressions.  ``zero`` replaces a zero actual
    in MAPE (V7, 0.01); otherwise |y| is floored at float64 eps."""
    e = F.col(yhat) - F.col(y)
    if zero is None:
        den = F.greatest(F.abs(F.col(y)), F.lit(MAPE_EPS))
    else:
        den = F.abs(F.when(F.col(y) == 0, F.lit(zero)).otherwise(F.col(y)))
    yy = F.when(F.col(y) == 0, F.lit(zero)).otherwise(F.col(y)) if zero is not None else F.col(y)
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(F.col(yhat) - yy) / den).alias("mape"),
            (F.lit(1.0) - F.sum(e * e) / (F.var_pop(F.col(y)) * F.count(F.col(y)))).alias("r2")]


def errors(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = (), zero: float | None = None) -> DataFrame:
    """MAE, RMSE, MAPE, R² per group (rows with a null dropped)."""
    d = df.dropna(subset=[y, yhat])
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *error_exprs(y, yhat, zero))


def scaled_errors(df: DataFrame, params: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """Errors of the label and its prediction rescaled to (0,1) with
    the train scaler of the label."""
    from ..functions.scale import minmax_apply
    s = minmax_apply(df.withColumn(yhat + "__src", F.col(yhat)), params, [y], suffix="__s")
    row = params.first().asDict()
    lo, hi = row[f"{y}__min"], row[f"{y}__max"]
    rng = (hi - lo) or 1.0
    s = s.withColumn(yhat + "__s", (F.col(yhat) - F.lit(lo)) / F.lit(rng))
    return errors(s, y + "__s", yhat + "__s", by)


def cv_linear(df: DataFrame, folds: DataFrame, x_cols: Sequence[str], y: str, kind: str = "ols",
              alpha: float = 1.0, keys: Sequence[str] = (), ddof: int = 0, rn: str = "rn") -> tuple[DataFrame, DataFrame]:
    """V8 for the linear family in one scan: every row is in the block of
    its fold's test range (−1 before the first); within a block the last
    ``gap`` rows, which the next fold must not train on, are a block of their
    own.  Fold f trains on all blocks before its train end: the Grams of the
    blocks, prefix-summed.  Returns (per-fold errors, mean ± std summary).
    There are at most 2·(folds+1) Grams, whatever the row count."""
    keys = list(keys)
    from .split import assign_folds
    lab = assign_folds(df, folds, keys, rn)
    # rows between train_end and test_start of some fold are its gap
    gap = folds.filter(F.col("train_end") + 1 < F.col("test_start")).select(
        *keys, F.col("fold").alias("_gap"), F.explode(F.sequence(F.col("train_end") + 1, F.col("test_start") - 1)).alias(rn))
    # a gap wider than a test range is in the gaps of several folds: the lowest bounds its use
    gap = gap.groupBy(*keys, rn).agg(F.min("_gap").alias("_lo"), F.max("_gap").alias("_hi"))
    blk = (lab.join(gap, on=[*keys, rn], how="left")
           .withColumn("_blk", F.coalesce(F.col("fold"), F.lit(-1)))
           .withColumn("_lo", F.coalesce("_lo", F.lit(-1))).withColumn("_hi", F.coalesce("_hi", F.lit(-2))))
    gb = G.gram(blk, x_cols, y, by=[*keys, "_blk", "_lo", "_hi"])
    # fold f trains on the blocks < f, except the rows in its own gap
    fold_blocks = folds.select(*keys, "fold", F.explode(F.sequence(F.lit(-1), F.col("fold") - 1)).alias("_blk"))
    pairs = fold_blocks.join(gb, on=[*keys, "_blk"], how="inner").filter(~F.col("fold").between(F.col("_lo"), F.col("_hi")))
    train = G.combine(pairs.drop("_blk", "_lo", "_hi"), by=[*keys, "fold"])
    params = M.linear_fit(train, by=[*keys, "fold"], kind=kind, alpha=alpha)
    test = lab.filter(F.col("fold").isNotNull())
    scored = M.linear_apply(test, params, x_cols, by=[*keys, "fold"])
    per_fold = errors(scored, y, "yhat", by=[*keys, "fold"])
    return per_fold, summarize_folds(per_fold, ["mae", "rmse", "mape"], ddof=ddof, by=keys)


def holdout(df: DataFrame, x_cols: Sequence[str], y: str, kind: str = "ols", alpha: float = 1.0,
            role: str = "role") -> DataFrame:
    """Fit on the train role, score the test role (R² etc.)."""
    g = G.gram(df.filter(F.col(role) == "train"), x_cols, y)
    params = M.linear_fit(g, kind=kind, alpha=alpha)
    scored = M.linear_apply(df.filter(F.col(role) == "test"), params, x_cols)
    return errors(scored, y, "yhat")


def walk_forward(df: DataFrame, x_cols: Sequence[str], y: str, keys: Sequence[str] = (), order_by: str = "Date",
                 least: int | None = None, kind: str = "ols", alpha: float = 1.0, out: str = "yhat") -> DataFrame:
    """Each row is forecast by a model refitted on every row before it.

    The products of a row add up to the Gram of all rows before it, so the
    models come from running sums over the series (one window, partial rows
    of (p+1)² numbers) and one small solve per row; nothing is rescanned.
    Rows with fewer than ``least`` rows before them (default p + 2) get no
    forecast."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import Window
    from pyspark.sql import types as T

    from .lagged import q
    keys, p = list(keys), len(x_cols)
    least = least or p + 2
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
    xs = [q(c).cast("double") for c in x_cols]
    run = {f"_s{i}": F.sum(x).over(w) for i, x in enumerate(xs)}
    run |= {f"_p{i}_{j}": F.sum(xs[i] * xs[j]).over(w) for i in range(p) for j in range(i, p)}
    run |= {f"_y{i}": F.sum(x * F.col(y)).over(w) for i, x in enumerate(xs)}
    run |= {"_n": F.count(F.lit(1)).over(w), "_y": F.sum(y).over(w), "_yy": F.sum(F.col(y) * F.col(y)).over(w)}
    d = df.dropna(subset=[*x_cols, y]).withColumns(run)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    names = df.columns

    def solve(it):
        for pdf in it:
            yhat = []
            for r in pdf.to_dict("records"):
                if r["_n"] < least:
                    yhat.append(None)
                    continue
                xx = np.array([[r[f"_p{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
                g = {"n": r["_n"], "sx": np.array([r[f"_s{i}"] for i in range(p)]), "sy": r["_y"], "xx": xx,
                     "xy": np.array([r[f"_y{i}"] for i in range(p)]), "yy": r["_yy"]}
                c, b = M.solve(g, kind, alpha)
                yhat.append(float(c + sum(v * r[x] for v, x in zip(b, x_cols, strict=True))))
            yield pdf[names].assign(**{out: np.array(yhat, dtype=float) if yhat else []})

    return d.mapInPandas(solve, schema).withColumn(out, F.when(~F.isnan(out), F.col(out)))
