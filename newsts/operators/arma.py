"""ARIMA from one table of lagged product sums.

An order (p, d, q, P, D, Q, m) is fitted by two-stage least squares
(Hannan-Rissanen, declared instead of maximum likelihood): the differenced
series w is regressed on a long AR, whose residuals e are then regressors next
to the lags of w.  Every column of that design is a linear map of the lags of
the raw series, so its Gram follows from the Gram of the raw lags; and that
follows from the sums of z(t)·z(t-k), k = 0..K, and the values at the two ends
of the training rows.  One scan of the series therefore serves any number of
orders, and block sums of the same products serve any number of folds.

Seasonal terms are additive lags at multiples of the season m.  The values z
are the series less its mean, for the sake of the sums' precision only.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .split import time_folds_df

Order = tuple[int, int, int, int, int, int, int]


def order(p: int, d: int = 0, q: int = 0, P: int = 0, D: int = 0, Q: int = 0, m: int = 0) -> Order:
    """An order with its season; without seasonal terms the season is 0."""
    if (P or D or Q) and m < 2:
        raise ValueError("seasonal terms need a season of two rows at least")
    return (p, d, q, P, D, Q, m if P or D or Q else 0)


def long_ar(orders: Sequence[Order]) -> int:
    """Lags of the first stage: one number for all orders of a grid."""
    return max(p + q for p, _, q, *_ in orders) + 5 + max([o[6] for o in orders if o[5]], default=0) if any(o[2] or o[5] for o in orders) else 0


def depth(o: Order, stage: int) -> int:
    """Lags of the raw series that an order's design reaches back."""
    p, d, q, P, D, Q, m = o
    ma = max(q, Q * m)
    return d + D * m + max(p, P * m, ma + stage if ma else 0)


SERIES = "_series"


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A key for the one series of a table without keys."""
    return (df, list(keys)) if keys else (df.withColumn(SERIES, F.lit(0)), [SERIES])


# the table of lagged product sums ---------------------------------------------
def lag_sums(df: DataFrame, y: str, lags: int, cuts: DataFrame, keys: Sequence[str] = (), order_by: str = "Date",
             ahead: int = 0) -> DataFrame:
    """keys, cut, rn (last row), shift, total, sums[0..lags], head, tail, next.

    ``cuts`` has keys and an ascending array ``cuts`` of row numbers.  Up to
    each cut: ``total`` = Σ z, ``sums[k]`` = Σ z(t)·z(t-k); ``tail`` are the last
    lags + 1 values, latest first, ``head`` the first ones, latest first too,
    ``next`` the ``ahead`` values of y that follow.  The rows after the last
    cut end in a row of their own with ``cut`` null.  The products of a block
    are grouped sums; the cuts' are running sums over the blocks.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order_by)
    src = df.select(*keys, order_by, F.col(y).cast("double").alias("y")).filter("y IS NOT NULL AND NOT isnan(y)")
    mean = src.groupBy(*keys).agg(F.avg("y").alias("shift"))
    rows = src.join(mean.join(cuts, keys), keys)
    rows = rows.withColumn("z", F.col("y") - F.col("shift")).withColumn("rn", F.row_number().over(w))
    rows = rows.withColumn("_lag", F.array(*[F.lag("z", k).over(w) if k else F.col("z") for k in range(lags + 1)]))
    rows = rows.withColumn("_next", F.array(*[F.lead("y", k).over(w) for k in range(1, ahead + 1)]) if ahead else F.array().cast("array<double>"))
    rows = rows.withColumn("block", F.size(F.filter("cuts", lambda c: c < F.col("rn"))))
    blocks = rows.groupBy(*keys, "block").agg(
        F.max("rn").alias("rn"), F.first("shift").alias("shift"), F.first("cuts").alias("cuts"), F.sum("z").alias("total"),
        *[F.sum(F.coalesce(F.col("z") * F.col("_lag")[k], F.lit(0.0))).alias(f"_s{k}") for k in range(lags + 1)],
        F.max_by("_lag", "rn").alias("tail"), F.max_by("_next", "rn").alias("next"),
        F.max(F.when(F.col("rn") == lags + 1, F.col("_lag"))).alias("head"))
    upto = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)  # a row for each cut
    run = [F.sum(f"_s{k}").over(upto) for k in range(lags + 1)]
    return blocks.select(*keys, F.get("cuts", F.col("block")).alias("cut"), "rn", "shift", F.sum("total").over(upto).alias("total"),
                         F.array(*run).alias("sums"), F.max("head").over(whole).alias("head"), "tail", "next")


def upto_sums(total: float, sums: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Gram of (1, z(t), z(t-1), ..., z(t-K)) over the rows up to the one whose
    ``tail`` is given, lags before the first row being zero."""
    k = len(sums)
    g = np.zeros((k + 1, k + 1))
    for lag in range(k):
        # z(t-i)·z(t-i-lag) over t: all products less those of the last i rows
        edge = np.concatenate([[0.0], np.cumsum(tail[: k - lag] * tail[lag:])])[: k - lag]
        at = np.arange(k - lag)
        g[1 + at, 1 + at + lag] = g[1 + at + lag, 1 + at] = sums[lag] - edge
    g[0, 1:] = g[1:, 0] = total - np.concatenate([[0.0], np.cumsum(tail)])[:k]
    return g


def _head_gram(head: np.ndarray) -> np.ndarray:
    """The same over rows 1..K; ``head`` holds rows K+1, K, ..., 1."""
    z = head[1:]  # row K first
    sums = np.array([float(z[: len(z) - lag] @ z[lag:]) for lag in range(len(z))] + [0.0])
    return upto_sums(float(z.sum()), sums, np.append(z, 0.0))


def _gram(row: dict, since: dict | None = None) -> tuple[np.ndarray, int]:
    """(Gram of the raw lags, rows) after row K, or after the cut ``since``."""
    clean = lambda a: np.array([0.0 if v is None or v != v else v for v in a], float)
    now = upto_sums(row["total"], clean(row["sums"]), clean(row["tail"]))
    if since is not None:
        before, first = upto_sums(since["total"], clean(since["sums"]), clean(since["tail"])), since["rn"]
    else:
        before, first = _head_gram(clean(row["head"])), len(row["sums"]) - 1
    g = now - before
    g[0, 0] = row["rn"] - first
    return g, int(row["rn"] - first)


# linear maps of the raw lags -----------------------------------------------------
def _poly(d: int, D: int, m: int) -> np.ndarray:
    out = np.ones(1)
    for _ in range(d):
        out = np.convolve(out, [1.0, -1.0])
    for _ in range(D):
        out = np.convolve(out, np.concatenate([[1.0], np.zeros(m - 1), [-1.0]]))
    return out


def _map(coef: np.ndarray, by: int, size: int, const: float = 0.0) -> np.ndarray:
    """The row const + Σ coef[k]·z(t-by-k) over the basis (1, z(t), ...)."""
    row = np.zeros(size)
    row[0] = const
    row[1 + by: 1 + by + len(coef)] = coef
    return row


def _regress(g: np.ndarray, target: np.ndarray, design: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """(coefficients, sum of squares left) of the map ``target`` on the maps."""
    x = np.stack(design)
    xx, xy = x @ g @ x.T, x @ g @ target
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    b = np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=1e-12)[0] / scale
    return b, max(float(target @ g @ target - 2 * b @ xy + b @ xx @ b), 0.0)


class Fit:
    """One order fitted from a Gram of the raw lags."""

    def __init__(self, g: np.ndarray, n: int, o: Order, stage: int):
        p, d, q, P, D, Q, m = o
        size = len(g)
        self.order, self.n, diff = o, n, _poly(d, D, m)
        self.w = _map(diff, 0, size)
        one = _map(np.zeros(0), 0, size, 1.0)
        ar = sorted({*range(1, p + 1), *(m * k for k in range(1, P + 1))})
        ma = sorted({*range(1, q + 1), *(m * k for k in range(1, Q + 1))})
        noise = np.zeros(1)  # e(t) as a filter of z
        const = 0.0
        if ma:
            a, _ = _regress(g, self.w, [one, *[_map(diff, i, size) for i in range(1, stage + 1)]])
            const, noise = -a[0], np.convolve(diff, np.concatenate([[1.0], -a[1:]]))
        self.noise, self.noise_const = noise, const
        self.design = [one, *[_map(diff, i, size) for i in ar], *[_map(noise, j, size, const) for j in ma]]
        self.b, self.sse = _regress(g, self.w, self.design)
        self.k = len(self.b)
        self.intercept = float(self.b[0])
        phi = np.zeros(max(ar, default=0) + 1)
        phi[0] = 1.0
        for i, v in zip(ar, self.b[1:], strict=False):
            phi[i] = -v
        self.phi = -np.convolve(diff, phi)[1:]  # of z(t-1), z(t-2), ...
        self.theta = np.zeros(max(ma, default=0))
        for j, v in zip(ma, self.b[1 + len(ar):], strict=True):
            self.theta[j - 1] = v

    def criteria(self) -> tuple[float, float, float]:
        """(variance of the residual, AIC, BIC); the variance is a parameter."""
        s2 = self.sse / self.n
        fit = self.n * np.log(max(s2, 1e-300))
        return s2, float(fit + 2 * (self.k + 1)), float(fit + np.log(self.n) * (self.k + 1))

    def tails(self, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last z, last e), latest first, as far as a forecast needs them."""
        e = [self.noise_const + float(self.noise @ tail[j: j + len(self.noise)]) for j in range(len(self.theta))]
        return tail[: len(self.phi)], np.array(e)

    def step_errors(self, g: np.ndarray, hs: Sequence[int]) -> list[float]:
        """Sums of squares of the errors h rows ahead, all lags being actual
        values: the forecasts are maps of the raw lags too."""
        size, out = len(g), []
        for h in hs:
            known = {}  # maps of z(t-h+s) for s = 1..h as forecast from row t-h

            def z(lag: int, known=known) -> np.ndarray:
                return known[lag] if lag in known else _map(np.ones(1), lag, size)
            for s in range(1, h + 1):
                lag = h - s
                f = _map(np.zeros(0), 0, size, self.intercept)
                for i, v in enumerate(self.phi, 1):
                    f = f + v * z(lag + i)
                for j, v in enumerate(self.theta, 1):
                    if lag + j >= h:  # later residuals are zero
                        f = f + v * _map(self.noise, lag + j, size, self.noise_const)
                known[lag] = f
            err = _map(np.ones(1), 0, size) - known[0]
            out.append(max(float(err @ g @ err), 0.0))
        return out


# an order as columns: p d q P D Q m, names that differ by more than their case
ORDER_NAMES = ["p", "d", "q", "sp", "sd", "sq", "season"]


def _order_schema(df: DataFrame, keys: Sequence[str], more: Sequence[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], *[T.StructField(n, T.IntegerType()) for n in ORDER_NAMES],
                         *[T.StructField(n, t) for n, t in more]])


def fit_orders(table: DataFrame, orders: Sequence[Order], keys: Sequence[str] = (), stage: int | None = None) -> DataFrame:
    """Every order for every row of :func:`lag_sums` that ends at a cut: keys,
    cut, order, n, sigma2, aic, bic and what a forecast needs (intercept, phi
    of the raw lags, theta, the last values and residuals, shift), and the
    values that follow.  A series without more rows than parameters has none."""
    keys, stage = list(keys), long_ar(orders) if stage is None else stage
    arr = T.ArrayType(T.DoubleType())
    schema = _order_schema(table, [*keys, "cut"], [
        ("n", T.LongType()), ("sigma2", T.DoubleType()), ("aic", T.DoubleType()), ("bic", T.DoubleType()), ("intercept", T.DoubleType()),
        ("phi", arr), ("theta", arr), ("y_tail", arr), ("e_tail", arr), ("shift", T.DoubleType()), ("next", arr)])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.to_dict("records"):
                if r["head"] is None:
                    continue
                g, n = _gram(r)
                for o in orders:
                    if n < 2 + o[0] + o[2] + o[3] + o[5] + 1:
                        continue
                    fit = Fit(g, n, o, stage)
                    ys, es = fit.tails(np.array(r["tail"], float))
                    out.append([*[r[k] for k in keys], r["cut"], *o, n, *fit.criteria(), fit.intercept, fit.phi.tolist(), fit.theta.tolist(),
                                ys.tolist(), es.tolist(), r["shift"], r["next"]])
            yield pd.DataFrame(out, columns=schema.names)

    return table.filter("cut IS NOT NULL").mapInPandas(run, schema)


def forecast(fits: DataFrame, h: int, keep: Sequence[str] = ()) -> DataFrame:
    """M6: h rows ahead of each fitted row: keep, order, h, yhat.

    The recursion is a fold over the steps whose state are the last values
    and residuals: a new value enters the first, a zero residual the second.
    The lags are those of the raw series, so differences are undone on the way.
    """
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def step(s, _):
        new = F.col("intercept") + dot(F.col("phi"), s["y"]) + dot(F.col("theta"), s["e"])
        return F.struct(F.slice(F.concat(F.array(new), s["y"]), F.lit(1), F.size("phi")).alias("y"),
                        F.slice(F.concat(F.array(F.lit(0.0)), s["e"]), F.lit(1), F.size("theta")).alias("e"),
                        F.concat(s["out"], F.array(new)).alias("out"))

    start = F.struct(F.col("y_tail").alias("y"), F.col("e_tail").alias("e"), F.array().cast("array<double>").alias("out"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(h)), start, step, lambda s: s["out"])
    steps = fits.select(*keep, *ORDER_NAMES, "shift", F.posexplode(path).alias("_k", "_z"))
    return steps.select(*keep, *ORDER_NAMES, (F.col("_k") + 1).alias("h"), (F.col("_z") + F.col("shift")).alias("yhat"))


def _one_cut(df: DataFrame, y: str, keys: Sequence[str], ratio: float) -> DataFrame:
    n = df.filter(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*keys, F.array(F.floor(F.col("n") * ratio).cast("int")).alias("cuts"))


def arma_forecast(df: DataFrame, y: str, o: Order, h: int, keys: Sequence[str] = (), order_by: str = "Date") -> DataFrame:
    """M6: fit one order on all rows of every series, forecast 1..h rows ahead:
    keys, h, yhat.  Null values are no rows; a series too short has none."""
    (df, own), stage = _keyed(df, keys), long_ar([o])
    table = lag_sums(df, y, depth(o, stage) or 1, _one_cut(df, y, own, 1.0), own, order_by)
    return forecast(fit_orders(table, [o], own, stage), h, own).select(*keys, "h", "yhat")


def order_grid(df: DataFrame, y: str, orders: Sequence[Order], keys: Sequence[str] = (), order_by: str = "Date",
               train_ratio: float = 0.7, hs: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """M7: every order of every series from one table of sums: keys, order, n,
    sigma2, aic, bic of the train rows, and rmse_h<h> of the test rows with
    fixed parameters.  All orders are fitted on the same rows."""
    (df, keys), stage = _keyed(df, keys), long_ar(orders)
    reach = max(depth(o, stage) for o in orders) + max(hs) - 1
    table = lag_sums(df, y, max(reach, 1), _one_cut(df, y, keys, train_ratio), keys, order_by)
    ends = table.groupBy(*keys).agg(F.max(F.when(F.col("cut").isNotNull(), F.struct("rn", "total", "sums", "head", "tail"))).alias("train"),
                                    F.max(F.when(F.col("cut").isNull(), F.struct("rn", "total", "sums", "head", "tail"))).alias("all"))
    schema = _order_schema(ends, keys, [("n", T.LongType()), ("sigma2", T.DoubleType()), ("aic", T.DoubleType()), ("bic", T.DoubleType()),
                                        *[(f"rmse_h{h}", T.DoubleType()) for h in hs]])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.to_dict("records"):
                train, test = r["train"], r["all"]
                if train is None or test is None or train["head"] is None:
                    continue
                train, test = (x if isinstance(x, dict) else x.asDict() for x in (train, test))
                g, n = _gram(train)
                later, rows = _gram(test, since=train)
                for o in orders:
                    if n < 2 + o[0] + o[2] + o[3] + o[5] + 1:
                        continue
                    fit = Fit(g, n, o, stage)
                    out.append([*[r[k] for k in keys], *o, n, *fit.criteria(), *[float(np.sqrt(s / rows)) for s in fit.step_errors(later, hs)]])
            yield pd.DataFrame(out, columns=schema.names)

    return ends.mapInPandas(run, schema).drop(SERIES)


def ts_cv(df: DataFrame, y: str, orders: Sequence[Order], hs: Sequence[int] = (1, 2, 3), k: int = 10, keys: Sequence[str] = (),
          order_by: str = "Date") -> tuple[DataFrame, DataFrame]:
    """V9: time-series cross-validation of fitted orders: for each horizon h,
    ``k`` folds whose test rows are the h rows after the train rows.  Returns
    (errors of each fold, their means and sample deviations), by keys, order
    and h.  The folds of all horizons are cuts of one scan."""
    from .aggregate import summarize_folds
    from .evaluate import error_exprs
    (df, keys), stage = _keyed(df, keys), long_ar(orders)
    lengths = df.filter(F.col(y).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    folds = None
    for h in hs:
        f = time_folds_df(lengths, k, h, keys=keys).select(*keys, F.lit(h).alias("horizon"), "fold", F.col("train_end").alias("cut"))
        folds = f if folds is None else folds.unionByName(f)
    folds = cut_lineage(folds.filter("cut > 0"))
    cuts = folds.groupBy(*keys).agg(F.array_sort(F.collect_set("cut")).alias("cuts"))  # at most k for each horizon
    reach = max(max(depth(o, stage) for o in orders), 1)
    table = lag_sums(df, y, reach, cuts, keys, order_by, ahead=max(hs))
    fits = cut_lineage(fit_orders(table, orders, keys, stage))
    steps = forecast(fits, max(hs), [*keys, "cut", "next"])
    actual = steps.withColumn("y", F.get("next", F.col("h") - 1)).drop("next")
    scored = folds.join(actual, [*keys, "cut"]).filter(F.col("h") <= F.col("horizon"))
    per_fold = (scored.groupBy(*keys, *ORDER_NAMES, F.col("horizon").alias("h"), "fold").agg(F.count(F.lit(1)).alias("n"), *error_exprs())
                .drop("r2"))
    summary = summarize_folds(per_fold, ["mae", "rmse", "mape"], ddof=1, by=[*keys, *ORDER_NAMES, "h"])
    return per_fold.drop(SERIES), summary.drop(SERIES)


# W14 ------------------------------------------------------------------------
def rolling_arma(df: DataFrame, y: str, past: int = 25, keys: Sequence[str] = (), order_by: str = "Date") -> DataFrame:
    """Sliding ARMA(1,1): keys, order_by, y, yhat, err, err_lag1.

    Row t is forecast as c + φ·y(t-1) + θ·e(t-1) by least squares over the
    ``past`` rows before it (extended least squares; e are the forecast errors
    so far, zero before the first forecast).  The window's Gram takes in each
    new row and gives up the oldest one, and the residual goes along the
    series, so the cost is that of the rows and a task holds one window.  Null
    values are no rows; the first ``past`` + 1 rows of a series have no forecast.
    """
    keys = list(keys)
    src = df.select(*keys, order_by, F.col(y).cast("double").alias("y")).filter("y IS NOT NULL AND NOT isnan(y)")
    parted = src.repartition(*keys) if keys else src.coalesce(1)  # without keys there is one series
    schema = T.StructType([*src.schema.fields, *[T.StructField(n, T.DoubleType()) for n in ("yhat", "err", "err_lag1")]])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = run  # no key yet
        for batch in batches:
            of = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            out = []
            for key, value in zip(of, batch.column("y").to_pylist(), strict=True):
                if key != current:
                    # a fixed origin near the values keeps the sums precise
                    current, origin, window, xx, xy = key, value, deque(), np.zeros((3, 3)), np.zeros(3)
                    before, e, last, changed = None, 0.0, None, 0
                z = value - origin
                yhat = err = None
                if len(window) == past:
                    b = np.linalg.lstsq(xx, xy, rcond=1e-12)[0]
                    yhat = float(b @ (1.0, before, e)) + origin
                    err = value - yhat
                if before is not None:
                    x = np.array((1.0, before, e))
                    window.append((x, z))
                    xx, xy = xx + np.outer(x, x), xy + x * z
                    if len(window) > past:
                        x, old = window.popleft()
                        xx, xy, changed = xx - np.outer(x, x), xy - x * old, changed + 1
                        if changed == past:  # no rounding adds up along a long series
                            rows = np.array([v for v, _ in window])
                            xx, xy, changed = rows.T @ rows, rows.T @ np.array([v for _, v in window]), 0
                out.append((yhat, err, last))
                before, e, last = z, err or 0.0, err
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-3]],
                                              *[pa.array([r[k] for r in out], pa.float64()) for k in range(3)]], names=names)

    return parted.sortWithinPartitions(*keys, order_by).mapInArrow(run, schema)
