"""Statistics and feature-screening operators.

Everything that is a sum over rows is one grouped aggregate (partial per
task).  Where a test needs a small matrix solve, the rows are first
reduced to Grams (``gram.py``) and the solve runs on those few rows
inside ``mapInPandas``.  Lagged designs are built with windows
partitioned by series (``keys``) on daily tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gram as G
from .lagged import q


def _w(keys, order_by):
    return (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order_by)


def to_long(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), order_by: str = "Date") -> DataFrame:
    """Wide series → long (keys…, col, order_by, y): one series per column,
    so per-column statistics become grouped aggregates over ``col``."""
    return df.select(*keys, order_by, *cols).unpivot([*keys, order_by], list(cols), "col", "y")


# X3 ----------------------------------------------------------------------------
def acf(df: DataFrame, col: str, nlags: int, keys=(), order_by: str = "Date") -> DataFrame:
    """Autocorrelation r_k = Σ(x_t−m)(x_{t−k}−m) / Σ(x_t−m)², k = 0..nlags,
    m the series mean: one windowed pass of lag products."""
    mean = df.groupBy(*keys).agg(F.avg(col).alias("_m"))
    d = (df.join(mean, on=list(keys)) if keys else df.withColumn("_m", df.select(F.avg(col)).scalar()))
    d = d.withColumn("_c", F.col(col) - F.col("_m"))
    w = _w(keys, order_by)
    prods = d.select(*keys, *[(F.col("_c") * F.lag("_c", k).over(w)).alias(f"p{k}") for k in range(nlags + 1)])
    agg = prods.groupBy(*keys).agg(*[F.sum(f"p{k}").alias(f"s{k}") for k in range(nlags + 1)])
    return agg.select(*keys, F.posexplode(F.array(*[F.col(f"s{k}") / F.col("s0") for k in range(nlags + 1)])).alias("lag", "acf"))


def pacf_from_acf(r: np.ndarray) -> np.ndarray:
    """Durbin-Levinson recursion on an ACF row (r[0] = 1)."""
    n = len(r) - 1
    out = np.zeros(n + 1)
    out[0] = 1.0
    phi = np.zeros((n + 1, n + 1))
    for k in range(1, n + 1):
        num = r[k] - sum(phi[k - 1, j] * r[k - j] for j in range(1, k))
        den = 1.0 - sum(phi[k - 1, j] * r[j] for j in range(1, k))
        phi[k, k] = num / den
        for j in range(1, k):
            phi[k, j] = phi[k - 1, j] - phi[k, k] * phi[k - 1, k - j]
        out[k] = phi[k, k]
    return out


def pacf(acf_long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """PACF per series from its ACF rows (a handful of numbers per series)."""
    keys = list(keys)
    rows = acf_long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("_s"))
    schema = T.StructType([*[acf_long.schema[k] for k in keys], T.StructField("lag", T.IntegerType()),
                           T.StructField("pacf", T.DoubleType())])

    def run(it):
        for pdf in it:
            out = []
            for rec in pdf.to_dict("records"):
                r = np.array([s["acf"] for s in rec["_s"]], dtype=float)
                for k, v in enumerate(pacf_from_acf(r)):
                    out.append([*[rec[c] for c in keys], k, float(v)])
            if out:
                yield pd.DataFrame(out, columns=[*keys, "lag", "pacf"])
    return rows.mapInPandas(run, schema)


# X6 ----------------------------------------------------------------------------
def decompose_classical(df: DataFrame, col: str, period: int = 10, keys=(), order_by: str = "Date") -> DataFrame:
    """Window-only classical additive decomposition: trend = centred moving
    average (2×m for an even period), seasonal = mean detrended value of
    the phase (rn mod period) centred to sum 0 over a period, residual =
    rest.  Ends without a full window have null trend/residual.
    Invariant: trend + seasonal + residual = input."""
    w = _w(keys, order_by)
    rn = F.row_number().over(w)
    d = df.withColumn("_rn", rn)
    half = period // 2
    # the centred sum is written out term by term (oldest first): one fixed
    # evaluation order, so the result does not depend on a frame algorithm
    def at(k):
        return F.lag(col, -k).over(w) if k < 0 else (F.col(col) if k == 0 else F.lead(col, k).over(w))
    if period % 2 == 0:
        terms = [0.5 * at(-half)] + [at(k) for k in range(-half + 1, half)] + [0.5 * at(half)]
    else:
        terms = [at(k) for k in range(-half, half + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    trend = total / period
    d = d.withColumn("trend", trend).withColumn("_phase", (F.col("_rn") - 1) % period)
    phase = (d.filter(F.col("trend").isNotNull())
              .groupBy(*keys, "_phase").agg(F.avg(F.col(col) - F.col("trend")).alias("_pm")))
    centre = phase.groupBy(*keys).agg(F.avg("_pm").alias("_pc"))
    phase = (phase.join(centre, on=list(keys)) if keys else phase.withColumn("_pc", phase.select(F.avg("_pm")).scalar()))
    phase = phase.select(*keys, "_phase", (F.col("_pm") - F.col("_pc")).alias("seasonal"))
    out = d.join(phase, on=[*keys, "_phase"], how="left")
    return out.withColumn("residual", F.col(col) - F.col("trend") - F.col("seasonal")).drop("_rn", "_phase")


# X11 / X13 / X14 / X12 ----------------------------------------------------------------
def top_by_corr(df: DataFrame, cols: Sequence[str], y: str, k: int) -> DataFrame:
    """X11: Pearson r of each column with y; the k largest |r|."""
    row = df.agg(*[F.corr(q(c), q(y)).alias(c) for c in cols])
    long = row.unpivot([], list(cols), "col", "r")
    return long.orderBy(F.abs("r").desc(), "col").limit(k)


def by_variance(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    """Columns whose population variance exceeds the threshold."""
    row = df.agg(*[F.var_pop(q(c)).alias(c) for c in cols])
    return row.unpivot([], list(cols), "col", "var").filter(F.col("var") > threshold)


def series_stats(df: DataFrame, cols: Sequence[str], order_by: str = "Date", bins: int = 10) -> DataFrame:
    """X14 per column: absolute energy Σx², lag-1 autocorrelation sum
    Σx_t·x_{t−1}, histogram entropy over equal-width bins, number of
    interior peaks, slope of x on the row number."""
    long = to_long(df, cols, (), order_by)
    w = Window.partitionBy("col").orderBy(order_by)
    long = long.withColumn("_rn", F.row_number().over(w)).withColumn("_prev", F.lag("y").over(w)) \
        .withColumn("_next", F.lead("y").over(w))
    mm = long.groupBy("col").agg(F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    long = long.join(mm, on="col")
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("y") - F.col("_lo")) / width), F.lit(bins - 1)))
    hist = long.withColumn("_b", b).groupBy("col", "_b").agg(F.count(F.lit(1)).alias("_n"))
    tot = hist.groupBy("col").agg(F.sum("_n").alias("_t"))
    ent = hist.join(tot, on="col").groupBy("col").agg(
        (-F.sum(F.col("_n") / F.col("_t") * F.log(F.col("_n") / F.col("_t")))).alias("entropy"))
    base = long.groupBy("col").agg(
        F.sum(F.col("y") * F.col("y")).alias("abs_energy"),
        F.sum(F.col("y") * F.col("_prev")).alias("autocorr"),
        F.sum(((F.col("y") > F.col("_prev")) & (F.col("y") > F.col("_next"))).cast("int")).cast("long").alias("peaks"),
        F.regr_slope("y", "_rn").alias("slope"))
    return base.join(ent, on="col")


def binned_mi(df: DataFrame, cols: Sequence[str], y: str, bins: int = 10) -> DataFrame:
    """X12 (declared variant): mutual information of each column with y on
    equal-width bins, MI = Σ p_xy·ln(p_xy/(p_x·p_y)), from one contingency
    count table per column (a grouped aggregate)."""
    long = df.select(q(y).alias("_y"), *cols).unpivot(["_y"], list(cols), "col", "x")
    mm = long.groupBy("col").agg(F.min("x").alias("_xl"), F.max("x").alias("_xh"), F.min("_y").alias("_yl"),
                                 F.max("_y").alias("_yh"))
    # one row for each column: a shuffle by column would send all rows to as many tasks
    long = long.join(F.broadcast(mm), on="col")

    def binof(v, lo, hi):
        wd = (F.col(hi) - F.col(lo)) / bins
        return F.when(wd == 0, F.lit(0)).otherwise(F.least(F.floor((F.col(v) - F.col(lo)) / wd), F.lit(bins - 1)))
    ct = long.select("col", binof("x", "_xl", "_xh").alias("bx"), binof("_y", "_yl", "_yh").alias("by")) \
        .groupBy("col", "bx", "by").agg(F.count(F.lit(1)).alias("cnt"))
    tot = ct.groupBy("col").agg(F.sum("cnt").alias("tot"))
    px = ct.groupBy("col", "bx").agg(F.sum("cnt").alias("nx"))
    py = ct.groupBy("col", "by").agg(F.sum("cnt").alias("ny"))
    j = ct.join(tot, "col").join(px, ["col", "bx"]).join(py, ["col", "by"])
    p_xy = F.col("cnt") / F.col("tot")
    return j.groupBy("col").agg(F.sum(p_xy * F.log(F.col("cnt") * F.col("tot") / (F.col("nx") * F.col("ny")))).alias("mi"))


# special functions used by the tests below ------------------------------------------------
def _betacf(a, b, x, itmax=300, eps=3e-16):
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, itmax + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c
        c = c if abs(c) > 1e-300 else 1e-300
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) (continued fraction)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    bt = math.exp(lbt)
    if x < (a + 1) / (a + b + 2):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if not np.isfinite(f) or f <= 0:
        return 1.0 if f <= 0 else 0.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def norm_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


# fixed values: MacKinnon (1994) approximate p-value surface for the ADF
# test with a constant and one series (published regression coefficients)
ADF_TAU_MAX_C = 2.74
ADF_TAU_MIN_C = -18.83
ADF_TAU_STAR_C = -1.61
ADF_SMALLP_C = [2.1659, 1.4412, 0.038269]
ADF_LARGEP_C = [1.7339, 0.93202, -0.12745, -0.010368]


def adf_pvalue(stat: float) -> float:
    if stat > ADF_TAU_MAX_C:
        return 1.0
    if stat < ADF_TAU_MIN_C:
        return 0.0
    coef = ADF_SMALLP_C if stat <= ADF_TAU_STAR_C else ADF_LARGEP_C
    return norm_cdf(sum(c * stat ** i for i, c in enumerate(coef)))


def _ols_from_gram(xx, xy, yy, n, idx):
    """OLS on a sub-design (columns ``idx`` of the Gram, column 0 = const).
    The constant is taken out first and the rest is scaled to unit diagonal,
    so columns of any size and mean are solved alike."""
    A = xx[np.ix_(idx, idx)]
    b = xy[idx]
    a0, m = A[0, 0], A[0, 1:] / A[0, 0]
    S = A[1:, 1:] - a0 * np.outer(m, m)
    s = b[1:] - m * b[0]
    scale = np.sqrt(np.maximum(np.diag(S), np.finfo(float).tiny))
    slope = np.linalg.lstsq(S / np.outer(scale, scale), s / scale, rcond=None)[0] / scale
    ssr = float(yy - b[0] ** 2 / a0 - 2 * slope @ s + slope @ S @ slope)
    return np.concatenate([[b[0] / a0 - m @ slope], slope]), max(ssr, 0.0), A


def _inverse(A):
    """Pseudo-inverse, scaled to unit diagonal first."""
    d = 1 / np.sqrt(np.maximum(np.diag(A), np.finfo(float).tiny))
    return np.linalg.pinv(A * np.outer(d, d)) * np.outer(d, d)


# X1 -------------------------------------------------------------------------------------
def _design(n, sx, sy, xx, xy, yy):
    """Gram row → (XᵀX, Xᵀy, yᵀy) of the design with a leading constant."""
    k = len(sx)
    XX = np.zeros((k + 1, k + 1))
    XX[0, 0] = n
    XX[0, 1:] = sx
    XX[1:, 0] = sx
    XX[1:, 1:] = np.array(xx).reshape(k, k)
    return XX, np.concatenate([[sy], xy]), yy


def _level_sums(levels, min_level):
    """Sum the Gram pieces of every level ≥ min_level (rows valid there)."""
    tot = None
    for lv in levels:
        if lv["v"] < min_level:
            continue
        XX, XY, YY = _design(lv["n"], lv["sx"], lv["sy"], lv["xx"], lv["xy"], lv["yy"])
        tot = (XX, XY, YY) if tot is None else (tot[0] + XX, tot[1] + XY, tot[2] + YY)
    return tot


def _level_grams(d: DataFrame, xs: Sequence[str], y: str, by: Sequence[str]) -> DataFrame:
    """Grams per (group, validity level) collected into one small row per
    group: level v holds the rows whose first v lag columns exist (missing
    later lags filled with 0, which the sub-designs never read)."""
    filled = d.fillna(0.0, subset=list(xs))
    g = G.gram(filled, xs, y, by=[*by, "v"])
    return g.groupBy(*by).agg(F.collect_list(F.struct("v", "n", "sx", "sy", "xx", "xy", "yy")).alias("levels"))


def adf(df: DataFrame, cols: Sequence[str], max_lag: int | None = None, keys=(), order_by: str = "Date",
        fixed: bool = False) -> DataFrame:
    """Augmented Dickey-Fuller test (constant; lag order by AIC on the
    common sample, or ``max_lag`` itself if ``fixed``, then the chosen order
    refitted on its own full sample):
    Δy_t = c + β·y_{t−1} + Σ_i γ_i·Δy_{t−i}; statistic = t(β); p-value
    from the MacKinnon surface.  A single Gram pass (per column and
    validity level) answers every lag order."""
    keys = list(keys)
    long = to_long(df, cols, keys, order_by)
    by = [*keys, "col"]
    w = Window.partitionBy(*by).orderBy(order_by)
    if max_lag is None:
        nmax = long.groupBy(*by).count().agg(F.max("count")).first()[0]
        max_lag = int(math.ceil(12.0 * (nmax / 100.0) ** 0.25))
    L = max_lag
    d = long.withColumn("dy", F.col("y") - F.lag("y").over(w)).withColumn("y1", F.lag("y").over(w)) \
        .withColumn("_rn", F.row_number().over(w))
    xs = ["y1"] + [f"dl{i}" for i in range(1, L + 1)]
    d = d.withColumns({f"dl{i}": F.lag("dy", i).over(w) for i in range(1, L + 1)})
    d = d.filter(F.col("dy").isNotNull()).withColumn("v", F.least(F.col("_rn") - 2, F.lit(L)))
    lv = _level_grams(d, xs, "dy", by)
    schema = T.StructType([*[long.schema[k] for k in by], T.StructField("stat", T.DoubleType()),
                           T.StructField("p_value", T.DoubleType()), T.StructField("lag", T.IntegerType()),
                           T.StructField("nobs", T.LongType())])

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.to_dict("records"):
                XX, XY, YY = _level_sums(r["levels"], L)
                n = XX[0, 0]
                best, best_p = None, 0
                for p in [L] if fixed else range(L + 1):
                    idx = list(range(0, p + 2))
                    _, ssr, _ = _ols_from_gram(XX, XY, YY, n, idx)
                    llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(ssr / n) + 1.0)
                    aic = -2 * llf + 2 * len(idx)
                    if best is None or aic < best:
                        best, best_p = aic, p
                XX, XY, YY = _level_sums(r["levels"], best_p)
                n = XX[0, 0]
                idx = list(range(best_p + 2))
                coef, ssr, A = _ols_from_gram(XX, XY, YY, n, idx)
                cov = ssr / (n - len(idx)) * _inverse(A)
                stat = float(coef[1] / math.sqrt(cov[1, 1]))
                out.append([*[r[c] for c in by], stat, adf_pvalue(stat), best_p, int(n)])
            if out:
                yield pd.DataFrame(out, columns=[*by, "stat", "p_value", "lag", "nobs"])
    return lv.mapInPandas(run, schema)


# X5 -------------------------------------------------------------------------------------
def granger(df: DataFrame, target: str, cols: Sequence[str], max_lag: int, keys=(), order_by: str = "Date") -> DataFrame:
    """SSR F-test of "col does not Granger-cause target" for each lag order
    p = 1..max_lag: restricted y ~ const + p lags of y, unrestricted adds p
    lags of col, both on the rows where p lags exist.  The feature columns
    are unpivoted so one grouped Gram pass (per column and validity level)
    serves every column and order."""
    keys = list(keys)
    long = df.select(*keys, order_by, F.col(target).alias("_y"), *cols).unpivot([*keys, order_by, "_y"], list(cols), "col", "x")
    by = [*keys, "col"]
    w = Window.partitionBy(*by).orderBy(order_by)
    P = max_lag
    xs = [f"y_l{i}" for i in range(1, P + 1)] + [f"x_l{i}" for i in range(1, P + 1)]
    d = long.withColumns({f"y_l{i}": F.lag("_y", i).over(w) for i in range(1, P + 1)}) \
        .withColumns({f"x_l{i}": F.lag("x", i).over(w) for i in range(1, P + 1)}) \
        .withColumn("v", F.least(F.row_number().over(w) - 1, F.lit(P))).filter(F.col("v") >= 1)
    lv = _level_grams(d, xs, "_y", by)
    schema = T.StructType([*[long.schema[k] for k in by], T.StructField("lag", T.IntegerType()),
                           T.StructField("F", T.DoubleType()), T.StructField("p_value", T.DoubleType())])

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.to_dict("records"):
                for p in range(1, P + 1):
                    XX, XY, YY = _level_sums(r["levels"], p)
                    n = XX[0, 0]
                    restricted = [0] + list(range(1, p + 1))
                    unrestricted = restricted + list(range(1 + P, 1 + P + p))
                    _, ssr_r, _ = _ols_from_gram(XX, XY, YY, n, restricted)
                    _, ssr_u, _ = _ols_from_gram(XX, XY, YY, n, unrestricted)
                    d2 = n - 2 * p - 1
                    fstat = ((ssr_r - ssr_u) / p) / (ssr_u / d2) if ssr_u > 0 and d2 > 0 else float("nan")
                    out.append([*[r[c] for c in by], p, float(fstat), f_sf(fstat, p, d2)])
            if out:
                yield pd.DataFrame(out, columns=[*by, "lag", "F", "p_value"])
    return lv.mapInPandas(run, schema)


# X4 -------------------------------------------------------------------------------------
def var_order(df: DataFrame, cols: Sequence[str], max_lag: int, order_by: str = "Date") -> DataFrame:
    """VAR lag-order selection: for each order p ≤ max_lag, every equation
    regressed on a constant and p lags of all series on the common sample
    (rows with max_lag lags); AIC, BIC, HQIC and FPE from the residual
    covariance.  One Gram of the stacked design answers every order."""
    w = _w((), order_by)
    k = len(cols)
    lag_cols = [f"{c}_l{i}" for i in range(1, max_lag + 1) for c in cols]
    lagged = df.select(order_by, *cols).withColumns(
        {f"{c}_l{i}": F.lag(c, i).over(w) for i in range(1, max_lag + 1) for c in cols}).dropna()
    # Gram of [lags..., current values]: Σ zzᵀ with z = (1, lags, ys)
    allc = lag_cols + list(cols)
    g = G.gram(lagged, allc, cols[0])
    schema = "lag int, aic double, bic double, hqic double, fpe double"

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.to_dict("records"):
                n = r["n"]
                m = len(r["sx"])
                Z = np.zeros((m + 1, m + 1))
                Z[0, 0] = n
                Z[0, 1:] = r["sx"]
                Z[1:, 0] = r["sx"]
                Z[1:, 1:] = np.array(r["xx"]).reshape(m, m)
                ys = list(range(1 + len(lag_cols), m + 1))
                for p in range(1, max_lag + 1):
                    xi = [0] + list(range(1, 1 + p * k))
                    A = Z[np.ix_(xi, xi)]
                    B = Z[np.ix_(xi, ys)]
                    C = Z[np.ix_(ys, ys)]
                    coef = np.linalg.lstsq(A, B, rcond=None)[0]
                    S = (C - B.T @ coef - coef.T @ B + coef.T @ A @ coef) / n
                    ld = float(np.linalg.slogdet(S)[1])
                    npar = p * k * k
                    aic = ld + 2.0 * npar / n
                    bic = ld + npar * math.log(n) / n
                    hqic = ld + 2.0 * npar * math.log(math.log(n)) / n
                    kp = k * p + 1
                    fpe = ((n + kp) / (n - kp)) ** k * math.exp(ld)
                    out.append([p, aic, bic, hqic, fpe])
            if out:
                yield pd.DataFrame(out, columns=["lag", "aic", "bic", "hqic", "fpe"])
    return g.mapInPandas(run, schema)


# X2 -------------------------------------------------------------------------------------
def make_stationary(df: DataFrame, cols: Sequence[str], alpha: float = 0.05, max_order: int = 12,
                    order_by: str = "Date") -> tuple[DataFrame, int, float]:
    """Difference every column until all ADF p-values are ≤ alpha; returns
    the differenced frame, the order and the largest p-value.  Each round is
    one distributed test job.  A series that is not stationary after
    ``max_order`` differences (a documented bound) raises an error."""
    from .lagged import diff
    cur = df
    for order in range(max_order + 1):
        res = adf(cur, cols, order_by=order_by).agg(F.max("p_value")).first()[0]
        if res is None or res <= alpha:
            return cur, order, res
        cur = diff(cur, cols, 1, order_by=order_by)
    raise ValueError(f"not stationary after {max_order} differences: p = {res}")


# X6 (LOESS form) -----------------------------------------------------------------------
def _loess(x: np.ndarray, y: np.ndarray, xq: np.ndarray, span: int, w_rob: np.ndarray | None = None) -> np.ndarray:
    """Local linear fit with tricube weights over the ``span`` nearest
    points (widened beyond the data when span > n), evaluated at ``xq``.
    ``x`` are the numbers 0, 1, ...: the nearest points are a window that
    slides with the query, so nothing is sorted."""
    n = len(x)
    q = min(span, n)
    out = np.empty(len(xq))
    first = np.clip(np.round(xq).astype(int) - (q - 1) // 2, 0, n - q)
    inside = np.arange(q)
    for lo in range(0, len(xq), 4096):
        x0 = xq[lo:lo + 4096, None]
        at = first[lo:lo + 4096, None] + inside
        xs, ys = x[at], y[at]
        d = np.abs(xs - x0)
        h = np.maximum(d.max(axis=1, keepdims=True) + ((span - n) / 2.0 if span > n else 0.0), 1e-12)
        w = np.clip((1 - (d / h) ** 3) ** 3, 0, None)
        if w_rob is not None:
            w = w * w_rob[at]
        sw = w.sum(axis=1)
        safe = np.where(sw > 0, sw, 1.0)
        xm, ym = (w * xs).sum(axis=1) / safe, (w * ys).sum(axis=1) / safe
        dx = xs - xm[:, None]
        sxx = (w * dx ** 2).sum(axis=1)
        flat = sxx <= 1e-12 * np.maximum(1.0, xm * xm)
        b = np.where(flat, 0.0, (w * dx * (ys - ym[:, None])).sum(axis=1) / np.where(flat, 1.0, sxx))
        out[lo:lo + 4096] = np.where(sw > 0, ym + b * (x0[:, 0] - xm), ys.mean(axis=1))
    return out


def stl_numpy(y: np.ndarray, period: int, seasonal: int = 7, inner: int = 2, outer: int = 0):
    """STL (Cleveland et al. 1990): inner loop of cycle-subseries LOESS,
    low-pass filtering and trend LOESS; optional robustness iterations."""
    n = len(y)
    ns = seasonal if seasonal % 2 else seasonal + 1
    nt = int(np.ceil(1.5 * period / (1 - 1.5 / ns)))
    nt += (nt % 2 == 0)
    nl = period + (period % 2 == 0)
    T = np.zeros(n)
    S = np.zeros(n)
    rob = np.ones(n)
    t_idx = np.arange(n, dtype=float)
    for _ in range(outer + 1):
        for _ in range(inner):
            det = y - T
            C = np.zeros(n + 2 * period)
            for k in range(period):
                pos = np.arange(k, n, period)
                if len(pos) == 0:
                    continue
                xs = np.arange(len(pos), dtype=float)
                xq = np.arange(-1, len(pos) + 1, dtype=float)
                sm = _loess(xs, det[pos], xq, ns, rob[pos])
                C[k + period * np.arange(len(pos) + 2)] = sm
            def ma(a, m):
                c = np.cumsum(np.insert(a, 0, 0.0))
                return (c[m:] - c[:-m]) / m
            L = ma(ma(ma(C, period), period), 3)
            L = _loess(np.arange(len(L), dtype=float), L, np.arange(len(L), dtype=float), nl)
            S = C[period:period + n] - L[:n]
            T = _loess(t_idx, y - S, t_idx, nt, rob)
        if outer:
            r = np.abs(y - T - S)
            h = 6 * np.median(r)
            rob = np.clip(1 - (r / max(h, 1e-12)) ** 2, 0, None) ** 2
    return T, S, y - T - S


def decompose_stl(df: DataFrame, col: str, period: int = 10, keys: Sequence[str] = (), order_by: str = "Date",
                  seasonal: int = 7, robust: bool = False) -> DataFrame:
    """X6 with LOESS: one series per group (a daily table per key), so the
    work scales with the number of series.  Parts sum to the input."""
    keys = list(keys)
    grp = keys or ["_series"]
    src = df.select(*keys, order_by, F.col(col).cast("double").alias("y"))
    if not keys:
        src = src.withColumn("_series", F.lit(0))
    fields = [src.schema[k] for k in grp] + [src.schema[order_by]]
    schema = T.StructType([*fields, T.StructField("trend", T.DoubleType()), T.StructField("seasonal", T.DoubleType()),
                           T.StructField("residual", T.DoubleType())])

    def run(pdf):
        pdf = pdf.sort_values(order_by)
        t, s, r = stl_numpy(pdf["y"].to_numpy(dtype=float), period, seasonal, 2, 15 if robust else 0)
        out = pdf[[*grp, order_by]].copy()
        out["trend"], out["seasonal"], out["residual"] = t, s, r
        return out

    res = src.groupBy(*grp).applyInPandas(run, schema)
    return res.drop("_series") if not keys else res
