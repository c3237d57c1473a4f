"""Linear models from Grams (M1-M3), scoring, random walk (M8),
horizon by back-shift (M10), refit (M12).

Fitting reads only the small Gram rows (one per group); solves run in
``mapInPandas`` next to them, so many series × folds fit in parallel and
nothing row-level reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gram as G
from .lagged import q


def solve(g: dict, kind: str = "ols", alpha: float = 1.0, l1_ratio: float = 1.0,
          fit_intercept: bool = True, max_iter: int = 10000, tol: float = 1e-12,
          start: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Solve one Gram; ``start``: coefficients to begin the search from. Objectives follow the usual conventions:
    ols ‖y−Xb−c‖²; ridge ‖y−Xb−c‖² + α‖b‖²;
    lasso/enet (1/2n)‖y−Xb−c‖² + αρ‖b‖₁ + α(1−ρ)/2‖b‖²; c unpenalised."""
    if fit_intercept:
        sxx, sxy, _, mx, my = G.centered(g)
    else:
        sxx, sxy, mx, my = g["xx"], g["xy"], np.zeros(len(g["sx"])), 0.0
    p = len(sxy)
    n = g["n"]
    if kind == "ols":
        b = np.linalg.lstsq(sxx, sxy, rcond=None)[0]
    elif kind == "ridge":
        b = np.linalg.solve(sxx + alpha * np.eye(p), sxy)
    elif kind in ("lasso", "enet"):
        rho = 1.0 if kind == "lasso" else l1_ratio
        l1, l2 = n * alpha * rho, n * alpha * (1.0 - rho)
        b = np.zeros(p) if start is None else np.array(start, float)
        diag = np.diag(sxx).copy()
        left = sxy - sxx @ b  # kept up to date: a coordinate that does not move costs nothing
        every = [j for j in range(p) if diag[j] > 0]
        some = every
        for _ in range(max_iter):
            delta = 0.0
            for j in some:
                r = left[j] + diag[j] * b[j]
                new = max(abs(r) - l1, 0.0) / (diag[j] + l2)
                new = new if r > 0 else -new
                if new != b[j]:
                    delta = max(delta, abs(new - b[j]))
                    left -= sxx[:, j] * (new - b[j])
                    b[j] = new
            if delta <= tol * max(1.0, np.max(np.abs(b), initial=0.0)):
                if some is every:
                    break
                some = every  # the others may move now
            else:
                some = [j for j in every if b[j]]
    else:
        raise ValueError(kind)
    c = float(my - mx @ b) if fit_intercept else 0.0
    return c, b


def linear_fit(grams: DataFrame, by: Sequence[str] = (), kind: str = "ols", alpha: float = 1.0,
               l1_ratio: float = 1.0, fit_intercept: bool = True) -> DataFrame:
    """M1-M3: one (intercept, coef) row per Gram group."""
    by = list(by)
    schema = T.StructType([*[grams.schema[b] for b in by], T.StructField("intercept", T.DoubleType()),
                           T.StructField("coef", T.ArrayType(T.DoubleType()))])

    def fit(it):
        for pdf in it:
            out = []
            for r in pdf.to_dict("records"):
                g = G.to_numpy(r)
                c, b = solve(g, kind, alpha, l1_ratio, fit_intercept)
                out.append([*[r[k] for k in by], c, b.tolist()])
            if out:
                yield pd.DataFrame(out, columns=[*by, "intercept", "coef"])

    return grams.mapInPandas(fit, schema=schema)


def predict_expr(x_cols: Sequence[str], coef: Column, intercept: Column) -> Column:
    xs = F.array(*[q(c).cast("double") for c in x_cols])
    return intercept + F.aggregate(F.zip_with(xs, coef, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def linear_apply(df: DataFrame, params: DataFrame, x_cols: Sequence[str], by: Sequence[str] = (),
                 out: str = "yhat") -> DataFrame:
    """Score rows with fitted coefficients.  Grouped params join on their
    keys (one row per group); a single model's are read once and inlined."""
    if by:
        return df.join(params, on=list(by), how="inner") \
            .withColumn(out, predict_expr(x_cols, F.col("coef"), F.col("intercept"))).drop("coef", "intercept")
    # one model: its parameters are a bounded artefact (p+1 numbers), read
    # once and inlined as literals, as a fitted Spark ML model holds them
    row = params.first()
    acc = F.lit(float(row["intercept"]))
    for c, b in zip(x_cols, row["coef"]):
        acc = acc + q(c).cast("double") * F.lit(float(b))
    return df.withColumn(out, acc)


# M8 -------------------------------------------------------------------------
def random_walk(df: DataFrame, y: str, keys=(), order_by: str = "Date", out: str = "yhat") -> DataFrame:
    """Walk-forward random walk: forecast = last observed value."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order_by)
    return df.withColumn(out, F.lag(y, 1).over(w))


def random_walk_folds(df: DataFrame, folds: DataFrame, y: str, h: int, rn: str = "rn",
                      keys: Sequence[str] = ()) -> DataFrame:
    """Fold form: every test row of a fold is forecast with the last train
    value (``max_by(y, rn)`` over the train rows) for horizons 1..h."""
    keys = list(keys)
    # equi-joins on the row number only: the last train row of a fold is
    # rn = test_start − 1, its test rows are test_start .. test_start+h−1
    last_rn = folds.select(*keys, "fold", (F.col("test_start") - 1).alias(rn))
    last = df.select(*keys, rn, F.col(y).alias("yhat")).join(last_rn, on=[*keys, rn]).drop(rn)
    test_rn = folds.select(*keys, "fold", "test_start",
                           F.explode(F.sequence(F.col("test_start"), F.col("test_start") + h - 1)).alias(rn))
    test = df.join(test_rn, on=[*keys, rn], how="inner")
    return test.join(last, on=[*keys, "fold"], how="inner").withColumn("h", F.col(rn) - F.col("test_start") + 1)


# M10 ------------------------------------------------------------------------
def forecast_by_shift(preds: DataFrame, col: str = "yhat", hs: Sequence[int] = (1, 2, 3), keys=(),
                      order_by: str = "Date") -> DataFrame:
    """ŷ[t+h] = f(x[t]): the h-step forecast of row t is the one-step
    prediction made h−1 rows earlier."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order_by)
    return preds.withColumns({f"{col}_h{h}": F.lag(col, h - 1).over(w) for h in hs})


# M12 ------------------------------------------------------------------------
def refit(old_gram: DataFrame, new_rows: DataFrame, x_cols: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """Grams are additive: refit = old Gram + Gram of the new rows."""
    new = G.gram(new_rows, x_cols, y, by)
    return G.combine(old_gram.unionByName(new), by)


# M6 / M7 --------------------------------------------------------------------
def arma_design(df: DataFrame, y: str, P: int, Q: int, d: int = 0, m: int | None = None, keys=(),
                order_by: str = "Date", seasonal: tuple[int, int] = (0, 0)) -> tuple[DataFrame, list[str]]:
    """Two-stage least-squares design (Hannan–Rissanen, declared instead of
    maximum likelihood): difference ``d`` times, fit a long AR(m) by one
    Gram per series, take its residuals, then expose y lags 1..P and
    residual lags 1..Q.  Any ARMA(p≤P, q≤Q) is a sub-design of it."""
    keys = list(keys)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order_by)
    z = df.select(*keys, order_by, F.col(y).cast("double").alias("z"))
    for _ in range(d):
        z = z.withColumn("z", F.col("z") - F.lag("z").over(w))
    z = z.filter(F.col("z").isNotNull())
    m = m or max(P, Q) + 5
    ar = z.withColumns({f"a{i}": F.lag("z", i).over(w) for i in range(1, m + 1)})
    g = G.gram(ar, [f"a{i}" for i in range(1, m + 1)], "z", by=keys)
    params = linear_fit(g, by=keys, kind="ols")
    res = linear_apply(ar, params, [f"a{i}" for i in range(1, m + 1)], by=keys, out="_ar")
    res = res.withColumn("e", F.col("z") - F.col("_ar")).drop("_ar", *[f"a{i}" for i in range(1, m + 1)])
    cols = [f"y_l{i}" for i in range(1, P + 1)] + [f"e_l{j}" for j in range(1, Q + 1)]
    des = res.withColumns({f"y_l{i}": F.lag("z", i).over(w) for i in range(1, P + 1)}) \
             .withColumns({f"e_l{j}": F.lag("e", j).over(w) for j in range(1, Q + 1)})
    # seasonal AR terms (P_s lags at multiples of the season s) as extra columns
    ps, season = seasonal
    if ps and season:
        scols = [f"y_s{k}" for k in range(1, ps + 1)]
        des = des.withColumns({f"y_s{k}": F.lag("z", k * season).over(w) for k in range(1, ps + 1)})
        cols = cols + scols
    return des, cols


def arma_grid(df: DataFrame, y: str, orders: Sequence[tuple[int, int]], d: int = 0, train_ratio: float = 0.7,
              keys=(), order_by: str = "Date", seasonal: tuple[int, int] = (0, 0)) -> DataFrame:
    """M7: every (p, q) order fitted on the train rows of each series from
    ONE Gram of the widest design, then scored one step ahead on the test
    rows (actual lags, fixed parameters).  All orders of a series are solved
    next to its Gram row and joined back by series: the scans and the plan
    are the same for any number of series and orders.  Output: per
    (keys, p, q) errors."""
    from .evaluate import errors
    from .split import number_rows
    keys = list(keys)
    P = max(p for p, _ in orders)
    Q = max(q for _, q in orders)
    des, cols = arma_design(df, y, P, Q, d, keys=keys, order_by=order_by, seasonal=seasonal)
    n_season = seasonal[0] if seasonal[0] and seasonal[1] else 0
    nr = number_rows(des.dropna(subset=cols), keys, order_by)
    nr = nr.withColumn("role", F.when(F.col("rn") <= F.floor(F.col("n") * train_ratio), "train").otherwise("test"))
    nr = nr.withColumn("_series", F.lit(0))  # a key for the single series
    by = [*keys, "_series"]
    g = G.gram(nr.filter(F.col("role") == "train"), cols, "z", by=by)
    grid = [(p, q_, list(range(p)) + [P + j for j in range(q_)] + [P + Q + k for k in range(n_season)]) for p, q_ in orders]
    schema = T.StructType([*[g.schema[k] for k in by], T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType()),
                           T.StructField("intercept", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType()))])

    def fit(it):
        for pdf in it:
            out = []
            for r in pdf.to_dict("records"):
                gn = G.to_numpy(r)
                for p, q_, idx in grid:
                    part = {"n": gn["n"], "sx": gn["sx"][idx], "sy": gn["sy"], "xx": gn["xx"][np.ix_(idx, idx)],
                            "xy": gn["xy"][idx], "yy": gn["yy"]}
                    c, b = solve(part, "ols")
                    coef = np.zeros(len(gn["sx"]))
                    coef[idx] = b
                    out.append([*[r[k] for k in by], p, q_, c, coef.tolist()])
            if out:
                yield pd.DataFrame(out, columns=schema.names)

    test = nr.filter(F.col("role") == "test").select(*by, F.col("z").alias("y"), *cols)
    scored = test.join(g.mapInPandas(fit, schema), on=by)
    scored = scored.withColumn("yhat", predict_expr(cols, F.col("coef"), F.col("intercept")))
    return errors(scored, "y", "yhat", by=[*keys, "p", "q"])


def to_gram_dict(row) -> dict:
    return G.to_numpy(row.asDict() if hasattr(row, "asDict") else row)


# M4 / M5 --------------------------------------------------------------------
VARIANCE = {"poisson": 1.0, "gamma": 2.0}  # the variance of a family is the mean to this power


@dataclass
class LogLinear:
    """A generalised linear model with a log link."""

    intercept: float
    coefficients: np.ndarray


def log_link_fit(df: DataFrame, x_cols: Sequence[str], y: str, power: float, max_iter: int = 25, tol: float = 1e-6) -> LogLinear:
    """M4 with a log link and a variance of mean ** ``power``, by iteratively
    reweighted least squares.  A pass sums the weighted products of the columns
    as built-in aggregates, and the step is solved from the residuals, so that
    it vanishes at the optimum and no passes follow on rounding.  Rows with a null are left out."""
    p = len(x_cols)
    rows = df.select(*[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(x_cols)], q(y).cast("double").alias("y")).dropna()
    if (least := rows.agg(F.min("y")).first()[0]) is None:
        raise ValueError("no rows to fit")
    if least < 0 or (power >= 2 and least == 0):
        raise ValueError("labels below the range of the family")
    one = [F.lit(1.0), *[F.col(f"x{i}") for i in range(p)]]
    beta: np.ndarray | None = None
    for _ in range(max_iter):
        # the first pass starts from the labels themselves
        eta = F.log(F.greatest(F.col("y"), F.lit(0.1)) if power == 1 else F.when(F.col("y") == 0, F.lit(0.1)).otherwise(F.col("y")))
        if beta is not None:
            eta = sum((F.lit(float(b)) * x for b, x in zip(beta[1:], one[1:], strict=True)), F.lit(float(beta[0])))
        at = rows.withColumn("eta", eta).withColumn("mu", F.exp("eta"))
        work = (F.col("y") - F.col("mu")) / F.col("mu") + (F.col("eta") if beta is None else F.lit(0.0))
        at = at.withColumn("w", F.pow("mu", F.lit(2.0 - power)) if power != 1 else F.col("mu")).withColumn("z", work)
        cells = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
        s = at.agg(*[F.sum(F.col("w") * one[i] * one[j]) for i, j in cells], *[F.sum(F.col("w") * F.col("z") * c) for c in one]).first()
        a = np.zeros((p + 1, p + 1))
        for (i, j), v in zip(cells, s, strict=False):
            a[i, j] = a[j, i] = v
        step = _centred_step(a, np.array(s[len(cells):], float))
        beta, done = (step, False) if beta is None else (beta + step, float(np.abs(step).max()) < tol)
        if done:
            break
    return LogLinear(float(beta[0]), beta[1:])


def _centred_step(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of weighted normal equations whose first column is the
    constant; columns without variance get 0."""
    mean, to = a[0, 1:] / a[0, 0], b[0] / a[0, 0]
    cov, rhs = a[1:, 1:] - np.outer(mean, mean) * a[0, 0], b[1:] - mean * b[0]
    out = np.zeros(len(mean))
    some = np.diag(cov) > 1e-12 * np.diag(a)[1:]
    if some.any():
        out[some] = np.linalg.lstsq(cov[np.ix_(some, some)], rhs[some], rcond=None)[0]
    return np.concatenate([[to - mean @ out], out])


def _log_power(params: dict) -> float | None:
    """Variance power of a family with a log link; None for all other models."""
    if set(params) - {"family", "link", "variancePower", "linkPower", "maxIter", "tol"}:
        return None
    family = params.get("family")
    if family == "tweedie":
        power = params.get("variancePower")
        return power if params.get("linkPower") == 0.0 and power is not None and 1 <= power <= 2 else None
    return VARIANCE.get(family) if params.get("link", "log" if family == "poisson" else None) == "log" else None


def ml_fit(df: DataFrame, x_cols: Sequence[str], y: str, kind: str = "tree", **params):
    """M4/M5 (distributed training): ``glm`` (family=…), with a log link by
    :func:`log_link_fit`, else through Spark ML like ``tree``, ``forest`` and
    ``gbt`` (boosted stumps stand in for AdaBoost, declared)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml import regression as R
    va = VectorAssembler(inputCols=list(x_cols), outputCol="features", handleInvalid="skip")
    if kind == "glm" and (power := _log_power(params)) is not None:
        return log_link_fit(df, x_cols, y, power, params.get("maxIter", 25), params.get("tol", 1e-6)), va
    est = {"glm": R.GeneralizedLinearRegression, "tree": R.DecisionTreeRegressor, "forest": R.RandomForestRegressor,
           "gbt": R.GBTRegressor, "linear": R.LinearRegression}[kind](labelCol=y, featuresCol="features", **params)
    data = va.transform(df)
    return est.fit(data), va


# W14 ------------------------------------------------------------------------
def rolling_ar1(df: DataFrame, y: str, past: int = 25, keys=(), order_by: str = "Date") -> DataFrame:
    """Sliding train window of ``past`` rows with a one-step forecast per
    row: y_s = a + b·y_{s−1} fitted by least squares on the pairs inside
    rows [t−past, t−1] (window ``regr_*`` aggregates), ŷ_t = a + b·y_{t−1}.
    Re-aimed from a per-window ARMA(1,1) maximum-likelihood fit (declared).
    The forecast error is only ever used lagged (``err_lag1``)."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order_by)
    frame = w.rowsBetween(-past, -1)
    d = df.withColumn("_y1", F.lag(y, 1).over(w))
    d = d.withColumns({"_b": F.regr_slope(y, "_y1").over(frame), "_a": F.regr_intercept(y, "_y1").over(frame),
                       "_k": F.regr_count(y, "_y1").over(frame)})
    d = d.withColumn("yhat", F.when(F.col("_k") == past, F.col("_a") + F.col("_b") * F.col("_y1")))
    d = d.withColumn("err", F.col(y) - F.col("yhat")).withColumn("err_lag1", F.lag("err", 1).over(w))
    return d.drop("_y1", "_b", "_a", "_k")
