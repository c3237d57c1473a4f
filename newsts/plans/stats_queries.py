"""Statistics, models, splits and evaluation (G, X, M, V)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..operators import gram as G
from ..operators import lagged as W
from ..operators import models as M
from ..operators import select as X
from ..operators import stats as ST
from ..operators.aggregate import summarize_folds
from ..operators.split import number_rows, ordered_split, repeated_folds, time_folds_df, assign_folds
from ..sources import tables as S
from .core_queries import ODAILY, EWIDE
from .ols_sql import fitted, ols_ctes
from .registry import register

LI_X = ["l_quantity", "l_discount", "l_tax"]


def _coefficients(fit, by, xs, digits=3):
    """Fitted rows with a rounded column for the intercept and each regressor."""
    return fit.select(*by, F.round("intercept", digits).alias("intercept"),
                      *[F.round(F.col("coef")[i], digits).alias(x) for i, x in enumerate(xs)])


def _r(df, cols, d=6):
    return df.withColumns({c: F.round(c, d) for c in cols})


# V5 / V6 -----------------------------------------------------------------------------
@register("metrics", f"""WITH {ODAILY}, r AS (SELECT "Price" AS y, lag("Price") OVER (ORDER BY "Date") AS yhat FROM od)
SELECT count(*) AS n, round(avg(abs(yhat - y)), 6) AS mae, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse,
       round(avg(abs(yhat - y) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape,
       round(1 - sum((yhat - y) * (yhat - y)) / (var_pop(y) * count(y)), 6) AS r2
FROM r WHERE yhat IS NOT NULL""")
def metrics(spark, sf):
    d = M.random_walk(S.orders_daily(spark, sf), "Price")
    return _r(V.errors(d, "Price", "yhat"), ["mae", "rmse", "mape", "r2"])


@register("mape_zero", """
SELECT l_returnflag, count(*) AS n, round(avg(abs(l_tax - l_discount)), 6) AS mae,
  round(sqrt(avg((l_tax - l_discount) * (l_tax - l_discount))), 6) AS rmse,
  round(avg(abs(l_tax - CASE WHEN l_discount = 0 THEN 0.01 ELSE l_discount END) / abs(CASE WHEN l_discount = 0 THEN 0.01 ELSE l_discount END)), 6) AS mape,
  round(1 - sum((l_tax - l_discount) * (l_tax - l_discount)) / (var_pop(l_discount) * count(l_discount)), 6) AS r2
FROM lineitem GROUP BY 1""")
def mape_zero(spark, sf):
    li = S.table(spark, sf, "lineitem")
    return _r(V.errors(li, "l_discount", "l_tax", by=["l_returnflag"], zero=0.01), ["mae", "rmse", "mape", "r2"])


# V1 / V2 / V4 ------------------------------------------------------------------------
@register("ordered_split", f"""WITH {ODAILY}, r AS (SELECT "Date", row_number() OVER (ORDER BY "Date") AS rn, count(*) OVER () AS n FROM od)
SELECT "Date", CASE WHEN rn > floor(n * 0.7) THEN 'test' WHEN rn > floor(n * 0.7) - 5 THEN 'val' ELSE 'train' END AS role FROM r""")
def ordered_split_q(spark, sf):
    return ordered_split(S.orders_daily(spark, sf), 0.7, val=5).select("Date", "role")


@register("ts_folds", """
WITH od AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS "Date" FROM orders GROUP BY 1, 2),
n AS (SELECT o_orderpriority, count(*) AS n FROM od GROUP BY 1),
f AS (SELECT o_orderpriority, n, CAST(floor(n / 6) AS INTEGER) AS ts, unnest(range(0, 5)) AS fold FROM n)
SELECT o_orderpriority, CAST(fold AS INTEGER) AS fold, CAST(n - (5 - fold) * ts + 1 AS INTEGER) AS test_start,
       CAST(n - (5 - fold) * ts + ts AS INTEGER) AS test_end, CAST(n - (5 - fold) * ts AS INTEGER) AS train_end FROM f""")
def ts_folds(spark, sf):
    o = S.table(spark, sf, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("Date")).distinct()
    lengths = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return time_folds_df(lengths, k=5, keys=["o_orderpriority"])


@register("repeated_kfold", f"""WITH {ODAILY}, n AS (SELECT count(*) AS n FROM od)
SELECT CAST(r AS INTEGER) AS repeat, CAST(f AS INTEGER) AS fold, n // 3 + CASE WHEN f < n % 3 THEN 1 ELSE 0 END AS rows
FROM n, range(10) t(r), range(3) u(f)""")
def repeated_kfold(spark, sf):
    """V4: fold sizes of 10 repeats × 3 folds (equal sizes)."""
    d = number_rows(S.orders_daily(spark, sf))
    return repeated_folds(d, 3, 10, 42).groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("rows"))


# M8 / V9 / A9 ---------------------------------------------------------------------------
_RW_FOLDS = f"""{ODAILY}, r AS (SELECT "Date", "Price", row_number() OVER (ORDER BY "Date") AS rn, count(*) OVER () AS n FROM od),
f AS (SELECT unnest(range(0, 5)) AS fold, max(n) AS n FROM r),
ff AS (SELECT fold, CAST(n - (5 - fold) * 5 + 1 AS BIGINT) AS test_start FROM f),
t AS (SELECT ff.fold, r.rn - ff.test_start + 1 AS h, r."Price" AS y, l."Price" AS yhat
      FROM ff JOIN r ON r.rn BETWEEN ff.test_start AND ff.test_start + 4 JOIN r l ON l.rn = ff.test_start - 1)"""


def _rw_folds(spark, sf):
    d = number_rows(S.orders_daily(spark, sf))
    lengths = d.select("n").distinct()
    folds = time_folds_df(lengths, k=5, test_size=5)
    return M.random_walk_folds(d, folds, "Price", h=5).withColumnRenamed("Price", "y")


@register("random_walk", f"""WITH {_RW_FOLDS}
SELECT CAST(fold AS INTEGER) AS fold, CAST(h AS INTEGER) AS h, round(y, 6) AS y, round(yhat, 6) AS yhat FROM t""")
def random_walk(spark, sf):
    t = _rw_folds(spark, sf)
    return t.select("fold", F.col("h").cast("int").alias("h"), F.round("y", 6).alias("y"), F.round("yhat", 6).alias("yhat"))


@register("cv_summary", f"""WITH {_RW_FOLDS},
e AS (SELECT fold, avg(abs(yhat - y)) AS mae, sqrt(avg((yhat - y) * (yhat - y))) AS rmse,
             avg(abs(yhat - y) / greatest(abs(y), 2.220446049250313e-16)) AS mape FROM t GROUP BY fold)
SELECT round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_std, round(avg(rmse), 6) AS rmse_mean,
       round(stddev_samp(rmse), 6) AS rmse_std, round(avg(mape), 6) AS mape_mean, round(stddev_samp(mape), 6) AS mape_std,
       round(stddev_pop(mae), 6) AS mae_std_pop FROM e""")
def cv_summary(spark, sf):
    t = _rw_folds(spark, sf)
    per = V.errors(t, "y", "yhat", by=["fold"])
    s = summarize_folds(per, ["mae", "rmse", "mape"], ddof=1)
    pop = summarize_folds(per, ["mae"], ddof=0).select(F.col("mae_std").alias("mae_std_pop"))
    s = s.withColumn("mae_std_pop", pop.select("mae_std_pop").scalar())
    return _r(s, s.columns)


@register("walk_forward", f"""WITH {ODAILY}, d AS (SELECT "Date", "Price" AS y, lag("Price") OVER (ORDER BY "Date") AS x FROM od),
p AS (SELECT *, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a, count(x) OVER w AS k
      FROM d WINDOW w AS (ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT "Date", round(CASE WHEN k >= 3 THEN a + b * x END, 2) AS yhat FROM p WHERE x IS NOT NULL""")
def walk_forward(spark, sf):
    """yesterday's price as the regressor, refitted for every day."""
    d = S.orders_daily(spark, sf).withColumn("x", F.lag("Price").over(Window.orderBy("Date")))
    d = V.walk_forward(d, ["x"], "Price")
    return d.select("Date", F.round("yhat", 2).alias("yhat"))


@register("cv_linear_gap", f"""WITH {ODAILY}, d AS (SELECT "Date", "Price" AS y, lag("Price") OVER (ORDER BY "Date") AS x FROM od),
r AS (SELECT *, row_number() OVER (ORDER BY "Date") AS rn, count(*) OVER () AS n FROM d WHERE x IS NOT NULL),
f AS (SELECT fold, (SELECT max(n) FROM r) AS n FROM range(5) t(fold)),
g AS (SELECT fold, n - (5 - fold) * (n // 6) + 1 AS ts, n - (5 - fold) * (n // 6) + n // 6 AS te, n - (5 - fold) * (n // 6) - 5 AS tr FROM f),
m AS (SELECT fold, ts, te, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM g JOIN r ON rn <= tr GROUP BY 1, 2, 3)
SELECT fold, count(*) AS n, round(avg(abs(a + b * x - y)), 4) AS mae, round(sqrt(avg((a + b * x - y) ** 2)), 4) AS rmse
FROM m JOIN r ON rn BETWEEN ts AND te GROUP BY fold""")
def cv_linear_gap(spark, sf):
    """V8 with a gap of 5 rows: no fold trains on the rows of its gap."""
    d = S.orders_daily(spark, sf).withColumn("x", F.lag("Price").over(Window.orderBy("Date"))).dropna()
    d = number_rows(d.withColumnRenamed("Price", "y"))
    folds = time_folds_df(d.select("n").distinct(), k=5, gap=5)
    per, _ = V.cv_linear(d, folds, ["x"], "y")
    return per.select(F.col("fold").cast("long").alias("fold"), "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@register("linear_1d", """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1""")
def linear_1d(spark, sf):
    li = S.table(spark, sf, "lineitem")
    g = G.gram(li, ["l_quantity"], "l_extendedprice", by=["l_returnflag"])
    p = M.linear_fit(g, by=["l_returnflag"], kind="ols")
    return p.select("l_returnflag", F.round(F.col("coef")[0], 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@register("ridge_1d", """
SELECT l_returnflag, round(covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 1000.0), 4) AS slope
FROM lineitem GROUP BY 1""")
def ridge_1d(spark, sf):
    li = S.table(spark, sf, "lineitem")
    g = G.gram(li, ["l_quantity"], "l_extendedprice", by=["l_returnflag"])
    p = M.linear_fit(g, by=["l_returnflag"], kind="ridge", alpha=1000.0)
    return p.select("l_returnflag", F.round(F.col("coef")[0], 4).alias("slope"))


# X11 / X13 / X14 / X12 ----------------------------------------------------------------------
@register("pearson_topk", """
WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS l_quantity, corr(l_discount, l_extendedprice) AS l_discount,
                  corr(l_tax, l_extendedprice) AS l_tax FROM lineitem)
SELECT col, round(r, 6) AS r FROM (UNPIVOT c ON l_quantity, l_discount, l_tax INTO NAME col VALUE r)
ORDER BY abs(r) DESC, col LIMIT 2""")
def pearson_topk(spark, sf):
    r = ST.top_by_corr(S.table(spark, sf, "lineitem"), LI_X, "l_extendedprice", 2)
    return r.withColumn("r", F.round("r", 6))


@register("variance_filter", """
WITH c AS (SELECT var_pop(l_quantity) AS l_quantity, var_pop(l_discount) AS l_discount, var_pop(l_tax) AS l_tax FROM lineitem)
SELECT col, round(var, 6) AS var FROM (UNPIVOT c ON l_quantity, l_discount, l_tax INTO NAME col VALUE var) WHERE var > 3.21""")
def variance_filter(spark, sf):
    return ST.by_variance(S.table(spark, sf, "lineitem"), LI_X, 3.21).withColumn("var", F.round("var", 6))


@register("series_stats", f"""WITH {EWIDE},
l AS (SELECT "Date", col, y FROM (UNPIVOT ew ON click, "view", signup, error, purchase INTO NAME col VALUE y)),
w AS (SELECT *, row_number() OVER o AS rn, lag(y) OVER o AS prev, lead(y) OVER o AS nxt FROM l WINDOW o AS (PARTITION BY col ORDER BY "Date")),
mm AS (SELECT col, min(y) AS lo, max(y) AS hi FROM l GROUP BY col),
b AS (SELECT w.col, CASE WHEN (hi - lo) / 10 = 0 THEN 0 ELSE least(floor((y - lo) / ((hi - lo) / 10)), 9) END AS bin FROM w JOIN mm USING (col)),
h AS (SELECT col, bin, count(*) AS c FROM b GROUP BY 1, 2),
e AS (SELECT col, -sum(c / t * ln(c / t)) AS entropy FROM h JOIN (SELECT col, sum(c) AS t FROM h GROUP BY col) USING (col) GROUP BY col)
SELECT col, round(sum(y * y), 6) AS abs_energy, round(sum(y * prev), 6) AS autocorr,
       CAST(sum(CASE WHEN y > prev AND y > nxt THEN 1 ELSE 0 END) AS BIGINT) AS peaks, round(regr_slope(y, rn), 6) AS slope,
       round(any_value(e.entropy), 6) AS entropy
FROM w JOIN e USING (col) GROUP BY col""")
def series_stats(spark, sf):
    s = ST.series_stats(S.events_daily_wide(spark, sf), S.EVENT_TYPES)
    return _r(s, ["abs_energy", "autocorr", "slope", "entropy"])


@register("binned_mi", """
WITH l AS (SELECT l_extendedprice AS y, col, x FROM (UNPIVOT (SELECT l_extendedprice, l_quantity, l_discount, l_tax FROM lineitem)
           ON l_quantity, l_discount, l_tax INTO NAME col VALUE x)),
mm AS (SELECT col, min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM l GROUP BY col),
b AS (SELECT l.col, CASE WHEN (xh - xl) / 10 = 0 THEN 0 ELSE least(floor((x - xl) / ((xh - xl) / 10)), 9) END AS bx,
             CASE WHEN (yh - yl) / 10 = 0 THEN 0 ELSE least(floor((y - yl) / ((yh - yl) / 10)), 9) END AS by_ FROM l JOIN mm USING (col)),
ct AS (SELECT col, bx, by_, count(*) AS n FROM b GROUP BY 1, 2, 3),
nn AS (SELECT col, sum(n) AS tot FROM ct GROUP BY col),
px AS (SELECT col, bx, sum(n) AS nx FROM ct GROUP BY 1, 2), py AS (SELECT col, by_, sum(n) AS ny FROM ct GROUP BY 1, 2)
SELECT col, round(sum(n / tot * ln(n * tot / (nx * ny))), 6) AS mi FROM ct JOIN nn USING (col) JOIN px USING (col, bx) JOIN py USING (col, by_)
GROUP BY col""")
def binned_mi(spark, sf):
    return ST.binned_mi(S.table(spark, sf, "lineitem"), LI_X, "l_extendedprice").withColumn("mi", F.round("mi", 6))


# X3 ---------------------------------------------------------------------------------------
@register("acf", f"""WITH {ODAILY}, c AS (SELECT "Date", "Price" - avg("Price") OVER () AS c FROM od),
p AS (SELECT {', '.join(f'c * lag(c, {k}) OVER (ORDER BY "Date") AS p{k}' for k in range(11))} FROM c),
s AS (SELECT {', '.join(f'sum(p{k}) AS s{k}' for k in range(11))} FROM p)
{' UNION ALL '.join(f'SELECT CAST({k} AS INTEGER) AS lag, round(s{k} / s0, 6) AS acf FROM s' for k in range(11))}""")
def acf(spark, sf):
    a = ST.acf(S.orders_daily(spark, sf), "Price", 10)
    return a.select(F.col("lag").cast("int").alias("lag"), F.round("acf", 6).alias("acf"))


def _levinson(n):
    """The Durbin-Levinson recursion over the autocorrelations r1..rn of one row."""
    ctes = ["l1 AS (SELECT *, r1 AS f1_1 FROM r)"]
    for k in range(2, n + 1):
        num = f"r{k}" + "".join(f" - f{k - 1}_{j} * r{k - j}" for j in range(1, k))
        den = "1" + "".join(f" - f{k - 1}_{j} * r{j}" for j in range(1, k))
        ctes.append(f"p{k} AS (SELECT *, ({num}) / ({den}) AS f{k}_{k} FROM l{k - 1})")
        rest = "".join(f", f{k - 1}_{j} - f{k}_{k} * f{k - 1}_{k - j} AS f{k}_{j}" for j in range(1, k))
        ctes.append(f"l{k} AS (SELECT *{rest} FROM p{k})")
    return ", ".join(ctes)


@register("pacf", f"""WITH {ODAILY}, c AS (SELECT "Date", "Price" - avg("Price") OVER () AS c FROM od),
p AS (SELECT {', '.join(f'c * lag(c, {k}) OVER (ORDER BY "Date") AS p{k}' for k in range(11))} FROM c),
r AS (SELECT {', '.join(f'sum(p{k}) / sum(p0) AS r{k}' for k in range(1, 11))} FROM p), {_levinson(10)}
SELECT CAST(0 AS INTEGER) AS lag, 1.0 AS pacf UNION ALL
{' UNION ALL '.join(f'SELECT CAST({k} AS INTEGER), round(f{k}_{k}, 6) FROM l10' for k in range(1, 11))}""")
def pacf(spark, sf):
    p = ST.pacf(ST.acf(S.orders_daily(spark, sf), "Price", 10))
    return p.select(F.col("lag").cast("int").alias("lag"), F.round("pacf", 6).alias("pacf"))


# X6 (window form) ----------------------------------------------------------------------------
@register("decompose_window", f"""WITH {ODAILY},
w AS (SELECT "Date", "Price", row_number() OVER o AS rn,
        (0.5 * lag("Price", 5) OVER o + lag("Price", 4) OVER o + lag("Price", 3) OVER o + lag("Price", 2) OVER o + lag("Price", 1) OVER o + "Price" + lead("Price", 1) OVER o + lead("Price", 2) OVER o + lead("Price", 3) OVER o + lead("Price", 4) OVER o + 0.5 * lead("Price", 5) OVER o) / 10 AS trend
      FROM od WINDOW o AS (ORDER BY "Date")),
ph AS (SELECT (rn - 1) % 10 AS phase, avg("Price" - trend) AS pm FROM w WHERE trend IS NOT NULL GROUP BY 1),
sea AS (SELECT phase, pm - (SELECT avg(pm) FROM ph) AS seasonal FROM ph)
SELECT "Date", round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round("Price" - trend - seasonal, 6) AS residual
FROM w JOIN sea ON sea.phase = (w.rn - 1) % 10""")
def decompose_window(spark, sf):
    d = ST.decompose_classical(S.orders_daily(spark, sf), "Price", 10)
    return d.select("Date", *[F.round(c, 6).alias(c) for c in ("trend", "seasonal", "residual")])


# rows-only: Gram solvers, tests, selection, ARMA, hybrid --------------------------------------
_XW = ["click", "view", "signup", "error"]


def _events_lagged(spark, sf):
    wide = S.events_daily_wide(spark, sf)
    sup = W.supervised(wide, S.EVENT_TYPES, 1, 1)
    return sup, [W.lag_name(c, 1) for c in S.EVENT_TYPES], "purchase(t)"


def _lineitem_split(spark, sf):
    li = S.table(spark, sf, "lineitem")
    return li, LI_X, "l_extendedprice"


@register("linear_multi", f"""WITH {ols_ctes("lineitem", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", ["l_returnflag"])}
SELECT l_returnflag, round(c, 3) AS intercept, round(b0, 3) AS l_quantity, round(b1, 3) AS l_discount, round(b2, 3) AS l_tax FROM ols""")
def linear_multi(spark, sf):
    """M1 on every lineitem row: one Gram pass, one solve per return flag."""
    li, xs, y = _lineitem_split(spark, sf)
    g = G.gram(li, xs, y, by=["l_returnflag"])
    return _coefficients(M.linear_fit(g, by=["l_returnflag"], kind="ols"), ["l_returnflag"], xs)


@register("lasso")
def lasso(spark, sf):
    """M3 (alpha 1) by coordinate descent on the Gram."""
    li, xs, y = _lineitem_split(spark, sf)
    return M.linear_fit(G.gram(li, xs, y), kind="lasso", alpha=1.0)


@register("rfe")
def rfe(spark, sf):
    """RFE with Lasso on min-max scaled lagged event features → 2 kept."""
    sup, xs, y = _events_lagged(spark, sf)
    g = G.gram(sup, xs, y)
    return X.rfe(g, xs, 2, kind="lasso", alpha=0.01)


def _lineitem_days(spark, sf):
    """lineitem rows with the row number of their ship day: rows are never
    numbered one by one (that would be one task); the distinct days are."""
    li = S.table(spark, sf, "lineitem").withColumn("Date", F.to_date("l_shipdate"))
    days = number_rows(li.select("Date").distinct())
    return li.join(days, on="Date", how="inner")


@register("forward_select")
def forward_select(spark, sf):
    """Forward selection of 2 lineitem columns by 5 time folds over ship
    days, scored by mean test R² from block Grams (one scan)."""
    li = _lineitem_days(spark, sf)
    folds = time_folds_df(li.select("n").distinct(), k=5)
    lab = assign_folds(li, folds).withColumn("_blk", F.coalesce("fold", F.lit(-1)))
    g = G.gram(lab, LI_X, "l_extendedprice", by=["_blk"])
    return X.forward_select(g, LI_X, 2)


@register("select_by_coef")
def select_by_coef(spark, sf):
    sup, xs, y = _events_lagged(spark, sf)
    return X.select_by_coef(G.gram(sup, xs, y), xs, "lasso", 0.05, max_features=3)


@register("granger")
def granger(spark, sf):
    wide = S.events_daily_wide(spark, sf)
    return ST.granger(wide, "purchase", _XW, 3)


@register("adf")
def adf(spark, sf):
    return ST.adf(S.orders_daily(spark, sf, keys=["o_orderpriority"]).groupBy("Date")
                  .pivot("o_orderpriority", ["1-URGENT", "2-HIGH"]).agg(F.first("Price")).select("Date", "`1-URGENT`", "`2-HIGH`")
                  .withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high"}).dropna(), ["urgent", "high"])


@register("var_order")
def var_order(spark, sf):
    wide = S.events_daily_wide(spark, sf)
    return ST.var_order(wide, ["click", "purchase"], 3)


@register("make_stationary", f"""WITH {ODAILY},
w AS (SELECT "Date", sum(CAST(round("Price" * 100) AS BIGINT)) OVER (ORDER BY "Date") AS s FROM od),
x AS (SELECT "Date", s - lag(s) OVER (ORDER BY "Date") AS d FROM w)
SELECT "Date", CAST(d AS BIGINT) AS cents, 1 AS "order" FROM x WHERE d IS NOT NULL""")
def make_stationary(spark, sf):
    """Difference until every column's ADF p-value ≤ 0.05; the running
    sum of the daily prices needs one difference, which gives them back."""
    from ..operators.stats import make_stationary as ms
    d = S.orders_daily(spark, sf)
    cents = F.round(F.col("Price") * 100).cast("long")
    walk = d.select("Date", F.sum(cents).over(Window.orderBy("Date")).alias("Price"))
    out, order, _ = ms(walk, ["Price"])
    return out.select("Date", F.round("Price").cast("long").alias("cents"), F.lit(order).alias("order"))


@register("arma_grid")
def arma_grid(spark, sf):
    """M6/M7: orders (p, q) ∈ {0..2}² \\ (0,0) on daily orders, d = 1."""
    orders = [(p, q) for p in range(3) for q in range(3) if p + q > 0]
    return M.arma_grid(S.orders_daily(spark, sf), "Price", orders, d=1)


@register("best_arma")
def best_arma(spark, sf):
    """O8 over the M7 grid: arg-min of (rmse+mae+mape)/3."""
    from ..operators.align import best_config
    g = M.arma_grid(S.orders_daily(spark, sf), "Price", [(1, 0), (2, 0), (1, 1), (0, 1)], d=1)
    return best_config(g, config=("p", "q"))


@register("refit", f"""WITH {ols_ctes("lineitem", LI_X, "l_extendedprice")}
SELECT round(c, 3) AS intercept, round(b0, 3) AS l_quantity, round(b1, 3) AS l_discount, round(b2, 3) AS l_tax FROM ols""")
def refit(spark, sf):
    """The Gram of the first 70 % of ship days plus the Gram of the
    rest equals the full Gram, so the refit equals a fit on all rows."""
    li = _lineitem_days(spark, sf)
    old = G.gram(li.filter(F.col("rn") <= F.col("n") * 0.7), LI_X, "l_extendedprice")
    new_rows = li.filter(F.col("rn") > F.col("n") * 0.7)
    return _coefficients(M.linear_fit(M.refit(old, new_rows, LI_X, "l_extendedprice")), [], LI_X)


_EX = [f"x{i}" for i in range(5)]
# lagged event means x0..x4 and the label y, numbered in time order
EVENT_ROWS = f"""{EWIDE}, xy AS (SELECT "Date", {', '.join(f'lag("{c}") OVER (ORDER BY "Date") AS x{i}' for i, c in enumerate(S.EVENT_TYPES))}, "purchase" AS y FROM ew),
sp AS (SELECT *, row_number() OVER (ORDER BY "Date") AS rn, count(*) OVER () AS n FROM xy
       WHERE {' AND '.join(f'x{i} IS NOT NULL' for i in range(5))} AND y IS NOT NULL)"""


@register("cv_linear", f"""WITH {EVENT_ROWS},
f AS (SELECT fold, n - (5 - fold) * (n // 6) AS tr, n // 6 AS ts FROM range(5) t(fold), (SELECT max(n) AS n FROM sp)),
trf AS (SELECT fold, sp.* FROM f JOIN sp ON rn <= tr), {ols_ctes("trf", _EX, "y", ["fold"], alpha=1.0)},
s AS (SELECT fold, y, {fitted(_EX)} AS p FROM f JOIN ols USING (fold) JOIN sp ON rn > tr AND rn <= tr + ts),
e AS (SELECT fold, avg(abs(p - y)) AS mae, sqrt(avg((p - y) ** 2)) AS rmse, avg(abs(p - y) / abs(y)) AS mape FROM s GROUP BY fold)
SELECT {', '.join(f'round(avg({m}), 5) AS {m}_mean, round(stddev_pop({m}), 5) AS {m}_std' for m in ("mae", "rmse", "mape"))} FROM e""")
def cv_linear(spark, sf):
    """V8: ridge on lagged event features, 5 time folds from prefix Grams."""
    sup, xs, y = _events_lagged(spark, sf)
    d = number_rows(sup)
    folds = time_folds_df(d.select("n").distinct(), k=5)
    per, summ = V.cv_linear(d, folds, xs, y, kind="ridge", alpha=1.0)
    return summ.select(*[F.round(c, 5).alias(c) for c in summ.columns])


@register("holdout_r2", f"""WITH days AS (SELECT d, row_number() OVER (ORDER BY d) AS rn, count(*) OVER () AS n
    FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)),
li AS (SELECT l.*, rn <= floor(n * 2 / 3) AS train FROM lineitem l JOIN days ON CAST(l_shipdate AS DATE) = d),
tr AS (SELECT * FROM li WHERE train), {ols_ctes("tr", LI_X, "l_extendedprice")},
s AS (SELECT l_extendedprice AS y, {fitted(LI_X)} AS yhat FROM li, ols WHERE NOT train)
SELECT count(*) AS n, round(avg(abs(yhat - y)), 3) AS mae, round(sqrt(avg((yhat - y) ** 2)), 3) AS rmse,
       round(1 - sum((yhat - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM s""")
def holdout_r2(spark, sf):
    """One 2/3 hold-out (by ship day) fit and its R²."""
    li = _lineitem_days(spark, sf)
    li = li.withColumn("role", F.when(F.col("rn") <= F.floor(F.col("n") * 2 / 3), "train").otherwise("test"))
    r = V.holdout(li, LI_X, "l_extendedprice")
    return r.select("n", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("r2", 6).alias("r2"))


# W14 ----------------------------------------------------------------------------------------
@register("rolling_ar", f"""WITH {ODAILY}, d AS (SELECT "Date", "Price" AS y, lag("Price") OVER (ORDER BY "Date") AS y1 FROM od),
w AS (SELECT "Date", y, y1, regr_slope(y, y1) OVER f AS b, regr_intercept(y, y1) OVER f AS a, regr_count(y, y1) OVER f AS k
      FROM d WINDOW f AS (ORDER BY "Date" ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING)),
e AS (SELECT "Date", CASE WHEN k = 25 THEN a + b * y1 END AS yhat, y FROM w)
SELECT "Date", round(yhat, 2) AS yhat, round(lag(y - yhat) OVER (ORDER BY "Date"), 2) AS err_lag1 FROM e""")
def rolling_ar(spark, sf):
    """25-row sliding train window, one-step forecast per row; its
    error is a feature only when lagged (D9)."""
    d = M.rolling_ar1(S.orders_daily(spark, sf), "Price", 25)
    return d.select("Date", F.round("yhat", 2).alias("yhat"), F.round("err_lag1", 2).alias("err_lag1"))


@register("sliding_arrays", f"""WITH {ODAILY}, w AS (SELECT "Date", count(*) OVER f AS n, sum("Price") OVER f AS s
  FROM od WINDOW f AS (ORDER BY "Date" ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING))
SELECT "Date", CAST(n AS INTEGER) AS n, round(s, 2) AS total FROM w WHERE n > 0""")
def sliding_arrays(spark, sf):
    """W14 windows themselves: the previous 25 values as an ordered array."""
    d = W.sliding_arrays(S.orders_daily(spark, sf), "Price", 25, name="past")
    d = d.filter(F.size("past") > 0)
    return d.select("Date", F.size("past").cast("int").alias("n"),
                    F.round(F.aggregate("past", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


# X8 / V3 / V11 ---------------------------------------------------------------------------
@register("rfe_cv")
def rfe_cv(spark, sf):
    """RFE with cross-validated subset size from ship-day block Grams."""
    li = _lineitem_days(spark, sf)
    folds = time_folds_df(li.select("n").distinct(), k=5)
    lab = assign_folds(li, folds).withColumn("_blk", F.coalesce("fold", F.lit(-1)))
    g = G.gram(lab, LI_X, "l_extendedprice", by=["_blk"])
    return X.rfe_cv(g, LI_X, kind="ols")


@register("ts_folds_gap", f"""WITH {ODAILY}, n AS (SELECT count(*) AS n FROM od),
f AS (SELECT n, CAST(floor(n / 6) AS INTEGER) AS ts, unnest(range(0, 5)) AS fold FROM n)
SELECT CAST(fold AS INTEGER) AS fold, CAST(n - (5 - fold) * ts + 1 AS INTEGER) AS test_start,
       CAST(n - (5 - fold) * ts + ts AS INTEGER) AS test_end, CAST(n - (5 - fold) * ts - 2 AS INTEGER) AS train_end FROM f""")
def ts_folds_gap(spark, sf):
    """V3: folds with a gap of h−1 = 2 rows between train and test."""
    d = S.orders_daily(spark, sf)
    lengths = d.agg(F.count(F.lit(1)).alias("n"))
    return time_folds_df(lengths, k=5, gap=2)


@register("scaled_errors", f"""WITH {ODAILY}, r AS (SELECT *, row_number() OVER (ORDER BY "Date") AS rn, count(*) OVER () AS n,
  lag("Price") OVER (ORDER BY "Date") AS yhat FROM od),
p AS (SELECT min("Price") AS lo, max("Price") AS hi FROM r WHERE rn <= floor(n * 0.7)),
s AS (SELECT ("Price" - lo) / (hi - lo) AS y, (yhat - lo) / (hi - lo) AS yh FROM r, p WHERE rn > floor(n * 0.7))
SELECT count(*) AS n, round(avg(abs(yh - y)), 6) AS mae, round(sqrt(avg((yh - y) * (yh - y))), 6) AS rmse,
       round(avg(abs(yh - y) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape,
       round(1 - sum((yh - y) * (yh - y)) / (var_pop(y) * count(y)), 6) AS r2 FROM s""")
def scaled_errors(spark, sf):
    """Test errors on the label rescaled with the train scaler."""
    from ..functions.scale import minmax_fit
    d = M.random_walk(S.orders_daily(spark, sf), "Price")
    sp = ordered_split(d, 0.7)
    params = minmax_fit(sp.filter("role = 'train'"), ["Price"])
    e = V.scaled_errors(sp.filter("role = 'test'"), params, "Price", "yhat")
    return _r(e, ["mae", "rmse", "mape", "r2"])


@register("decompose_stl")
def decompose_stl(spark, sf):
    """X6 (LOESS/STL, period 10) per order priority series."""
    d = S.orders_daily(spark, sf, keys=["o_orderpriority"])
    return ST.decompose_stl(d, "Price", 10, keys=["o_orderpriority"])


@register("sarima")
def sarima(spark, sf):
    """M6 seasonal form: (1, 2, 1) with one seasonal AR lag at 12, fitted by
    two-stage least squares on 70 % of the days, one-step test errors."""
    return M.arma_grid(S.orders_daily(spark, sf), "Price", [(1, 1)], d=2, seasonal=(1, 12))
