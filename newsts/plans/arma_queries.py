"""ARIMA queries (M6, M7, V9, W14) over the daily orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arma as A
from ..sources import tables as S
from .core_queries import ODAILY
from .ols_sql import fitted, ols_ctes
from .registry import register

PRIORITY = "o_orderpriority"


@register("arma_forecast", f"""WITH od AS (
  SELECT {PRIORITY}, CAST(o_orderdate AS DATE) AS "Date", avg(o_totalprice) AS y FROM orders GROUP BY 1, 2),
l AS (SELECT *, lag(y) OVER (PARTITION BY {PRIORITY} ORDER BY "Date") AS x FROM od),
f AS (SELECT {PRIORITY}, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, arg_max(y, "Date") AS z FROM l GROUP BY 1)
SELECT {PRIORITY}, CAST(h AS INTEGER) AS h, round(a * (1 - b ** h) / (1 - b) + b ** h * z, 4) AS yhat FROM f, range(1, 6) t(h)""")
def arma_forecast(spark, sf):
    """M6: AR(1) of each priority's daily price, five days ahead."""
    d = S.orders_daily(spark, sf, [PRIORITY])
    return A.arma_forecast(d, "Price", A.order(1), 5, [PRIORITY]).select(PRIORITY, "h", F.round("yhat", 4).alias("yhat"))


@register("arma_forecast_seasonal")
def arma_forecast_seasonal(spark, sf):
    """M6: (2, 1, 3)(1, 0, 1, 6) of each priority's daily price, five days
    ahead, differences undone."""
    d = S.orders_daily(spark, sf, [PRIORITY])
    return A.arma_forecast(d, "Price", A.order(2, 1, 3, 1, 0, 1, 6), 5, [PRIORITY])


_GRID = [A.order(1), A.order(2), A.order(1, 1)]
_MODELS = {(1, 0): ("g1", ["l1"], "y"), (2, 0): ("g2", ["l1", "l2"], "y"), (1, 1): ("g3", ["w1"], "w")}


def _grid_row(p: int, d: int) -> str:
    name, xs, y = _MODELS[p, d]
    e = f"({y} - ({fitted(xs, f'{name}.')}))"
    s2 = f"sum({e} ** 2) FILTER (tr) / count(*) FILTER (tr)"
    fit = f"count(*) FILTER (tr) * ln({s2})"
    k = len(xs) + 2
    return (f"SELECT CAST({p} AS INTEGER) AS p, CAST({d} AS INTEGER) AS d, count(*) FILTER (tr) AS n, round({s2} / 1000, 4) AS sigma2, "
            f"round({fit} + 2 * {k}, 4) AS aic, round({fit} + ln(count(*) FILTER (tr)) * {k}, 4) AS bic, "
            f"round(sqrt(avg({e} ** 2) FILTER (NOT tr)), 4) AS rmse_h1 FROM t, {name}")


@register("order_grid", f"""WITH {ODAILY},
r AS (SELECT "Price" AS y, lag("Price") OVER o AS l1, lag("Price", 2) OVER o AS l2, row_number() OVER o AS rn, count(*) OVER () AS n
      FROM od WINDOW o AS (ORDER BY "Date")),
t AS (SELECT *, y - l1 AS w, l1 - l2 AS w1, rn <= floor(n * 0.7) AS tr FROM r WHERE rn > 2),
train AS (SELECT * FROM t WHERE tr),
{', '.join(ols_ctes("train", xs, y, name=name) for name, xs, y in _MODELS.values())}
{' UNION ALL '.join(_grid_row(p, d) for p, d in _MODELS)}""")
def order_grid(spark, sf):
    """M7: orders with and without differences, AIC, BIC and test RMSE from
    one table of lagged product sums."""
    g = A.order_grid(S.orders_daily(spark, sf), "Price", _GRID, hs=(1,))
    return g.select("p", "d", "n", F.round(F.col("sigma2") / 1000, 4).alias("sigma2"), *[F.round(c, 4).alias(c) for c in ("aic", "bic", "rmse_h1")])


@register("order_grid_seasonal")
def order_grid_seasonal(spark, sf):
    """M7: the 48 orders and their seasonal forms with m in (6, 12), h = 1..3,
    each priority's best by BIC."""
    plain = [A.order(p, d, q) for p in range(1, 5) for d in range(3) for q in range(1, 5)]
    seasonal = [A.order(p, d, q, P, D, 1, m) for m in (6, 12) for p in range(1, 5) for d in range(2) for q in range(1, 3)
                for P in range(2) for D in range(2)]
    g = A.order_grid(S.orders_daily(spark, sf, [PRIORITY]), "Price", plain + seasonal, [PRIORITY])
    best = F.min_by(F.struct(*[c for c in g.columns if c != PRIORITY]), F.struct("bic", *A.ORDER_NAMES))
    return g.groupBy(PRIORITY).agg(best.alias("b"), F.count("*").alias("orders")).select(PRIORITY, "b.*", "orders")


@register("ts_cv", f"""WITH {ODAILY},
r AS (SELECT "Price" AS y, lag("Price") OVER (ORDER BY "Date") AS x, row_number() OVER (ORDER BY "Date") AS rn, count(*) OVER () AS n FROM od),
f AS (SELECT h, i, (SELECT max(n) FROM r) - (10 - i) * h AS cut FROM range(1, 4) a(h), range(0, 10) b(i)),
m AS (SELECT h, i, cut, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, arg_max(y, rn) AS z FROM f JOIN r ON r.rn <= f.cut GROUP BY h, i, cut),
e AS (SELECT m.h, i, y, a * (1 - b ** s) / (1 - b) + b ** s * z AS yhat
      FROM m JOIN range(1, 4) c(s) ON s <= m.h JOIN r ON r.rn = m.cut + s),
p AS (SELECT h, i, avg(abs(yhat - y)) AS mae, sqrt(avg((yhat - y) ** 2)) AS rmse, avg(abs(yhat - y) / abs(y)) AS mape FROM e GROUP BY h, i)
SELECT CAST(h AS INTEGER) AS h, {', '.join(f'round(avg({c}), 5) AS {c}_mean, round(stddev_samp({c}), 5) AS {c}_std' for c in ('mae', 'rmse', 'mape'))}
FROM p GROUP BY h""")
def ts_cv(spark, sf):
    """V9: AR(1) refitted in ten time folds for each horizon, mean and sample
    deviation of the errors."""
    _, s = A.ts_cv(S.orders_daily(spark, sf), "Price", [A.order(1)])
    return s.select("h", *[F.round(f"{c}_{k}", 5).alias(f"{c}_{k}") for c in ("mae", "rmse", "mape") for k in ("mean", "std")])


@register("ts_cv_arma")
def ts_cv_arma(spark, sf):
    """V9: ARMA orders in ten time folds of every priority's series, h = 1..3."""
    _, s = A.ts_cv(S.orders_daily(spark, sf, [PRIORITY]), "Price", [A.order(1, 0, 1), A.order(2, 1, 3), A.order(1, 1, 1, 1, 0, 0, 6)], keys=[PRIORITY])
    return s


@register("rolling_arma")
def rolling_arma(spark, sf):
    """Sliding ARMA(1,1) over 25 days of every priority's series; its
    error is used lagged only."""
    return A.rolling_arma(S.orders_daily(spark, sf, [PRIORITY]), "Price", 25, [PRIORITY])
