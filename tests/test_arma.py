"""ARIMA from lagged product sums against explicit designs in numpy."""

import numpy as np
import pandas as pd
import pytest

from newsts.operators import arma as A

N = 260


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(0)
    out = {}
    for k in range(3):
        e, y = rng.normal(size=N), np.zeros(N)
        for t in range(2, N):
            y[t] = 0.6 * y[t - 1] + e[t] + 0.4 * e[t - 1]
        out[f"s{k}"] = 5000 + np.cumsum(y) * 0.3 + y
    return out


@pytest.fixture(scope="module")
def df(spark, series):
    rows = [(k, i, float(v)) for k, ys in series.items() for i, v in enumerate(ys)]
    rows += [("s0", 10_000, None), ("s0", 10_001, float("nan")), ("short", 0, 1.0), ("short", 1, 2.0)]
    return spark.createDataFrame(rows, "series string, Date int, y double").cache()


def explicit(y, o, K, stage, rows, steps=None):
    """(sum of squares, forecast from a row) of a design written out row by row."""
    p, d, q, P, D, Q, m = o
    w = y.copy()
    for _ in range(d):
        w = np.concatenate([[np.nan], np.diff(w)])
    for _ in range(D):
        w = np.concatenate([np.full(m, np.nan), w[m:] - w[:-m]])
    at = np.arange(K, rows)
    ar = sorted({*range(1, p + 1), *[m * i for i in range(1, P + 1)]})
    ma = sorted({*range(1, q + 1), *[m * i for i in range(1, Q + 1)]})
    e = np.full(len(y), np.nan)
    if ma:
        x = np.column_stack([np.ones(len(at))] + [w[at - i] for i in range(1, stage + 1)])
        a = np.linalg.lstsq(x, w[at], rcond=None)[0]
        for t in range(stage + d + D * m, len(y)):
            e[t] = w[t] - a[0] - sum(a[i] * w[t - i] for i in range(1, stage + 1))
    x = np.column_stack([np.ones(len(at))] + [w[at - i] for i in ar] + [e[at - i] for i in ma])
    b = np.linalg.lstsq(x, w[at], rcond=None)[0]
    left = w[at] - x @ b
    poly = A._poly(d, D, m)

    def ahead(row, h):
        ws, es, ys = list(w[:row + 1]), list(e[:row + 1]), list(y[:row + 1])
        for _ in range(h):
            t = len(ws)
            v = b[0] + sum(c * ws[t - i] for c, i in zip(b[1:], ar)) + sum(c * es[t - i] for c, i in zip(b[1 + len(ar):], ma))
            ys.append(v - sum(poly[i] * ys[t - i] for i in range(1, len(poly))))
            ws.append(v)
            es.append(0.0)
        return np.array(ys[row + 1:])
    return float(left @ left), ahead


ORDERS = [A.order(1), A.order(2, 1), A.order(1, 1, 1), A.order(2, 1, 3), A.order(1, 0, 1, 1, 0, 1, 6), A.order(1, 2, 1, 1, 0, 0, 12),
          A.order(0, 1, 1, 0, 1, 1, 4)]


def test_grid_equals_explicit_designs(df, series):
    stage, hs = A.long_ar(ORDERS), (1, 2, 3)
    got = {(r["series"], *[r[c] for c in A.ORDER_NAMES]): r for r in A.order_grid(df, "y", ORDERS, ["series"], hs=hs).collect()}
    assert len(got) == len(series) * len(ORDERS)  # the short series has no fit
    K, cut = max(A.depth(o, stage) for o in ORDERS) + max(hs) - 1, int(N * 0.7)
    for o in ORDERS:
        r = got["s1", *o]
        sse, ahead = explicit(series["s1"], o, K, stage, cut)
        n = cut - K
        assert r["n"] == n and r["sigma2"] == pytest.approx(sse / n, rel=1e-7)
        params = 2 + len({*range(1, o[0] + 1), *[o[6] * i for i in range(1, o[3] + 1)]}) + len({*range(1, o[2] + 1), *[o[6] * i for i in range(1, o[5] + 1)]})
        assert r["aic"] == pytest.approx(n * np.log(sse / n) + 2 * params, rel=1e-7)
        for h in hs:
            errors = [series["s1"][t] - ahead(t - h, h)[-1] for t in range(cut, N)]
            assert r[f"rmse_h{h}"] == pytest.approx(np.sqrt(np.mean(np.square(errors))), rel=1e-6)


@pytest.mark.parametrize("o", ORDERS)
def test_forecast(df, series, o):
    got = A.arma_forecast(df, "y", o, 5, ["series"]).collect()
    stage = A.long_ar([o])
    assert {r["series"] for r in got} == set(series)
    for k, y in series.items():
        _, ahead = explicit(y, o, max(A.depth(o, stage), 1), stage, N)
        path = [r["yhat"] for r in sorted((r for r in got if r["series"] == k), key=lambda r: r["h"])]
        np.testing.assert_allclose(path, ahead(N - 1, 5), rtol=1e-7)


def test_forecast_of_one_series(df, series):
    one = df.filter("series = 's2'").drop("series")
    got = A.arma_forecast(one, "y", A.order(1, 1), 3).toPandas().sort_values("h")
    _, ahead = explicit(series["s2"], A.order(1, 1), 2, 0, N)
    assert list(got.columns) == ["h", "yhat"]
    np.testing.assert_allclose(got["yhat"], ahead(N - 1, 3), rtol=1e-8)


def test_time_folds_of_fitted_orders(df, series):
    orders, hs, k = [A.order(1), A.order(2, 1, 3)], (1, 2, 3), 4
    per_fold, summary = A.ts_cv(df, "y", orders, hs, k, ["series"])
    rows = {(r["series"], r["p"], r["h"], r["fold"]): r for r in per_fold.collect()}
    assert len(rows) == len(series) * len(orders) * len(hs) * k
    stage = A.long_ar(orders)
    K = max(A.depth(o, stage) for o in orders)
    for o in orders:
        for h in hs:
            for i in range(k):
                cut = N - (k - i) * h
                _, ahead = explicit(series["s2"], o, K, stage, cut)
                e = ahead(cut - 1, h) - series["s2"][cut:cut + h]
                r = rows["s2", o[0], h, i]
                assert r["n"] == h and r["mae"] == pytest.approx(np.abs(e).mean(), rel=1e-6)
                assert r["rmse"] == pytest.approx(np.sqrt((e ** 2).mean()), rel=1e-6)
    s = {(r["series"], r["p"], r["h"]): r for r in summary.collect()}["s2", 2, 3]
    maes = [rows["s2", 2, 3, i]["mae"] for i in range(k)]
    assert s["mae_mean"] == pytest.approx(np.mean(maes)) and s["mae_std"] == pytest.approx(np.std(maes, ddof=1))


def _shape(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return {w: plan.count(w) for w in ("Scan", "Exchange", "Window", "MapInPandas", "Join")}


def test_plans_do_not_grow(spark, tmp_path, df):
    """The scans are those of one order and one fold."""
    df.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    few = [A.order(1, d, q) for d in range(2) for q in range(1, 5)]
    many = [A.order(p, d, q, P, D, Q, 4) for p in range(1, 6) for d in range(3) for q in range(1, 6) for P in range(6) for D in range(2) for Q in range(1, 5)]
    assert len(few) == 8 and len(many) >= 3600
    shapes = [_shape(A.order_grid(t, "y", o, ["series"])) for o in (few, many)]
    assert shapes[0] == shapes[1]
    stage = A.long_ar(few)
    cuts = [A.lag_sums(t, "y", 9, t.groupBy("series").agg(A.F.array(*[A.F.lit(c) for c in range(100, 100 + k)]).alias("cuts")), ["series"])
            for k in (1, 40)]
    shapes = [_shape(A.fit_orders(c, few, ["series"], stage)) for c in cuts]
    assert shapes[0] == shapes[1]


@pytest.mark.parametrize("past", [5, 25])
def test_rolling_arma(df, series, past):
    """Every window refitted from its own rows."""
    got = A.rolling_arma(df, "y", past, ["series"]).toPandas()
    assert len(got) == 3 * N + 2
    for k, y in series.items():
        rows = got[got["series"] == k].sort_values("Date")
        e = np.zeros(N)
        for t in range(past + 1, N):
            at = np.arange(t - past, t)
            x = np.column_stack([np.ones(past), y[at - 1], e[at - 1]])
            b = np.linalg.lstsq(x - [0, y[0], 0], y[at] - y[0], rcond=1e-12)[0]
            yhat = b @ (1.0, y[t - 1] - y[0], e[t - 1]) + y[0]
            e[t] = y[t] - rows["yhat"].iloc[t]  # the state as carried along
            assert rows["yhat"].iloc[t] == pytest.approx(yhat, rel=1e-6)
        assert rows["yhat"].iloc[:past + 1].isna().all() and rows["yhat"].iloc[past + 1:].notna().all()
        np.testing.assert_allclose(rows["err_lag1"].iloc[past + 2:], rows["err"].iloc[past + 1:-1])


def test_empty_and_constant(spark):
    none = spark.createDataFrame([], "series string, Date int, y double")
    assert A.arma_forecast(none, "y", A.order(1), 2, ["series"]).count() == 0
    assert A.order_grid(none, "y", [A.order(1)], ["series"]).count() == 0
    assert A.rolling_arma(none, "y", 3, ["series"]).count() == 0
    flat = spark.createDataFrame([(i, 7.0) for i in range(40)], "Date int, y double")
    assert [round(r["yhat"], 9) for r in A.arma_forecast(flat, "y", A.order(2, 1, 1), 3).collect()] == [7.0] * 3
    with pytest.raises(ValueError):
        A.order(1, 0, 0, 1)
