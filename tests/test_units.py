"""Hand-computed unit frames (semantics notes of the blueprint)."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsts.functions import calendar as C
from newsts.functions import scale as SC
from newsts.functions import vectors as FV
from newsts.functions.porter import stem
from newsts.operators import aggregate as A
from newsts.operators import evaluate as V
from newsts.operators import gram as G
from newsts.operators import lagged as W
from newsts.operators import models as M
from newsts.operators import split as SP
from newsts.operators import stats as ST
from newsts.operators import text as TO
from newsts.sinks.writers import publish_frame


def series(spark, xs, name="x"):
    d0 = dt.date(2024, 1, 1)
    return spark.createDataFrame([(d0 + dt.timedelta(days=i), float(x)) for i, x in enumerate(xs)], f"Date date, {name} double")


def col(df, c, order="Date"):
    return [r[0] for r in df.orderBy(order).select(W.q(c)).collect()]


def test_linear_decay(spark):
    d = W.linear_decay(series(spark, [1, 2, 3, 4, 5, 6, 7]), ["x"])
    assert col(d, "Decay_x") == pytest.approx([1, 2, 3, 4, 5, 14.0, 17.0])


def test_exp_decay_small_and_blocked(spark):
    d = W.exp_decay(series(spark, [1, 0, 0]), ["x"])
    assert col(d, "Cum_x") == pytest.approx([1, math.exp(-1 / 7), math.exp(-2 / 7)])
    rng = np.random.default_rng(0)
    xs = rng.normal(size=1600)
    got = col(W.exp_decay(series(spark, xs), ["x"], block=200), "Cum_x")
    t = np.arange(len(xs))
    ref = [sum(xs[i] * math.exp(-(k - i) / 7) for i in range(max(0, k - 400), k + 1)) for k in t]
    assert np.allclose(got, ref, rtol=1e-10, atol=1e-10)


def test_supervised_names_and_rows(spark):
    d = W.supervised(series(spark, [1, 2, 3, 4], "a"), ["a"], 2, 1)
    assert d.columns == ["Date", "a(t-2)", "a(t-1)", "a(t)"]
    assert [tuple(r)[1:] for r in d.orderBy("Date").collect()] == [(1.0, 2.0, 3.0), (2.0, 3.0, 4.0)]


def test_prepare_y(spark):
    d = W.prepare_y(series(spark, [1, 2, 3, 4], "Price"))
    r = d.collect()
    assert len(r) == 1 and r[0]["Date"] == dt.date(2024, 1, 4)
    assert (r[0]["Price_t"], r[0]["Price_t+1"], r[0]["Price_t+2"], r[0]["Price_t+3"]) == (1, 2, 3, 4)


def test_weekend_roll_and_guard(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (5, 6, 7, 8)], "d date")
    r = df.select("d", C.roll_weekend("d").alias("r"), C.trading_date("d").alias("t")).orderBy("d").collect()
    assert [x["r"] for x in r] == [dt.date(2024, 1, 5), dt.date(2024, 1, 8), dt.date(2024, 1, 8), dt.date(2024, 1, 8)]
    assert [x["t"] for x in r] == [None, None, dt.date(2024, 1, 5), dt.date(2024, 1, 8)]


def test_relative_date(spark):
    df = spark.createDataFrame([(" - 3 hours ago",), (" - Jan 05, 2022",), ("xx garbage",), (" - 2 weeks ago",)], "s string")
    as_of = F.lit("2022-01-05 02:00:00").cast("timestamp")
    r = [x[0] for x in df.select(C.relative_date("s", as_of)).collect()]
    assert r == [dt.date(2022, 1, 4), dt.date(2022, 1, 5), dt.date(2022, 1, 5), None]


def test_minmax_constant_and_inverse(spark):
    train = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "a double, c double")
    params = SC.minmax_fit(train, ["a", "c"])
    test = spark.createDataFrame([(5.0, 5.0)], "a double, c double")
    r = SC.minmax_apply(test, params, ["a", "c"], 1.0, 100.0).first()
    assert r["a"] == pytest.approx(50.5) and r["c"] == pytest.approx(1.0)
    back = SC.minmax_invert(SC.minmax_apply(train, params, ["a"], 0.1, 1.0), params, ["a"], 0.1, 1.0)
    assert sorted(x[0] for x in back.select("a").collect()) == pytest.approx([0.0, 10.0])


def test_fold_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "mae double")
    pop = A.summarize_folds(df, ["mae"], ddof=0).first()["mae_std"]
    smp = A.summarize_folds(df, ["mae"], ddof=1).first()["mae_std"]
    assert pop == pytest.approx(1.2472, abs=1e-4) and smp == pytest.approx(1.5275, abs=1e-4)


def test_time_folds(spark):
    f = SP.time_folds(spark, 10, 3).orderBy("fold").collect()
    assert [r["test_start"] for r in f] == [5, 7, 9]  # 1-based rn; 0-based 4, 6, 8
    assert [r["train_end"] for r in f] == [4, 6, 8]
    with pytest.raises(ValueError):
        SP.time_folds(spark, 10, 3, gap=-1)


def test_metrics_and_zero_mape(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, yhat double")
    r = V.errors(df, "y", "yhat", zero=0.01).first()
    assert r["mae"] == pytest.approx(1.0) and r["rmse"] == pytest.approx(1.0)
    assert r["mape"] == pytest.approx(49.75)


def test_pad_spark(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4, 5, 6, 7],)], "s array<int>")
    r = [x[0] for x in df.select(TO.pad("s", 5)).collect()]
    assert r == [[0, 0, 1, 2, 3], [3, 4, 5, 6, 7]]


def test_cooccurrence_and_ppmi(spark):
    dt_ = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "doc_id long, term_id long, tf long")
    c = {(r["i"], r["j"]): r["n_ij"] for r in TO.cooccurrence(dt_, 2).collect()}
    assert c == {(1, 1): 4.0, (1, 2): 2.0, (2, 1): 2.0, (2, 2): 1.0}
    p = [r["ppmi"] for r in TO.ppmi(TO.cooccurrence(dt_, 2)).collect()]
    assert p == pytest.approx([0.0] * 4, abs=1e-12)


def test_geo_regex(spark):
    df = spark.createDataFrame([("geopolitical risk and war risk of war; threat of war",),
                                ("terrorist act terrorist acts terrorist actss",)], "News string")
    r = TO.geo_regex(df, "News", families=(0,)).collect()
    assert r[0]["GeoIdx"] == 1
    r2 = TO.geo_regex(df, "News", families=(2,)).collect()
    assert r2[0]["GeoIdx"] == 1
    r5 = TO.geo_regex(df, "News", families=(5,)).collect()
    assert r5[1]["GeoIdx"] == 3


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    r = [x[0] for x in df.select(FV.cosine("a", "b")).collect()]
    assert r[0] == pytest.approx(0.8) and r[1] is None


def test_publish_keep_first(spark):
    fc = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 2), 2.0), (dt.date(2024, 1, 3), 3.0)],
                               "Date date, yhat double")
    pub = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),)], "Date date")
    r = publish_frame(fc, pub).collect()
    assert len(r) == 1 and r[0]["value"] == 3.0 and r[0]["time"].hour == 22


def test_random_walk_walk_forward(spark):
    d = M.random_walk(series(spark, [1, 2, 4], "y"), "y")
    assert col(d, "yhat") == [None, 1.0, 2.0]


def test_decompose_invariant(spark):
    rng = np.random.default_rng(1)
    xs = np.sin(np.arange(60) / 3) * 5 + rng.normal(size=60)
    d = ST.decompose_classical(series(spark, xs), "x", 10).dropna().collect()
    for r in d:
        assert r["trend"] + r["seasonal"] + r["residual"] == pytest.approx(r["x"])


def test_porter_stems():
    cases = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
             "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop",
             "filing": "file", "happy": "happi", "relational": "relat", "generalization": "gener",
             "hopeful": "hope", "goodness": "good", "adjustment": "adjust", "probate": "probat", "rate": "rate",
             "controll": "control", "running": "run"}
    for w, s in cases.items():
        assert stem(w) == s, (w, stem(w), s)


def test_gram_solvers_match_numpy(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(200, 3))
    y = X @ np.array([1.5, -2.0, 0.5]) + 3 + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([tuple(map(float, [*x, t])) for x, t in zip(X, y)], "a double, b double, c double, y double")
    g = G.gram(df, ["a", "b", "c"], "y")
    ols = M.linear_fit(g, kind="ols").first()
    A_ = np.c_[np.ones(200), X]
    ref = np.linalg.lstsq(A_, y, rcond=None)[0]
    assert ols["intercept"] == pytest.approx(ref[0]) and ols["coef"] == pytest.approx(list(ref[1:]))
    ridge = M.linear_fit(g, kind="ridge", alpha=2.0).first()
    Xc, yc = X - X.mean(0), y - y.mean()
    rref = np.linalg.solve(Xc.T @ Xc + 2.0 * np.eye(3), Xc.T @ yc)
    assert ridge["coef"] == pytest.approx(list(rref))
    lasso = M.linear_fit(g, kind="lasso", alpha=0.1).first()
    # coordinate-descent optimality: |Xc'(yc - Xc b)|/n ≤ alpha, = alpha·sign(b) where b ≠ 0
    b = np.array(lasso["coef"])
    grad = Xc.T @ (yc - Xc @ b) / 200
    for j in range(3):
        if abs(b[j]) > 1e-9:
            assert grad[j] == pytest.approx(0.1 * np.sign(b[j]), abs=1e-6)
        else:
            assert abs(grad[j]) <= 0.1 + 1e-9


def test_granger_f_matches_numpy(spark):
    rng = np.random.default_rng(5)
    n = 120
    x = rng.normal(size=n)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.3 * y[t - 1] + 0.8 * x[t - 1] + rng.normal(scale=0.5)
    d0 = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(d0 + dt.timedelta(days=i), float(y[i]), float(x[i])) for i in range(n)],
                               "Date date, y double, x double")
    r = ST.granger(df, "y", ["x"], 2).orderBy("lag").collect()
    p = 1
    Y = y[p:]
    R = np.c_[np.ones(n - p), y[:-1]]
    U = np.c_[R, x[:-1]]
    ssr_r = np.sum((Y - R @ np.linalg.lstsq(R, Y, rcond=None)[0]) ** 2)
    ssr_u = np.sum((Y - U @ np.linalg.lstsq(U, Y, rcond=None)[0]) ** 2)
    f = (ssr_r - ssr_u) / (ssr_u / (n - p - 2 * p - 1))
    assert r[0]["F"] == pytest.approx(f, rel=1e-8)
    assert r[0]["p_value"] < 1e-6


def test_betainc_against_known():
    # I_0.5(2, 3) = 0.6875
    assert ST.betainc(2, 3, 0.5) == pytest.approx(0.6875, abs=1e-12)
    # F(1, 10) upper tail at 4.9646 ≈ 0.05
    assert ST.f_sf(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)


def test_acf_pacf(spark):
    rng = np.random.default_rng(2)
    xs = rng.normal(size=300)
    a = {r["lag"]: r["acf"] for r in ST.acf(series(spark, xs), "x", 3).collect()}
    m = xs.mean()
    c = xs - m
    for k in range(4):
        assert a[k] == pytest.approx(np.sum(c[k:] * c[:len(c) - k]) / np.sum(c * c))
    p = ST.pacf_from_acf(np.array([a[k] for k in range(4)]))
    assert p[1] == pytest.approx(a[1])


def test_rfe_order_drops_weakest():
    from newsts.operators.select import rfe_order
    rng = np.random.default_rng(4)
    X = rng.normal(size=(500, 3))
    y = 5 * X[:, 0] + 0.01 * X[:, 1] + 2 * X[:, 2]
    g = {"n": 500, "sx": X.sum(0), "sy": y.sum(), "xx": X.T @ X, "xy": X.T @ y, "yy": y @ y}
    ranks = rfe_order(g, 1, "ols")
    assert ranks == [1, 3, 2]


def test_stl_parts_sum_and_recover_season(spark):
    n, period = 120, 10
    t = np.arange(n)
    season = np.sin(2 * np.pi * t / period) * 3
    y = 0.05 * t + season
    T_, S_, R_ = ST.stl_numpy(y, period)
    assert np.allclose(T_ + S_ + R_, y)
    assert np.corrcoef(S_[20:-20], season[20:-20])[0, 1] > 0.95
    d0 = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(d0 + dt.timedelta(days=int(i)), float(v)) for i, v in zip(t, y)], "Date date, x double")
    rows = ST.decompose_stl(df, "x", period).collect()
    assert len(rows) == n
    for r in rows:
        assert r["trend"] + r["seasonal"] + r["residual"] == pytest.approx(y[(r["Date"] - d0).days])
