"""Reducers and boosted stumps against numpy."""

import numpy as np
import pandas as pd
import pytest

from newsts.operators import boost as B
from newsts.operators import reduce as R


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    z = np.abs(rng.normal(size=(400, 2)))
    x = z @ np.abs(rng.normal(size=(2, 5))) + 0.05 * rng.random((400, 5))
    return x


@pytest.fixture(scope="module")
def df(spark, data):
    pdf = pd.DataFrame(data, columns=[f"c{i}" for i in range(5)]).assign(id=range(400))
    return spark.createDataFrame(pdf).repartition(4).cache()


COLS = [f"c{i}" for i in range(5)]


def rows(frame, names):
    pdf = frame.toPandas().sort_values("id")
    return pdf[names].to_numpy(float)


def test_pca_rows(df, data):
    got, values = R.pca_rows(df, COLS, 2)
    x = data - data.mean(axis=0)
    w, v = np.linalg.eigh(x.T @ x / len(x))
    v = R._signed(v[:, ::-1][:, :2])
    np.testing.assert_allclose(values, w[::-1][:2], rtol=1e-8)
    np.testing.assert_allclose(rows(got, ["pc1", "pc2"]), x @ v, rtol=1e-7, atol=1e-9)


def test_factor_rows(df, data):
    """The likelihood never falls, and the factors are those of an
    expectation-maximisation over the rows themselves."""
    got, load, noise = R.factor_rows(df, COLS, 2, steps=60)
    x = (data - data.mean(axis=0)) / data.std(axis=0)
    _, _, history = R.factor_fit(x.T @ x / len(x), 2, 60)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    values, vectors = np.linalg.eigh(x.T @ x / len(x))
    L, psi = vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2]) / 2, np.full(5, 0.5)
    for _ in range(60):
        beta = np.linalg.inv(np.eye(2) + L.T @ (L / psi[:, None])) @ (L / psi[:, None]).T
        z = x @ beta.T
        zz = len(x) * (np.eye(2) - beta @ L) + z.T @ z
        L = np.linalg.solve(zz, z.T @ x).T
        psi = ((x - z @ L.T) * x).mean(axis=0)
    np.testing.assert_allclose(load @ load.T + np.diag(noise), L @ L.T + np.diag(psi), atol=1e-6)
    L = R._signed(L)
    np.testing.assert_allclose(rows(got, ["factor1", "factor2"]), x @ np.linalg.solve(L @ L.T + np.diag(psi), L), atol=1e-5)


def test_nmf_rows(df, data, spark):
    got, h, losses = R.nmf_rows(df, COLS, 2, iters=40)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(losses, losses[1:]))
    w = rows(got, ["w1", "w2"])
    assert (w >= 0).all() and (h >= 0).all()
    assert losses[-1] < 0.01 * (data ** 2).sum()
    # no better weights for these factors: every subset of the factors tried
    for x, own in zip(data[:40], w[:40]):
        tries = [np.maximum(np.linalg.lstsq(h[s].T, x, rcond=None)[0], 0) @ h[s] for s in ([0], [1], [0, 1])]
        assert ((x - own @ h) ** 2).sum() <= min(((x - t) ** 2).sum() for t in tries) + 1e-9
    odd = spark.createDataFrame([(1, 1.0, None), (2, -1.0, 2.0), (3, 1.0, 2.0), (4, 2.0, 1.0)], "id int, c0 double, c1 double")
    out = {r["id"]: r["w1"] for r in R.nmf_rows(odd, ["c0", "c1"], 1)[0].collect()}
    assert out[1] is None and out[2] is None and out[3] > 0


def small_adaboost(x, y, rounds, rate, points):
    """The same boosting over all rows at once."""
    w, members = np.ones(len(y)), []
    for _ in range(rounds):
        best = None
        for f in range(x.shape[1]):
            for s in points[f][:-1]:
                left = x[:, f] <= s
                if not left.any() or left.all():
                    continue
                a, b = np.average(y[left], weights=w[left]), np.average(y[~left], weights=w[~left])
                sse = (w * (y - np.where(left, a, b)) ** 2).sum()
                if best is None or sse < best[0] - 1e-9 * abs(best[0]):
                    best = (sse, f, s, a, b)
        _, f, s, a, b = best
        e = np.abs(np.where(x[:, f] <= s, a, b) - y)
        share = (w * e).sum() / e.max() / w.sum()
        if share >= 0.5:
            break
        beta = share / (1 - share)
        members.append((f, s, a, b, beta))
        w = w * beta ** (rate * (1 - e / e.max()))
    return members


@pytest.mark.parametrize("rate", [0.01, 1.0])
def test_adaboost_equals_a_small_version(spark, rate):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, size=(300, 3)).astype(float)
    y = 3.0 * (x[:, 0] > 5) + 1.0 * (x[:, 1] > 2) + rng.normal(size=300) * 0.3
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, id=range(300))).repartition(3)
    members = B.adaboost_fit(df, ["a", "b", "c"], "y", rounds=8, rate=rate)
    points = [np.unique(x[:, f]) for f in range(3)]
    want = small_adaboost(x, y, 8, rate, points)
    assert [(m.feature, m.split) for m in members] == [(f, s) for f, s, *_ in want]
    np.testing.assert_allclose([(m.left, m.right, m.beta) for m in members], [m[2:] for m in want], rtol=1e-8)
    got = rows(B.adaboost_apply(df, members, ["a", "b", "c"], rate), ["yhat"])[:, 0]
    mass = np.array([rate * np.log(1 / m[4]) for m in want])
    for i in range(300):
        values = [(a if x[i, f] <= s else b) for f, s, a, b, _ in want]
        order, upto = sorted(range(len(values)), key=lambda k: values[k]), 0.0
        for k in order:
            upto += mass[k]
            if upto >= 0.5 * mass.sum() - 1e-12:
                break
        assert got[i] == pytest.approx(values[k])


def test_adaboost_of_little(spark):
    none = spark.createDataFrame([], "a double, y double")
    assert B.adaboost_fit(none, ["a"], "y") == []
    assert B.adaboost_apply(spark.createDataFrame([(1.0,)], "a double"), [], ["a"]).first()["yhat"] is None
    flat = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (None, 5.0)], "a double, y double")
    members = B.adaboost_fit(flat, ["a"], "y")
    assert [r["yhat"] for r in B.adaboost_apply(flat, members, ["a"]).orderBy(B.F.asc_nulls_last("a")).collect()] == [2.0, 2.0, None]
