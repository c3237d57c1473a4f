"""The service: versions of artefacts, a forecast that fits nothing, RFE shortcuts."""

import numpy as np
import pytest

from newsts.operators import models as M
from newsts.operators import select as X
from newsts.plans import service as P
from newsts.sinks import artefacts as A
from tests.conftest import SF001


def test_half_written_versions_are_ignored(spark, tmp_path):
    base = str(tmp_path / "a")
    with pytest.raises(FileNotFoundError):
        A.Opened(spark, base)
    old = A.Version(spark, base)
    old.table("x", spark.range(3))
    with pytest.raises(FileNotFoundError):  # no manifest yet
        A.Opened(spark, base)
    old.complete()
    assert A.Opened(spark, base).table("x").count() == 3
    half = A.Version(spark, base)
    half.table("x", spark.range(9))
    assert A.Opened(spark, base).path == old.path
    reader = A.Opened(spark, base)
    new = A.Version(spark, base)
    new.table("x", spark.range(5))
    new.complete()
    assert reader.table("x").count() == 3  # one version from start to end
    assert A.Opened(spark, base).table("x").count() == 5
    with pytest.raises(KeyError):
        reader.table("y")


def test_forecast_reads_one_version_and_fits_nothing(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "service")
    made = P.train(spark, SF001, base, past=5)
    assert len(made["chosen"]) == P.SELECTED and A.Opened(spark, base).names >= {"linear", "lda", "selector", *[f"part_{p}" for p in P.PARTS]}

    def no(*args, **options):
        raise AssertionError("a fit in the forecast")
    for place, name in ((P.G, "gram"), (P.M, "linear_fit"), (P.M, "ml_fit"), (P.TP, "lda_vectors_fit"), (P.X, "rfe_order"), (P, "minmax_fit")):
        monkeypatch.setattr(place, name, no)
    rows = P.predict(spark, SF001, base).toPandas()
    assert len(rows) > 20 and rows["yhat"].notna().all() and (rows["yhat"] != rows["lin"]).any()
    # the day after a day that was trained on has that day's linear fit: today takes the slot of t-1
    fit = made["fit"].toPandas().set_index("Date")["lin"]
    days = sorted(P.price_features(spark, SF001).join(P.news_features(spark, SF001, A.Opened(spark, base))[0], "Date")
                  .dropna().select("Date").toPandas()["Date"])
    after = dict(zip(days, days[1:]))
    import datetime
    lin = {d - datetime.timedelta(days=1): v for d, v in zip(rows["Date"], rows["lin"])}
    shared = [d for d in lin if after.get(d) in fit.index and after[d].month == d.month]
    calendar = [x for x in made["chosen"] if x in ("x0", "x1", "x2")]
    if not calendar:  # month, day and weekday are those of the row itself
        assert len(shared) > 10
        np.testing.assert_allclose([lin[d] for d in shared], [fit[after[d]] for d in shared], rtol=1e-6)


def test_rfe_skips_fits_that_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 14))
    y = x[:, 2] * 3 + x[:, 5] - 2 * x[:, 9] + rng.normal(size=120) * 0.1
    g = {"n": 120, "sx": x.sum(0), "sy": y.sum(), "xx": x.T @ x, "xy": x.T @ y, "yy": y @ y}
    for alpha in (0.01, 0.2, 50.0):
        remaining, ranks, r = list(range(14)), [1] * 14, 12
        while len(remaining) > 3:
            _, b = M.solve(X._sub(g, remaining), "lasso", alpha)
            j = int(np.argmin(np.abs(b)))
            ranks[remaining.pop(j)] = r
            r -= 1
        assert X.rfe_order(g, 3, "lasso", alpha) == ranks
    fits = []
    monkeypatch.setattr(X, "solve", lambda *a, **k: fits.append(1) or M.solve(*a, **k))
    X.rfe_order(g, 3, "lasso", 0.2)
    assert len(fits) <= 4
