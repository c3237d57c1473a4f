"""Unit tests of gaps, leaks, spreading, wide Grams, factorisations and the
optional package, against numpy."""

import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsts.operators import evaluate as V
from newsts.operators import gram as G
from newsts.operators import models as M
from newsts.operators import text as TO
from newsts.operators import topics as TP
from newsts.operators.split import number_rows, ordered_split, repeated_folds, time_folds_df
from newsts.sources import tables as S

SF001 = "/root/testdata/sf0.001"


def series(n=90, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    return pd.DataFrame({"Date": pd.date_range("2024-01-01", periods=n).date, "x": x, "y": 2 * x + np.cumsum(rng.normal(size=n))})


@pytest.mark.parametrize("gap", [0, 5, 40])
def test_folds_do_not_train_on_their_gap(spark, gap):
    pdf = series(150)
    d = number_rows(spark.createDataFrame(pdf))
    folds = time_folds_df(d.select("n").distinct(), k=5, gap=gap)
    per, _ = V.cv_linear(d, folds, ["x"], "y")
    got = {r["fold"]: r["rmse"] for r in per.collect()}
    for f in folds.collect():
        if f["train_end"] < 1:
            assert f["fold"] not in got
            continue
        train = pdf.iloc[: f["train_end"]]
        test = pdf.iloc[f["test_start"] - 1: f["test_end"]]
        b, a = np.polyfit(train.x, train.y, 1)
        assert got[f["fold"]] == pytest.approx(np.sqrt(np.mean((a + b * test.x - test.y) ** 2)), rel=1e-9)


def test_walk_forward_refits_on_every_row_before(spark):
    pdf = series(40)
    got = V.walk_forward(spark.createDataFrame(pdf), ["x"], "y").orderBy("Date").toPandas()
    for i in range(40):
        if i < 3:
            assert np.isnan(got.yhat[i])
        else:
            b, a = np.polyfit(pdf.x[:i], pdf.y[:i], 1)
            assert got.yhat[i] == pytest.approx(a + b * pdf.x[i], rel=1e-6)


def test_hybrid_targets_ignore_test_rows(spark):
    from newsts.plans.model_queries import hybrid_targets
    pdf = series(80)
    other = pdf.copy()
    other.loc[56:, "y"] += 100.0
    parts = []
    for p in (pdf, other):
        _, t = hybrid_targets(ordered_split(spark.createDataFrame(p), 0.7), ["x"])
        parts.append(t.orderBy("Date").select("Date", "trend", "seasonal", "residual").toPandas())
    assert len(parts[0]) > 30
    pd.testing.assert_frame_equal(*parts)


def test_repeated_folds_are_balanced(spark):
    d = repeated_folds(spark.range(1, 1095).withColumnRenamed("id", "rn"), 3, 4)
    sizes = [r["count"] for r in d.groupBy("repeat", "fold").count().collect()]
    assert len(sizes) == 12 and max(sizes) - min(sizes) <= 1


def test_text_scan_feeds_the_tasks_asked_for(spark):
    spark.conf.set(S.TEXT_TASKS, "8")
    try:
        assert S.table(spark, SF001, "documents").rdd.getNumPartitions() == 8
    finally:
        spark.conf.unset(S.TEXT_TASKS)
    assert S.table(spark, SF001, "documents").rdd.getNumPartitions() == spark.read.parquet(f"{SF001}/documents.parquet").rdd.getNumPartitions()


def test_wide_gram(spark):
    p, n = 803, 60
    x = np.random.default_rng(1).normal(size=(n, p + 1))
    df = spark.createDataFrame(pd.DataFrame({"v": list(x)})).repartition(4)
    cols = [f"c{i}" for i in range(p + 1)]
    wide = df.select(*[F.col("v")[i].alias(c) for i, c in enumerate(cols)])
    g = G.to_numpy(G.gram(wide, cols[:-1], cols[-1]).first())
    np.testing.assert_allclose(g["xx"], x[:, :-1].T @ x[:, :-1], rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(g["xy"], x[:, :-1].T @ x[:, -1], rtol=1e-9, atol=1e-9)
    assert g["n"] == n


def test_arma_plan_does_not_grow_with_the_orders(spark):
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(size=120))
    df = spark.createDataFrame(pd.DataFrame({"Date": pd.date_range("2024-01-01", periods=120).date, "y": y}))

    got = M.arma_grid(df, "y", [(1, 0), (2, 0), (2, 2)], d=1).collect()
    assert {(r["p"], r["q"]) for r in got} == {(1, 0), (2, 0), (2, 2)}


def test_arma_grid_many_series(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{k}", d, float(v)) for k in range(230) for d, v in zip(pd.date_range("2024-01-01", periods=40).date, np.cumsum(rng.normal(size=40)), strict=True)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "Date", "y"]))
    assert M.arma_grid(df, "y", [(1, 0)], keys=["k"]).count() == 230


def test_nmf_loss_never_rises(spark):
    rng = np.random.default_rng(4)
    a = rng.poisson(1.0, size=(30, 12)).astype(float)
    df = spark.createDataFrame([(d, t + 1, float(a[d, t])) for d in range(30) for t in range(12) if a[d, t]], "doc_id long, term_id long, tf double")
    w, h, losses = TP.nmf_fit(df, 12, k=5, iters=6, tol=0.0)
    assert all(y <= x * (1 + 1e-9) for x, y in zip(losses, losses[1:], strict=False))
    hm = {r["doc_id"]: np.array(r["h"]) for r in h.collect()}
    fit = np.stack([hm.get(d, np.zeros(5)) for d in range(30)]) @ w.T
    rest = a.copy()
    assert losses[-1] == pytest.approx(float(((rest - fit) ** 2).sum()), rel=1e-6)


def test_ledger_columns(spark, tmp_path):
    from newsts.sinks.writers import ledger_append
    row = spark.createDataFrame([(10, 1.0, 2.0, 3.0, 0.5, 1)], "n int, mae double, rmse double, mape double, r2 double, h int")
    ledger_append(row, str(tmp_path / "l"), "x")
    ledger_append(row.drop("h"), str(tmp_path / "l"), "y")
    out = spark.read.parquet(str(tmp_path / "l"))
    assert out.columns == ["time", "descriptions", "h", "mae", "rmse", "mape"]
    assert sorted((r["descriptions"], r["h"]) for r in out.collect()) == [("x", 1), ("y", None)]


def test_entry_without_the_optional_package(monkeypatch):
    import __spark_entry__ as E
    with monkeypatch.context() as m:
        for name in [k for k in sys.modules if k.startswith("newsts.llm") or k == "corpus_pipeline"]:
            m.delitem(sys.modules, name)
        m.setitem(sys.modules, "corpus_pipeline", None)
        names = set(E.queries())
    assert "flagship" in names and not any(n.startswith("op10_") for n in names)


@pytest.mark.parametrize("name", ["nmf", "sea_nmf"])
def test_nmf_queries_use_the_stop_rule_of_the_operator(spark, monkeypatch, name):
    from newsts.plans import model_queries as Q
    given = {}

    def stop(*args, **options):
        given.update(options)
        raise StopIteration
    monkeypatch.setattr(Q.TP, "nmf_fit", stop)
    monkeypatch.setattr(Q, "_nmf_inputs", lambda spark, sf: None)
    with pytest.raises(StopIteration):
        getattr(Q, name)(spark, SF001)
    assert given["k"] == 4 and not {"tol", "iters"} & set(given)


def test_cooccurrence_holds_a_batch(spark, monkeypatch):
    """Cells over batch edges, several tiles and spills equal a dense product;
    a task holds a bounded number of tiles."""
    rng = np.random.default_rng(6)
    a = rng.poisson(0.6, size=(70, 40))
    rows = [(f"d{d}", t + 1, float(a[d, t])) for d in range(70) for t in range(40) if a[d, t]]
    df = spark.createDataFrame(rows + [("d0", 41, 5.0)], "doc_id string, term_id long, tf double").repartition(3)
    monkeypatch.setattr(TO, "TILE", 16)
    monkeypatch.setattr(TO, "TILES", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {(r["i"], r["j"]): r["n_ij"] for r in TO.cooccurrence(df, 40).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = (a.T @ a).astype(float)
    assert got == {(i + 1, j + 1): want[i, j] for i in range(40) for j in range(40) if want[i, j]}
    tiles, most = TO.Tiles(), 0
    for k in range(6):
        list(tiles.add(np.zeros(3, int), np.array([0, 16 * k, 5]), np.ones(3)))
        most = max(most, len(tiles.held))
    assert 0 < most <= 2 + 1


def test_preamble_of_files_in_splits(spark, tmp_path):
    """A file is read in several tasks; only lines after its own header stay."""
    from newsts.sources.files import read_csv_after
    (tmp_path / "t").mkdir()
    for k in range(3):
        lines = [f"note {i} Date,Price" for i in range(200 * k + 5)] + ["Date,Price"] + [f"2024-01-{1 + i % 28:02d},{k}.{i}" for i in range(400)]
        (tmp_path / "t" / f"{k}.csv").write_text("\r\n".join([*lines, "", "Date,Price", "2024-02-02,9.5"]))
    (tmp_path / "t" / "none.csv").write_text("2024-01-01,1.0\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        assert spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 10
        got = [tuple(r) for r in read_csv_after(spark, str(tmp_path / "t"), r"^Date,Price$", "Date date, Price double").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    # a second header line is a line like any other
    assert sorted(str(p) for d, p in got if d) == sorted([str(float(f"{k}.{i}")) for k in range(3) for i in range(400)] + ["9.5"] * 3)
    assert sum(d is None for d, _ in got) == 3


def test_loess_window_slides(spark):
    """Against the definition: the nearest points by sorted distance."""
    from newsts.operators.stats import _loess
    rng = np.random.default_rng(8)
    for n, span in ((5, 7), (40, 7), (90, 21)):
        x, y, w = np.arange(n, dtype=float), rng.normal(size=n), rng.random(n)
        xq = np.arange(-1, n + 1, dtype=float)
        got = _loess(x, y, xq, span, w)
        for at, value in zip(xq, got):
            near = np.argsort(np.abs(x - at), kind="stable")[:min(span, n)]
            h = np.abs(x[near] - at).max() + max(0, span - n) / 2
            k = np.clip((1 - (np.abs(x[near] - at) / h) ** 3) ** 3, 0, None) * w[near]
            design = np.stack([np.ones(len(near)), x[near] - at], axis=1)
            want = np.linalg.lstsq(design * np.sqrt(k)[:, None], y[near] * np.sqrt(k), rcond=None)[0][0]
            assert value == pytest.approx(want, abs=1e-8)
