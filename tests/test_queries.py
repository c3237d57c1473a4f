"""Registered queries against their DuckDB oracles on the smallest tables,
plus the entry smoke check."""

import datetime as dt
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from newsts.sources.tables import TABLES

SF001 = "/root/testdata/sf0.001"

# a cross-section of every operator family (the full set runs in tools/check.py)
SAMPLE = ["daily_mean", "tagged_points_pivot", "points_unpivot", "recent_window", "head_ratio", "align_outer",
          "align_nway", "supervised_matrix", "supervised_train", "prepare_y", "lag_dict", "diff2", "linear_decay",
          "exp_decay", "weekend_roll", "eastern_to_utc", "relative_time", "minmax_fit_train", "publish_keep_first",
          "clean_tokens", "clean_fast", "vocab_topk", "doc_ids", "pad_sequences", "cooccurrence", "ppmi",
          "coherence", "lexicon_sentiment", "combined_sentiment", "geo_regex_sql", "event_triples", "page_items",
          "vector_maxmeanmin", "pattern_similarity", "nearest_vectors", "sentence_vector", "metrics", "random_walk",
          "cv_summary", "linear_1d", "series_stats", "binned_mi", "acf", "decompose_window", "rolling_ar",
          "stream_daily", "stream_decay", "csv_preamble", "series_json", "insert_new", "arma_forecast", "order_grid", "ts_cv",
          "elastic_net", "glm_families", "adf_fixed", "granger_f", "rfe_ols", "select_by_coef_ols", "pca_rows", "best_order",
          "phrase_similarity", "first_token_plain", "role_events", "union_sources", "listing_json"]


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        return dt.datetime(v.year, v.month, v.day)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(df):
    cols = sorted(df.columns)
    out = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)]
    return cols, sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["model", "n", "mae", "rmse", "mape", "r2"]
    assert {r["model"] for r in rows} == {"linear", "random_walk"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    qs, sql = E.queries(), E.oracle_sql()
    got = qs[name](spark, SF001).toPandas()
    want = duck.execute(sql[name]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr
