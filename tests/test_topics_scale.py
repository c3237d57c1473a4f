"""T11 keeps one row for each document, and only frequent terms are given to every task."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsts.operators import topics as TP


def _said():
    rng = np.random.default_rng(5)
    said = [(int(rng.integers(0, 40)), f"w{min(int(rng.exponential(6)), 60)}") for _ in range(1500)]
    return said + [(None, "w1"), (None, "only"), (7, None)]


@pytest.mark.parametrize("words, dense, listed", [(0, 0, True), (5, 12, False), (1000, 10_000, True)])
def test_rare_terms_meet_their_documents(spark, monkeypatch, words, dense, listed):
    monkeypatch.setattr(TP, "HOT_WORDS", words)
    monkeypatch.setattr(TP, "DENSE", dense)
    monkeypatch.setattr(TP, "CELLS", 8)
    monkeypatch.setattr(TP, "EDGES", 20)
    tokens = spark.createDataFrame(_said(), "doc_id int, term string").repartition(5)
    if listed:
        # a document may have several rows
        tokens = tokens.groupBy("doc_id", F.spark_partition_id().alias("p")).agg(F.collect_list("term").alias("term"))
    docs, terms = TP.term_edges(tokens)
    names = {r["term_id"]: r["term"] for r in terms.collect()}
    assert sorted(names) == list(range(len(names)))
    want = {}
    for d, w in _said():
        if w is not None:
            want.setdefault(d, {}).setdefault(w, 0)
            want[d][w] += 1
    got = {r["doc"]: {names[i]: n for i, n in zip(r["ids"], r["n"], strict=True)} for r in docs.collect()}
    assert got == want and docs.count() == len(want)
    phi, losses = TP.lda_terms_fit(docs, terms, k=3, max_iter=3)
    weights = {r["term"]: r["phi"] for r in phi.collect()}
    topics = {r["doc_id"]: [r[f"Topic{j}"] for j in (1, 2, 3)] for r in TP.lda_terms_apply(docs, phi, k=3).collect()}
    assert weights.keys() == set(names.values()) and topics.keys() == want.keys()
    # the same as with all terms in every task
    monkeypatch.setattr(TP, "DENSE", 10_000)
    phi2, losses2 = TP.lda_terms_fit(docs, terms, k=3, max_iter=3)
    np.testing.assert_allclose(losses, losses2, rtol=1e-9)
    for r in phi2.collect():
        np.testing.assert_allclose(weights[r["term"]], r["phi"], rtol=1e-9)
    for r in TP.lda_terms_apply(docs, phi2, k=3).collect():
        np.testing.assert_allclose(topics[r["doc_id"]], [r[f"Topic{j}"] for j in (1, 2, 3)], rtol=1e-9)


def test_a_pass_leaves_nothing_of_the_pass_before(spark):
    from newsts.session import ensure_checkpoint_dir
    docs, terms = TP.term_edges(spark.createDataFrame(_said(), "doc_id int, term string"))
    top = ensure_checkpoint_dir(spark).removeprefix("file://")

    def tables():
        return sum(name.startswith("table-") for name in os.listdir(top))

    left = []
    for passes in (2, 6):
        before = tables()
        TP.lda_terms_fit(docs, terms, k=2, max_iter=passes)
        left.append(tables() - before)
    assert left == [1, 1]
