"""Topic models against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsts.operators import topics as TP


def test_topics_equal_numpy_and_never_get_worse(spark, monkeypatch):
    """Two planted topics; batches that cut documents apart change nothing."""
    rng = np.random.default_rng(3)
    rows = []
    for d in range(60):
        own = range(12) if d % 2 else range(12, 24)
        for t in rng.choice(own, size=30):
            rows.append((f"d{d}", f"w{t}"))
        rows += [(f"d{d}", "common")] * 3
    tokens = spark.createDataFrame(rows, "doc_id string, term string")
    monkeypatch.setattr(TP, "CELLS", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        edges, terms = TP.term_edges(tokens)
        phi, losses = TP.lda_terms_fit(edges, terms, k=2, max_iter=6)
        got = {r["term"]: r["phi"] for r in phi.collect()}
        docs = {r["doc_id"]: (r["Topic1"], r["Topic2"]) for r in TP.lda_terms_apply(edges, phi, k=2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(losses, losses[1:]))
    noise = {r["term"]: [r["a"], r["b"]] for r in terms.select(
        "term", *[(1.0 + F.pmod(F.xxhash64("term", F.lit(42), F.lit(j)), F.lit(1 << 20)) / float(1 << 20)).alias("ab"[j]) for j in (0, 1)]).collect()}
    names = sorted(noise)
    p = np.array([noise[t] for t in names])
    p /= p.sum(axis=0)
    counts = np.zeros((60, len(names)))
    for d, t in rows:
        counts[int(d[1:]), names.index(t)] += 1
    for _ in range(6):
        theta = np.full((60, 2), 0.5)
        for _ in range(TP.INNER):
            r = theta[:, None, :] * p[None]
            r *= (counts / r.sum(axis=2))[:, :, None]
            theta = r.sum(axis=1) + TP.TOPIC_PRIOR
            theta /= theta.sum(axis=1, keepdims=True)
        r = theta[:, None, :] * p[None]
        r *= (counts / r.sum(axis=2))[:, :, None]
        p = r.sum(axis=0) + TP.TERM_PRIOR
        p /= p.sum(axis=0)
    np.testing.assert_allclose([got[t] for t in names], p, rtol=1e-6)
    odd, even = (np.mean([docs[f"d{d}"][0] for d in range(s, 60, 2)]) for s in (1, 0))
    assert abs(odd - even) > 0.3 and all(sum(v) == pytest.approx(1.0) for v in docs.values())


def test_topics_of_nothing(spark):
    edges, terms = TP.term_edges(spark.createDataFrame([], "doc_id string, term string"))
    phi, _ = TP.lda_terms_fit(edges, terms, k=2, max_iter=2)
    assert TP.lda_terms_apply(edges, phi, k=2).count() == 0


def test_no_vocabulary_on_the_driver():
    import inspect
    source = inspect.getsource(TP)
    assert "CountVectorizer" not in source and ".vocabulary" not in source
