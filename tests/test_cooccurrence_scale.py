"""Tiles take many documents at a time (T7); blocks of words stay few."""
import numpy as np


def test_cooccurrence_adds_many_documents_at_once(spark, monkeypatch):
    from newsts.operators import text as TO
    rng = np.random.default_rng(4)
    rows = [(int(d), int(t), int(n)) for d, t, n in zip(rng.integers(0, 40, 600), rng.integers(1, 31, 600), rng.integers(1, 4, 600), strict=True)]
    df = spark.createDataFrame([*rows, (None, 3, 2), (None, 4, 1)], "doc_id long, term_id long, tf long").repartition(3)
    a = np.zeros((41, 31))
    for d, t, n in [*rows, (40, 3, 2), (40, 4, 1)]:
        a[d, t] += n
    for docs, held in ((512, 500_000), (7, 500_000), (512, 50)):
        monkeypatch.setattr(TO, "DOCS", docs)
        monkeypatch.setattr(TO, "ROWS", held)
        got = {(r["i"], r["j"]): r["n_ij"] for r in TO.cooccurrence(df, 30).collect()}
        want = a.T @ a
        assert got == {(i, j): want[i, j] for i, j in zip(*np.nonzero(want), strict=True)}


def test_turns_of_word_vectors_do_not_follow_the_vocabulary():
    from newsts.operators.embed import n_blocks
    assert n_blocks(10) == 4 and n_blocks(1_000_000) == 10
    assert n_blocks(8_000_000) == 16 and n_blocks(50_000_000) == 100
