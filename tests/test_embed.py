"""Block-wise word vectors: planted neighbours, sampling, plan."""

import numpy as np

from newsts.operators import embed as E


def test_alias_table_samples_by_weight():
    weights = np.array([5.0, 1.0, 0.5, 3.5])
    chance, other = E.alias_table(weights)
    share = np.zeros(4)
    for i in range(4):
        share[i] += chance[i] / 4
        share[other[i]] += (1 - chance[i]) / 4
    np.testing.assert_allclose(share, weights / weights.sum())


def test_planted_neighbours_are_found(spark):
    """Words of one group stand together and never with the other group; every
    number of blocks finds the groups."""
    rng = np.random.default_rng(5)
    rows = [([f"{g}{rng.integers(12)}" for _ in range(3)],) for _ in range(1500) for g in "ab"] + [(["alone"],), ([],), (None,)]
    lists = spark.createDataFrame(rows, "tokens array<string>")
    for blocks in (1, 3):
        got = {r["word"]: np.array(r["v"]) for r in E.word2vec(lists, size=8, blocks=blocks).collect()}
        assert set(got) == {f"{g}{i}" for g in "ab" for i in range(12)}
        names = sorted(got)
        v = np.array([got[w] / np.linalg.norm(got[w]) for w in names])
        sim = v @ v.T - 2 * np.eye(len(names))
        assert all(names[k][0] == names[j][0] for k, j in enumerate(sim.argmax(axis=1)))
        inside = np.array([[x[0] == y[0] for y in names] for x in names])
        assert sim[inside & (sim > -1)].mean() > sim[~inside].mean() + 0.3


def test_no_lists(spark):
    assert E.word2vec(spark.createDataFrame([], "tokens array<string>"), size=4, blocks=2).count() == 0


def test_pairs(spark):
    got = {(r["word"], r["context"]): r["n"] for r in E.word_pairs(spark.createDataFrame([(["x", "y", "x"],)], "tokens array<string>")).collect()}
    assert got == {("x", "y"): 2.0, ("y", "x"): 2.0, ("x", "x"): 2.0}
