"""Word vectors move to a bounded number of frequent words and to the rest's own tokens."""
import numpy as np
import pytest


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_sentence_vectors_by_join_and_by_frequent_words(spark, monkeypatch, most):
    from newsts.operators import vectors as VE
    monkeypatch.setattr(VE, "HOT_WORDS", most)
    rng = np.random.default_rng(1)
    words = {f"w{i}": rng.normal(size=4) for i in range(20)}
    said = [(int(rng.integers(0, 12)), f"w{min(int(rng.exponential(4)), 24)}") for _ in range(400)] + [(None, "w1"), (5, None), (77, "unknown")]
    table = spark.createDataFrame([(w, [float(x) for x in v]) for w, v in words.items()] + [("zero", [0.0] * 4)], "term string, vector array<double>")
    tokens = spark.createDataFrame(said, "doc_id long, token string").repartition(5)
    asked = []

    def lookup(rows):
        asked.append(rows.count())
        return rows.join(table, "term")

    want = {}
    for d, w in said:
        if w in words:
            want.setdefault(d, []).append(words[w] / np.linalg.norm(words[w]))
    for source in (table, lookup):
        got = {r["doc_id"]: np.array(r["sentence_vector"]) for r in VE.sentence_vectors(tokens, source).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[d], np.mean(v, axis=0)) for d, v in want.items())
    assert asked[0] <= most  # frequent words; the others by their tokens


def test_a_word_with_two_vectors_counts_for_each(spark):
    from newsts.operators import vectors as VE
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 2.0]), ("b", [3.0, 0.0])], "term string, vector array<double>")
    tokens = spark.createDataFrame([("x", "a"), ("x", "b")], "doc_id string, token string")
    (row,) = VE.sentence_vectors(tokens, table).collect()
    assert row["sentence_vector"] == pytest.approx([2 / 3, 1 / 3])
