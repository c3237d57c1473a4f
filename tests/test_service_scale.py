"""Text and topics of the service: the same results with bounded sets of words, from few passes."""

import numpy as np
import pytest

from newsts.operators import text as TO
from newsts.operators import topics as TP
from newsts.operators import vectors as VE

TEXTS = ["We saw Paris and Berlin. Berlin was running! The dogs, in Paris, ran 12 times...", "paris Berlin berlin Running dogs of Rome and rome",
         "", "... ! ?", "A_b of Rome; Été in Rome, étés 2021", None, "x Berlin. x rome. y Paris y Été"]


@pytest.mark.parametrize("most", [0, 1, 2, 1000])
def test_clean_with_few_and_many_forms_in_the_tasks(spark, monkeypatch, most):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").repartition(3)
    want = {r["doc_id"]: r["clean"] for r in TO.clean(docs).collect()}
    assert {"Paris", "Berlin"} <= set(want[0].split()) and "<NUM>" in want[0]
    assert want[2] == want[3] == want[5] == ""
    monkeypatch.setattr(TO, "HOT_FORMS", most)
    monkeypatch.setattr(TO, "STEM_CACHE", 3)
    monkeypatch.setattr(TO, "FORMS", 2)
    assert {r["doc_id"]: r["clean"] for r in TO.clean(docs).collect()} == want


def test_texts_are_split_where_they_are_read(spark):
    texts = spark.createDataFrame([(1, "a b  b\tc"), (2, ""), (3, None), (1, "d a")], "doc_id int, clean string")
    rows = TO.whitespace_terms(texts)
    vectors = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate("abc")], "term string, vector array<double>")
    want = {r["doc_id"]: list(r["sentence_vector"]) for r in VE.sentence_vectors(rows, vectors, token_col="term").collect()}
    got = {r["doc_id"]: list(r["sentence_vector"]) for r in VE.sentence_vectors(texts, vectors, token_col="clean", split=True).collect()}
    assert got.keys() == want.keys() == {1} and np.allclose(got[1], want[1])
    assert {(r["w"], r["n"]) for r in VE.word_counts(texts, "clean", split=True).collect()} == {("a", 2), ("b", 2), ("c", 1), ("d", 1)}


def test_vector_topics_equal_the_library_without_its_passes(spark, monkeypatch):
    import pyspark.ml.clustering as C
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(2)
    x = rng.random((300, 8)) * np.where(np.arange(300) % 2, 1, 4)[:, None] ** np.arange(8)
    x[7] = 0.0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id int, v array<double>").repartition(3).checkpoint()
    old = C.LDA(k=3, seed=5, maxIter=4, optimizer="online", subsamplingRate=1.0).fit(df.select(array_to_vector("v").alias("features")).checkpoint())
    passes, fit = [], C.LDA._fit
    monkeypatch.setattr(C.LDA, "_fit", lambda self, data: passes.append(self.getMaxIter()) or fit(self, data))
    monkeypatch.setattr(TP, "VECTORS", 16)
    new = TP.lda_vectors_fit(df, "v", k=3, seed=5, max_iter=4)
    assert passes == [0]
    np.testing.assert_allclose(new.topicsMatrix().toArray(), old.topicsMatrix().toArray(), rtol=1e-6)
    np.testing.assert_allclose(new.estimatedDocConcentration().toArray(), old.estimatedDocConcentration().toArray(), rtol=1e-6)
    assert (new.getK(), new.getSeed(), new.getMaxIter()) == (3, 5, 4)
    a, b = ({r["doc_id"]: [r[f"Topic{i}"] for i in (1, 2, 3)] for r in TP.lda_vectors_apply(df, "v", m, keep=["doc_id"]).collect()} for m in (new, old))
    np.testing.assert_allclose([a[i] for i in range(300)], [b[i] for i in range(300)], atol=1e-6)


def test_similarity_of_vectors_without_length(spark):
    df = spark.createDataFrame([("d", [1.0, 0.0]), ("d", [0.0, 0.0]), ("e", None), ("f", [3.0, 4.0])], "Date string, v array<double>")
    got = {r["Date"]: (r["a"], r["z"]) for r in VE.pattern_similarity(df, "v", [("a", [0.0, 2.0]), ("z", [0.0, 0.0])], prefix="").collect()}
    assert got == {"d": (0.0, None), "e": (None, None), "f": (pytest.approx(0.8), None)}


def test_a_lexicon_looked_up_in_texts_equals_a_joined_one(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "not good. GOOD very bad"), (2, "nothing here"), (3, ""), (4, None), (5, "good")], "doc_id int, text string")
    lexicon = spark.createDataFrame([("good", 0.7, 0.6, 1.0), ("bad", -0.7, 0.7, 1.0), ("very", 0.2, 0.3, 1.3)], "term string, polarity double, subjectivity double, intensity double")
    got = sorted(map(tuple, TO.sentiment(docs, lexicon).collect()))
    monkeypatch.setattr(TO, "LEXICON_TERMS", 1)
    want = sorted(map(tuple, TO.sentiment(docs, lexicon).collect()))
    assert [g[0] for g in got] == [w[0] for w in want] == [1, 2, 5]
    np.testing.assert_allclose(got, want)


def test_a_forecast_that_trains_first_reads_the_texts_once(spark, monkeypatch):
    from newsts.plans import service as P
    from tests.conftest import SF001
    parts, given = (object(), object(), object()), []
    monkeypatch.setattr(P, "_base", lambda spark, sf: "/nowhere")

    def none(*args):
        raise FileNotFoundError
    monkeypatch.setattr(P.A, "Opened", none)
    monkeypatch.setattr(P, "train", lambda spark, sf, base: {"parts": parts})

    def predict(spark, sf, base, *more):
        given.append(more)
        return spark.createDataFrame([(f"2024-01-{d:02d}", 1.0) for d in range(1, 31)], "Date string, yhat double").selectExpr("to_date(Date) AS Date", "yhat")
    monkeypatch.setattr(P, "predict", predict)
    P.service_forecast(spark, SF001).collect()
    assert given == [(parts,)]


def test_features_from_parts_do_not_read_the_texts(spark, monkeypatch):
    from newsts.plans import service as P
    from tests.conftest import SF001
    parts = P.news_parts(spark, SF001)

    def no(*args, **options):
        raise AssertionError("the texts are read again")
    for name in ("clean", "sentiment"):
        monkeypatch.setattr(P.TO, name, no)
    monkeypatch.setattr(P.VE, "sentence_vectors", no)
    feats, _ = P.news_features(spark, SF001, parts=parts)
    assert feats.count() > 20 and len(feats.columns) == 29


def test_bounds_of_the_features_are_one_aggregate():
    import inspect

    from newsts.plans import service as P
    assert "Summarizer" in inspect.getsource(P.train) and "_lo" not in inspect.getsource(P.train)
