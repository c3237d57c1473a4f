"""Toxicity by a classifier chain (operator 1).

The categories are predicted one after the other by linear (logistic) models;
the model of a category also reads the probabilities of the categories before
it.  In training these probabilities are out of fold: each labelled document
gets them from models fitted without its fold.

The labels say toxic or not.  The earlier categories are weakly labelled: a
toxic document belongs to a category if it holds one of its seed words.  The
features are words and word beginnings that mark toxic documents in the
labelled sample, so inflected words of any language are learned from the
labels, not listed here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BoundedMemo
from .common import bounded_batches, columns, store

# fixed values: seed words of the weakly labelled categories
SEEDS = {
    "insult": "idiot moron clown loser fool stupid dumb imbecile".split(),
    "degrading": "trash scum garbage vermin filth worthless useless".split(),
    "contempt": "disgusting pathetic despicable revolting shameful".split(),
}
CATEGORIES = [*SEEDS, "toxic"]
# documented parameters: labelled documents of either kind used for the fit,
# features kept, least z score of a feature, folds, ridge penalty, threshold
TOXIC_SAMPLE, CLEAN_SAMPLE, FEATURES, LEAST_Z, FOLDS, PENALTY, THRESHOLD = 2000, 4000, 400, 5.0, 3, 1.0, 0.5
PREFIXES = (4, 5, 6)

_WORDS = re.compile(r"\w+").findall


def word_features(word: str) -> list[str]:
    """The word and its beginnings (marked by a star)."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def text_features(text: str | None) -> set[str]:
    return {f for w in set(_WORDS((text or "").lower())) for f in word_features(w)}


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 25) -> np.ndarray:
    """Weights (intercept last) of ridge logistic regression by Newton steps;
    a constant model where only one class is there."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    n, k = len(y), float(y.sum())
    w[-1] = np.log((k + 0.5) / (n - k + 0.5))
    if not 0 < k < n:
        return w
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + (ridge * v * v).sum() / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        move = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        while (after := loss(w + move)) > now and np.abs(move).max() > 1e-7:
            move = move / 2
        w = w + move
        if now - after < 1e-9 * max(1.0, now):
            break
        now = after
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))


@dataclass
class Chain:
    features: list[str] = field(default_factory=list)
    models: list[np.ndarray] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """rows x categories; each model reads the features and the
        probabilities before its own."""
        for w in self.models:
            x = np.hstack([x, predict(x, w)[:, None]])
        return x[:, len(self.features):]


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """One model per column of ``labels``.  The probabilities that later
    models are trained on are predicted out of fold."""
    models = []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        models.append(fit_logistic(x, y))
        held_out = np.zeros(len(x))
        for f in range(FOLDS):
            out = fold == f
            if out.any():
                held_out[out] = predict(x[out], fit_logistic(x[~out], y[~out]))
        x = np.hstack([x, held_out[:, None]])
    return models


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, features, seeds: at most TOXIC_SAMPLE toxic and
    CLEAN_SAMPLE other labelled documents, chosen by the hash of their ids."""
    known = columns(labels, doc_id=("doc_id", "long"), toxic=("toxic", "int")).dropna()
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    def pick(toxic: bool, most: int) -> DataFrame:
        return known.filter(F.col("toxic") > 0 if toxic else F.col("toxic") <= 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    chosen = store(pick(True, TOXIC_SAMPLE).unionByName(pick(False, CLEAN_SAMPLE)), "chosen")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text"):
            found = [sorted(text_features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.string()))],
                                             names=["doc_id", "toxic", "features"])

    # the chosen ids are bounded by the sample sizes
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return store(texts.mapInArrow(read, "doc_id long, toxic int, features array<string>"), "sample")


def fit(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fit the chain on the bounded sample.  Without toxic or clean labels
    the chain predicts the prior."""
    sample = labelled_sample(docs, labels)
    totals = {r["toxic"] > 0: r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(True, 0), totals.get(False, 0)
    if not n1 or not n0:
        return Chain()
    a, b = F.col("a") / n1, F.col("b") / n0
    z = (a - b) / F.sqrt((F.col("a") + F.col("b") + 1) / (n1 + n0) / min(n1, n0))
    toxic = (F.col("toxic") > 0).cast("int")
    best = (sample.select(toxic.alias("t"), F.explode("features").alias("feature")).groupBy("feature")
            .agg(F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b")).withColumn("z", z)
            .filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature"))
    names = sorted(r["feature"] for r in best.collect())
    seeds = sorted({s for words in SEEDS.values() for s in words})
    wanted = F.array(*[F.lit(s) for s in sorted({*names, *seeds})])
    rows = (sample.select("doc_id", toxic.alias("t"), F.array_intersect("features", wanted).alias("found"))
            .orderBy("doc_id").collect())  # at most the sample, a few features each
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    y = np.zeros((len(rows), len(CATEGORIES)))
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r["found"] if f in at]] = 1
        y[i] = [r["t"] and any(s in r["found"] for s in SEEDS[c]) if c in SEEDS else r["t"] for c in CATEGORIES]
    fold = np.arange(len(rows)) % FOLDS
    return Chain(names, fit_chain(x, y, fold))


class _Scorer:
    """Probabilities of a task's texts; the features of chunks are remembered."""

    def __init__(self, chain: Chain):
        self.chain, self.at = chain, {f: i for i, f in enumerate(chain.features)}
        self.known = BoundedMemo()

    def _found(self, text: str | None) -> bytes:
        chunks, known = (text or "").split(), self.known
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            found = {c: known.get(c) for c in chunks}
            for c, before in found.items():
                if before is None:
                    at = [self.at[f] for w in _WORDS(c.lower()) for f in word_features(w) if f in self.at]
                    found[c] = np.array(at, "<u2").tobytes()
                    known.remember(c, found[c])
            return b"".join(map(found.__getitem__, chunks))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if not self.chain.models:
            return np.zeros((len(texts), len(CATEGORIES)))
        x = np.zeros((len(texts), len(self.at)))
        for k, text in enumerate(texts):
            x[k, np.frombuffer(self._found(text), "<u2")] = 1
        return self.chain.probabilities(x)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, rid, p (one probability per category)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(chain)
        for batch in bounded_batches(batches, "text"):
            p = scorer(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(list(p), pa.list_(pa.float64()))],
                                             names=["doc_id", "rid", "p"])

    return docs.select("doc_id", "rid", "text").mapInArrow(run, "doc_id long, rid long, p array<double>")


def fit_on(training: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    return fit(columns(training, doc_id=(id_col, "long"), text=(text_col, "string")), labels)


def toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, p_<category> and ``rejected`` for every row of ``docs``.

    The chain is fitted on ``training`` (doc_id, text) and ``labels`` (doc_id,
    toxic); without toxic or clean labels all probabilities are 0.  A null or
    empty text has no features.  Repeated rows and null ids are scored like
    any other row; labels without an id or a value are not used.
    """
    chain = fit_on(training, labels, id_col, text_col)
    narrow = (columns(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
              .withColumn("rid", F.monotonically_increasing_id()))
    p = [F.get("p", i).alias(f"p_{c}") for i, c in enumerate(CATEGORIES)]
    return score(narrow, chain).select("rid", "doc_id", *p, (F.get("p", len(CATEGORIES) - 1) >= threshold).alias("rejected"))


def reject_toxic(docs: DataFrame, training: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; they
    pass through the scoring task, so nothing is shuffled."""
    chain = fit_on(training, labels, id_col, text_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots have no path
    text = f"c{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(chain)
        for batch in bounded_batches(batches, text):
            yield batch.filter(pa.array(scorer(batch.column(text).to_pylist())[:, -1] < threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
