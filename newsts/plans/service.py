"""End-to-end service flows (§3.1 train, §3.2 forecast and publish) and the
experiment runner (V13), composed from the operators.

News features per day (all distributed, documents never gathered), 28 columns:
  sentiment  T1 clean → T10 lexicon → A1 daily mean → F18 → W12 decay
  topics     T19 document vectors → F11 by dimension → T12 topics → A1 daily mean → W12 decay
  geo        T16 cosine of document vectors with six pattern phrases → A3 daily max → W12 decay
aligned with J5 and joined to four daily price columns: 32 columns, 25 lags and
three calendar columns (W3) make 803 features.  They are scaled and screened by
RFE with Lasso from one Gram (X7), the kept ones fit a linear model (M1) of the
label; its residual is decomposed (X6) and each part has a boosted model on the
scaled features (M9).  ``service_train`` writes all of it as one version of
artefacts (K7); ``service_forecast`` opens the newest complete version and fits
nothing.  The decomposition is the centred one, so rows within half a period of
an end train no part; boosted trees stand in for the network.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.scale import combined_sentiment, minmax_apply, minmax_fit, minmax_invert
from ..operators import evaluate as V
from ..operators import gram as G
from ..operators import lagged as W
from ..operators import models as M
from ..operators import select as X
from ..operators import stats as ST
from ..operators import text as TO
from ..operators import topics as TP
from ..operators import vectors as VE
from ..operators.align import columns_outer
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sinks import artefacts as A
from ..sinks import writers as K
from ..sources import tables as S
from ..streaming.stream import work_dir
from .registry import register
from .vector_queries import with_vectors

# parameters of the service: lags, days of news, kept features, topics, period
# of the residual, Lasso penalty as a share of the label's standard deviation
PAST, DAYS, SELECTED, TOPICS, PERIOD, PENALTY = 25, 200, 10, 5, 10, 0.05
CONTRACTS = ["CLC4", "CLC3", "CLC2", "CLC1"]  # the label last
PARTS = ["trend", "seasonal", "residual"]
CALENDAR = ["month", "day", "day_in_week"]

# fixed values: the six pattern phrases of the geopolitical similarity, as published
GEO_PHRASES = {
    "Geopolitical_Threats": "Geopolitical risk concern tension uncertainty United States tensions military war geopolitical coup guerrilla "
                            "warfare Latin America Central America South America Europe Africa Middle East Far East Asia",
    "Nuclear_Threats": "nuclear war atomic war nuclear conflict atomic conflict nuclear missile fear threat risk peril menace",
    "War_Threats": "war risk risk of war fear of war war fear military threat war threat threat of war military action military operation "
                   "military fce risk threat",
    "Terrorist_Threats": "terrorist threat threat of terrorism terrorism menace menace of terrorism terrorist risk terr risk risk of "
                         "terrorism terr threat",
    "War_Acts": "beginning of the war outbreak of the war onset of the war escalation of the war start of the war war military air strike "
                "war battle heavy casualties",
    "Terrorist_Acts": "terrorist act terrorist acts",
}


def _last_day(spark: SparkSession, sf: str):
    return S.table(spark, sf, "orders").select(F.max(F.to_date("o_orderdate"))).scalar()


def service_news(spark: SparkSession, sf: str) -> DataFrame:
    """documents as news of the last ``DAYS`` days of prices: doc_id, Date, text."""
    d = S.table(spark, sf, "documents")
    return d.select("doc_id", F.date_sub(_last_day(spark, sf), F.pmod("doc_id", F.lit(DAYS)).cast("int")).alias("Date"), "text")


def price_features(spark: SparkSession, sf: str) -> DataFrame:
    """Four daily price columns: least, greatest and median price, and the mean
    as the label."""
    o = S.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("Date"), F.col("o_totalprice").cast("double").alias("p"))
    return (o.filter(F.col("Date") > F.date_sub(_last_day(spark, sf), DAYS)).groupBy("Date")
            .agg(F.min("p").alias("CLC4"), F.max("p").alias("CLC3"), F.median("p").alias("CLC2"), F.avg("p").alias("CLC1")))


def news_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is read from the texts without any fit: daily sentiment, dated document
    vectors and daily similarity with the pattern phrases, all stored."""
    from .text_queries import NEGATIONS, lexicon
    news = service_news(spark, sf)
    dated = news.select("doc_id", "Date")
    # read by three branches: written once to the shared checkpoint folder
    cleaned = cut_lineage(TO.clean(news.select("doc_id", "text")))
    sent = TO.sentiment(cleaned, lexicon(spark), text_col="clean", negations=NEGATIONS).join(dated, "doc_id")
    daily_s = sent.groupBy("Date").agg(F.avg("polarity").alias("Polarity"), F.avg("subjectivity").alias("Subjectivity"))
    daily_s = daily_s.withColumn("Combined_Sentiment", combined_sentiment("Polarity", "Subjectivity"))
    daily_s = W.linear_decay(daily_s, ["Polarity", "Subjectivity", "Combined_Sentiment"])

    phrases = spark.createDataFrame(list(GEO_PHRASES.items()), "name string, phrase string")
    said = phrases.select("name", F.explode(TX.tokens("phrase")).alias("token"))

    def words(rows: DataFrame) -> DataFrame:
        return with_vectors(spark, sf, rows)

    docs = cut_lineage(VE.sentence_vectors(cleaned, words, token_col="clean", split=True).join(dated, "doc_id"))

    patterns = VE.inline_patterns(VE.sentence_vectors(said, words, id_col="name"), "name", "sentence_vector")  # six vectors
    daily_g = VE.pattern_similarity(docs, "sentence_vector", patterns, prefix="")
    daily_g = W.linear_decay(daily_g, [n for n, _ in patterns])
    return cut_lineage(daily_s), docs, cut_lineage(daily_g)


def news_features(spark: SparkSession, sf: str, fitted: A.Opened | None = None,
                  parts: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> tuple[DataFrame, dict]:
    """(daily features, what was fitted for them: scaler and topic model of the
    document vectors).  With ``fitted`` both come from there; with ``parts``,
    the :func:`news_parts` of the same tables, the texts are not read again."""
    from pyspark.ml.clustering import LocalLDAModel

    daily_s, docs, daily_g = news_parts(spark, sf) if parts is None else parts
    first = docs.first()
    size = len(first["sentence_vector"]) if first is not None else 0
    dims = [f"d{i}" for i in range(size)]
    wide = docs.select("doc_id", "Date", *[F.col("sentence_vector")[i].alias(d) for i, d in enumerate(dims)])
    scaler = minmax_fit(wide, dims) if fitted is None else fitted.table("emb_scaler")
    # values of later documents may lie outside the fitted range: the topic model takes none below 0
    scaled = cut_lineage(minmax_apply(wide, scaler, dims).select("doc_id", "Date", F.array(*[F.greatest(F.lit(0.0), d) for d in dims]).alias("v")))
    lda = TP.lda_vectors_fit(scaled, "v", k=TOPICS) if fitted is None else fitted.model("lda", LocalLDAModel)
    topics = TP.lda_vectors_apply(scaled, "v", lda, keep=["Date"])
    tcols = [f"Topic{i + 1}" for i in range(TOPICS)]
    daily_t = W.linear_decay(topics.groupBy("Date").agg(*[F.avg(c).alias(c) for c in tcols]), tcols)

    # one row per day, read by several later jobs
    return cut_lineage(columns_outer([daily_s, daily_t, daily_g])), {"emb_scaler": scaler, "lda": lda}


def lag_rows(feats: DataFrame, prices: DataFrame, past: int, train: bool) -> tuple[DataFrame, list[str]]:
    """(Date, x0.. [, y]; names of x0..): W3 for training, W4 for forecasting,
    where today takes the slot of t-1.  Built from one array a row, so that the
    plan does not grow with the 803 columns."""
    xy = feats.join(prices, "Date").dropna("any")
    cols = [c for c in xy.columns if c not in ("Date", *CONTRACTS)] + CONTRACTS
    rows = W.supervised(xy, cols, past if train else past - 1, 1, as_array=True)
    wide = past * len(cols)
    made = rows.select("Date", *[t.cast("double").alias(c) for t, c in zip(W.time_features("Date"), CALENDAR, strict=True)], "features")
    xs = [F.col(c) for c in CALENDAR] + [F.col("features")[i] for i in range(wide)]
    label = [F.element_at("features", -1).alias("y")] if train else []
    names = CALENDAR + W.supervised_names(cols, past, 1)[:wide]
    return made.select("Date", *[x.alias(f"x{i}") for i, x in enumerate(xs)], *label), names


def train(spark: SparkSession, sf: str, base: str, past: int = PAST, n_select: int = SELECTED) -> dict:
    """§3.1: fit everything and write it as one version below ``base``."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    parts = news_parts(spark, sf)
    feats, fitted = news_features(spark, sf, parts=parts)
    m, names = lag_rows(feats, price_features(spark, sf), past, train=True)
    m, xs = cut_lineage(m), [f"x{i}" for i in range(len(names))]
    row = G.gram(m, xs, "y").first()
    if row is None or row["n"] < n_select + 2:
        raise ValueError("too few days with all features to train on")
    g = G.to_numpy(row.asDict())
    # one aggregate of vectors: a plan of two aggregates a feature takes long to make
    bounds = m.agg(Summarizer.metrics("min", "max").summary(array_to_vector(F.array(*xs))).alias("s")).select("s.*").first()
    lo, hi = bounds["min"].toArray(), bounds["max"].toArray()
    penalty = PENALTY * float(np.sqrt(max(g["yy"] / g["n"] - (g["sy"] / g["n"]) ** 2, 0.0)))
    ranks = X.rfe_order(X.scale_gram(g, lo, hi), min(n_select, len(xs)), "lasso", penalty, max_iter=1000, tol=1e-6)
    chosen = [x for x, r in zip(xs, ranks, strict=True) if r == 1]
    m = m.select("Date", *chosen, "y")
    linear = M.linear_fit(G.gram(m, chosen, "y"))
    fit = cut_lineage(M.linear_apply(m, linear, chosen, out="lin").withColumn("res", F.col("y") - F.col("lin")))
    feature_scaler = minmax_fit(fit, chosen)
    targets = ST.decompose_classical(fit, "res", PERIOD).dropna(subset=PARTS)
    label_scaler = minmax_fit(targets, PARTS)
    scaled = cut_lineage(minmax_apply(minmax_apply(targets, feature_scaler, chosen), label_scaler, PARTS))
    version = A.Version(spark, base)
    version.table("selector", spark.createDataFrame([(x, names[int(x[1:])], past) for x in chosen], "x string, feature string, past int"))
    for name, table in (("linear", linear), ("feature_scaler", feature_scaler), ("label_scaler", label_scaler), ("emb_scaler", fitted["emb_scaler"])):
        version.table(name, table)
    version.model("lda", fitted["lda"])
    for part in PARTS:
        model, _ = M.ml_fit(scaled, chosen, part, "gbt", maxDepth=2, maxIter=10, seed=42)
        version.model(f"part_{part}", model)
    return {"path": version.complete(), "fit": fit, "chosen": chosen, "names": {x: names[int(x[1:])] for x in chosen}, "linear": linear,
            "parts": parts}


def predict(spark: SparkSession, sf: str, base: str, parts: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """§3.2: Date (of the day after), lin, yhat from the newest complete
    version below ``base``; nothing is fitted.  ``parts`` as in :func:`news_features`."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressionModel
    saved = A.Opened(spark, base)
    picked = [(r["x"], r["past"]) for r in saved.table("selector").collect()]  # the kept features
    chosen = sorted((x for x, _ in picked), key=lambda x: int(x[1:]))
    feats, _ = news_features(spark, sf, saved, parts)
    rows, _ = lag_rows(feats, price_features(spark, sf), picked[0][1], train=False)
    rows = M.linear_apply(rows.select("Date", *chosen), saved.table("linear"), chosen, out="lin")
    scaled = minmax_apply(rows, saved.table("feature_scaler"), chosen)
    scaled = VectorAssembler(inputCols=chosen, outputCol="features", handleInvalid="skip").transform(scaled)
    for part in PARTS:
        model = saved.model(f"part_{part}", GBTRegressionModel).setPredictionCol(part)
        scaled = model.transform(scaled)
    back = minmax_invert(scaled, saved.table("label_scaler"), PARTS)
    total = F.col("lin") + sum((F.col(p) for p in PARTS[1:]), F.col(PARTS[0]))
    return back.select(F.date_add("Date", 1).alias("Date"), "lin", total.alias("yhat"))


def _base(spark: SparkSession, sf: str) -> str:
    """The artefacts of this application for one set of tables."""
    name = f"service-{spark.sparkContext.applicationId}-{hashlib.sha256(sf.encode()).hexdigest()[:12]}"
    return os.path.join(ensure_checkpoint_dir(spark), name)


@register("service_train")
def service_train(spark, sf):
    """§3.1: news and price features → 25 lags → RFE-Lasso (scaled) → linear
    fit and one model per part of its residual, saved as a version; returns
    the selected features with their coefficients and the in-sample errors."""
    t = train(spark, sf, _base(spark, sf))
    row = t["linear"].first()
    coefs = spark.createDataFrame([(t["names"][x], float(b)) for x, b in zip(t["chosen"], row["coef"], strict=True)], "feature string, coef double")
    err = V.errors(t["fit"], "y", "lin").first()
    return coefs.withColumn("intercept", F.lit(float(row["intercept"]))).withColumn("in_sample_mae", F.lit(float(err["mae"])))


@register("service_forecast")
def service_forecast(spark, sf):
    """§3.2: forecast from the newest complete version of this application's
    artefacts (one is trained if there is none, and its texts are not read twice), published
    without the days already there (K6: last 20, weekend roll, anti-join)."""
    base, parts = _base(spark, sf), None
    try:
        A.Opened(spark, base)
    except FileNotFoundError:
        parts = train(spark, sf, base)["parts"]
    fc = cut_lineage(predict(spark, sf, base, parts).select("Date", "yhat"))
    published = fc.filter(F.col("Date") <= F.date_sub(fc.select(F.max("Date")).scalar(), 5)).select("Date")
    return K.publish_frame(fc, published, value_col="yhat", last_n=20)


def run_experiment(news_fn: Callable[[], DataFrame], prices: DataFrame, fit: Callable, apply: Callable,
                   description: str, ledger: str | None = None, ratio: float = 2 / 3) -> DataFrame:
    """Load → features → inner join → ordered split → fit → evaluate →
    ledger row (appended when ``ledger`` is given)."""
    from ..operators.split import ordered_split
    feats = news_fn()
    xy = feats.join(prices, on="Date", how="inner")
    sp = ordered_split(xy, ratio)
    model = fit(sp.filter("role = 'train'"))
    scored = apply(sp.filter("role = 'test'"), model)
    row = V.errors(scored, "y", "yhat").withColumn("h", F.lit(1))
    if ledger:
        K.ledger_append(row, ledger, description)
    return row.withColumn("descriptions", F.lit(description))


@register("experiment")
def experiment(spark, sf):
    """V13 on the service features: lagged news features vs next-day label."""
    feats, _ = news_features(spark, sf)
    prices = price_features(spark, sf).select("Date", F.col("CLC1").alias("y"))
    cols = [c for c in feats.columns if c != "Date"]

    def news_fn():
        lagged = W.shift(feats, cols, 1)
        return lagged.select("Date", *[W.q(W.lag_name(c, 1)).alias(f"f{i}") for i, c in enumerate(cols)]).dropna()

    xs = [f"f{i}" for i in range(len(cols))]

    def fit(train):
        return M.linear_fit(G.gram(train, xs, "y"), kind="ridge", alpha=1.0)

    def apply(test, model):
        return M.linear_apply(test, model, xs)

    ledger = os.path.join(work_dir(spark, "experiment"), "ledger")
    return run_experiment(news_fn, prices, fit, apply, "ridge(1); lagged news features; h=1", ledger)
