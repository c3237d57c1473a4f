"""Topic models, Spark ML models and composite forecasters (T11-T14, X15,
M4, M5, M9-M11, M13).  Iterative fits: rows-only checks plus numpy tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scale import minmax_apply, minmax_fit
from ..operators import evaluate as V
from ..operators import gram as G
from ..operators import lagged as W
from ..operators import models as M
from ..operators import select as X
from ..operators import stats as ST
from ..operators import text as TO
from ..operators import topics as TP
from ..operators.split import number_rows, ordered_split
from ..session import cut_lineage
from ..sources import tables as S
from .core_queries import EWIDE
from .ols_sql import fitted, ols_ctes
from .registry import register
from .text_queries import _cooc, _t2_terms, _t2_texts, _vocab
from .vector_queries import with_vectors


@register("lda_counts")
def lda_counts(spark, sf):
    """LDA (k=4) over document term counts; a document's topics are the
    mean of its words' topic vectors."""
    edges, terms = TP.term_edges(_t2_texts(spark, sf), term_col="clean", split=True)
    phi, _ = TP.lda_terms_fit(edges, terms, k=4)
    return TP.lda_terms_apply(edges, phi, k=4)


@register("lda_vectors")
def lda_vectors(spark, sf):
    """T12 (+F11, A1): sentence vectors → min-max scaled per dimension →
    LDA k=5 fitted once → topic shares per document → daily mean."""
    from ..operators.vectors import sentence_vectors
    texts = _t2_texts(spark, sf)
    sv = cut_lineage(sentence_vectors(texts, lambda rows: with_vectors(spark, sf, rows), token_col="clean", split=True))  # read by the scaler and the scaled rows
    dims = [f"d{i}" for i in range(64)]
    wide = sv.select("doc_id", *[F.col("sentence_vector")[i].alias(d) for i, d in enumerate(dims)])
    params = minmax_fit(wide, dims)
    scaled = cut_lineage(minmax_apply(wide, params, dims).select("doc_id", F.array(*dims).alias("v")))
    lda = TP.lda_vectors_fit(scaled, "v", k=5)
    topics = TP.lda_vectors_apply(scaled, "v", lda, keep=["doc_id"])
    dated = S.news(spark, sf).select(F.col("ID").alias("doc_id"), "Date")
    return topics.join(dated, "doc_id").groupBy("Date").agg(*[F.avg(f"Topic{i}").alias(f"Topic{i}") for i in range(1, 6)])


def _nmf_inputs(spark, sf):
    vocab = _vocab(spark, sf)
    dt = TO.doc_term(_t2_terms(spark, sf), vocab)
    return dt


@register("nmf")
def nmf(spark, sf):
    """NMF (k=4) of the term×document counts, HALS updates with the
    operator's own stop rule: the document factor."""
    W_, H, losses = TP.nmf_fit(_nmf_inputs(spark, sf), 2000, k=4)
    return H.select("doc_id", *[F.col("h")[j].alias(f"h{j}") for j in range(4)])


@register("sea_nmf")
def sea_nmf(spark, sf):
    """NMF with the PPMI semantic term (alpha 0.1, beta 0) with the
    operator's own stop rule: the term factor."""
    c, _ = _cooc(spark, sf)
    pp = TO.ppmi(c).filter(F.col("ppmi") > 0)
    W_, H, losses = TP.nmf_fit(_nmf_inputs(spark, sf), 2000, k=4, ppmi=pp, alpha=0.1)
    return spark.createDataFrame([(i + 1, *map(float, w)) for i, w in enumerate(W_)],
                                 "term_id int, " + ", ".join(f"w{j} double" for j in range(4)))


@register("pca")
def pca(spark, sf):
    """PCA (k=2) of the lineitem numeric columns; explained variance."""
    model, va = X.pca_fit(S.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2)
    ev = model.explainedVariance.toArray().tolist()
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(ev)], "component int, explained double")


@register("glm_poisson")
def glm_poisson(spark, sf):
    """M4: Poisson GLM of the order line quantity."""
    model, _ = M.ml_fit(S.table(spark, sf, "lineitem"), ["l_discount", "l_tax"], "l_quantity", "glm", family="poisson")
    return spark.createDataFrame([(float(model.intercept), [float(x) for x in model.coefficients])], "intercept double, coef array<double>")


def _event_xy(spark, sf):
    wide = S.events_daily_wide(spark, sf)
    sup = W.supervised(wide, S.EVENT_TYPES, 1, 1)
    xs = [W.lag_name(c, 1) for c in S.EVENT_TYPES]
    renamed = sup.select("Date", *[W.q(x).alias(f"x{i}") for i, x in enumerate(xs)], W.q("purchase(t)").alias("y"))
    return renamed, [f"x{i}" for i in range(len(xs))]


@register("trees")
def trees(spark, sf):
    """M5: decision tree, random forest and boosted stumps (30 rounds, rate
    0.01) on lagged event features; train 2/3, test errors per model."""
    xy, xs = _event_xy(spark, sf)
    sp = ordered_split(xy, 2 / 3)
    train, test = sp.filter("role = 'train'"), sp.filter("role = 'test'")
    outs = []
    for kind, params in [("tree", {"maxDepth": 3, "seed": 42}), ("forest", {"numTrees": 20, "seed": 42}),
                         ("gbt", {"maxDepth": 1, "maxIter": 30, "stepSize": 0.01, "seed": 42})]:
        model, va = M.ml_fit(train, xs, "y", kind, **params)
        pred = model.transform(va.transform(test)).withColumnRenamed("prediction", "yhat")
        outs.append(V.errors(pred, "y", "yhat").withColumn("model", F.lit(kind)))
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b), outs)


def hybrid_targets(sp, xs):
    """(rows with the linear model and its residual, training targets of the
    parts).  Model and parts come from train rows alone; rows without a
    centred trend (the ends) are not trained on."""
    train = sp.filter("role = 'train'")
    params = M.linear_fit(G.gram(train, xs, "y"))
    lin = M.linear_apply(sp, params, xs, out="lin").withColumn("res", F.col("y") - F.col("lin"))
    parts = ST.decompose_classical(lin.filter("role = 'train'"), "res", 10)
    return lin, parts.dropna(subset=["trend", "seasonal", "residual"])


@register("hybrid_forecast")
def hybrid_forecast(spark, sf):
    """M9: linear model on lagged features (Gram), its train residual
    decomposed (classical, period 10) into trend / seasonal / residual, one
    boosted model per part on the same features; forecast = linear + Σ parts.
    Errors on the test rows next to the linear model alone."""
    xy, xs = _event_xy(spark, sf)
    lin, parts = hybrid_targets(ordered_split(xy, 0.7), xs)
    parts = cut_lineage(parts)
    pred = lin
    for part in ("trend", "seasonal", "residual"):
        model, va = M.ml_fit(parts, xs, part, "gbt", maxDepth=2, maxIter=10, seed=42)
        pred = model.transform(va.transform(pred)).withColumnRenamed("prediction", f"p_{part}").drop("features")
    pred = pred.withColumn("yhat", F.col("lin") + F.col("p_trend") + F.col("p_seasonal") + F.col("p_residual"))
    test = pred.filter("role = 'test'")
    return V.errors(test, "y", "yhat").withColumn("model", F.lit("hybrid")).unionByName(
        V.errors(test, "y", "lin").withColumn("model", F.lit("linear")))


# lagged event means x0..x4 and the label y, split 70 : 30 in time order
_X = [f"x{i}" for i in range(5)]
EVENT_XY = f"""{EWIDE}, xy AS (SELECT "Date", {', '.join(f'lag("{c}") OVER (ORDER BY "Date") AS x{i}' for i, c in enumerate(S.EVENT_TYPES))}, "purchase" AS y FROM ew),
sp AS (SELECT *, row_number() OVER (ORDER BY "Date") AS rn, count(*) OVER () AS n FROM xy
       WHERE {' AND '.join(f'x{i} IS NOT NULL' for i in range(5))} AND y IS NOT NULL),
tr AS (SELECT * FROM sp WHERE rn <= floor(n * 0.7)), {ols_ctes("tr", _X, "y")},
pr AS (SELECT sp.*, {fitted(_X)} AS yhat FROM sp, ols)"""


@register("horizon_forecast", f"""WITH {EVENT_XY},
h AS ({' UNION ALL '.join(f'SELECT CAST({h} AS INTEGER) AS h, rn, n, y, lag(yhat, {h - 1}) OVER (ORDER BY "Date") AS f FROM pr' for h in (1, 2, 3))})
SELECT h, count(*) AS n, round(avg(abs(f - y)), 5) AS mae, round(sqrt(avg((f - y) ** 2)), 5) AS rmse
FROM h WHERE rn > floor(n * 0.7) GROUP BY h""")
def horizon_forecast(spark, sf):
    """One linear one-step model; the h-step forecast of a day is the
    prediction made h−1 days earlier (h = 1..3); errors per horizon."""
    xy, xs = _event_xy(spark, sf)
    sp = ordered_split(xy, 0.7)
    params = M.linear_fit(G.gram(sp.filter("role = 'train'"), xs, "y"))
    pred = M.forecast_by_shift(M.linear_apply(sp, params, xs), "yhat", (1, 2, 3))
    test = pred.filter("role = 'test'")
    from functools import reduce
    out = reduce(lambda a, b: a.unionByName(b),
                 [V.errors(test, "y", f"yhat_h{h}").withColumn("h", F.lit(h)) for h in (1, 2, 3)])
    return out.select("h", "n", F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"))


@register("feature_count_search")
def feature_count_search(spark, sf):
    """RFE elimination order on the train Gram gives every subset size
    at once; each size is scored on the test rows; O8 picks the best."""
    from ..operators.align import best_config
    xy, xs = _event_xy(spark, sf)
    sp = cut_lineage(ordered_split(xy, 0.7))
    g = G.to_numpy(G.gram(sp.filter("role = 'train'"), xs, "y").first().asDict())
    ranks = X.rfe_order(g, 1, "ols")
    order = sorted(range(len(xs)), key=lambda i: ranks[i])
    # every size is a part of the one Gram, and all are scored in one scan
    sizes = []
    for n in range(1, len(xs) + 1):
        c, b = M.solve(X._sub(g, order[:n]), "ols")
        yhat = F.lit(float(c))
        for i, v in zip(order[:n], b, strict=True):
            yhat = yhat + F.col(xs[i]) * F.lit(float(v))
        sizes.append(F.struct(F.lit(n).alias("config"), yhat.alias("yhat")))
    scored = sp.filter("role = 'test'").select("y", F.explode(F.array(*sizes)).alias("s")).select("y", "s.config", "s.yhat")
    return best_config(V.errors(scored, "y", "yhat", by=["config"]), config=("config",))


@register("score_saved", f"""WITH {EVENT_XY}
SELECT "Date", round(y, 5) AS y, round(yhat, 5) AS yhat FROM pr WHERE rn > floor(n * 0.7)""")
def score_saved(spark, sf):
    """Batch scoring with saved artefacts (scaler bounds + selected
    columns + coefficients written as tables, loaded, applied)."""
    import os
    from ..sinks.writers import load_params, save_params
    from ..streaming.stream import work_dir
    xy, xs = _event_xy(spark, sf)
    sp = number_rows(xy)
    train = sp.filter(F.col("rn") <= F.floor(F.col("n") * 0.7))
    scaler = minmax_fit(train, xs)
    params = M.linear_fit(G.gram(minmax_apply(train, scaler, xs), xs, "y"))
    base = work_dir(spark, "artefacts")
    save_params(scaler, os.path.join(base, "scaler"))
    save_params(params, os.path.join(base, "model"))
    sc2, p2 = load_params(spark, os.path.join(base, "scaler")), load_params(spark, os.path.join(base, "model"))
    scored = M.linear_apply(minmax_apply(sp.filter(F.col("rn") > F.floor(F.col("n") * 0.7)), sc2, xs), p2, xs)
    return scored.select("Date", F.round("y", 5).alias("y"), F.round("yhat", 5).alias("yhat"))
