"""Forms of operators with a closed form in SQL (M3, M4, X1, X5, X7, X10, X15,
T16, T20, T23, O8), and the reducers and boosted stumps on lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as FV
from ..operators import arma as A
from ..operators import boost as B
from ..operators import evaluate as V
from ..operators import gram as G
from ..operators import models as M
from ..operators import reduce as R
from ..operators import select as X
from ..operators import stats as ST
from ..operators import vectors as VE
from ..operators.split import ordered_split
from ..sources import tables as S
from .arma_queries import order_grid
from .core_queries import EWIDE, ODAILY
from .ols_sql import fitted, ols_ctes
from .registry import REGISTRY, register
from .service import GEO_PHRASES
from .text_queries import T2_SQL, WS_TERMS, _t2_terms
from .vector_queries import EMB, TRIPLES, WORDVEC_SQL, _long, _triples, with_vectors, word_vectors

LI_X = ["l_quantity", "l_discount", "l_tax"]


# M3 --------------------------------------------------------------------------
@register("elastic_net", """
SELECT l_returnflag, round(sign(s) * greatest(abs(s) - n * 200.0 * 0.5, 0) / (v + n * 200.0 * 0.5), 5) AS slope
FROM (SELECT l_returnflag, count(*) AS n, covar_pop(l_extendedprice, l_quantity) * count(*) AS s, var_pop(l_quantity) * count(*) AS v
      FROM lineitem GROUP BY 1)""")
def elastic_net(spark, sf):
    """M3: elastic net (alpha 200, half of it L1) by coordinate descent on the
    Gram of each return flag; with one feature the soft threshold."""
    g = G.gram(S.table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", by=["l_returnflag"])
    p = M.linear_fit(g, by=["l_returnflag"], kind="enet", alpha=200.0, l1_ratio=0.5)
    return p.select("l_returnflag", F.round(F.col("coef")[0], 5).alias("slope"))


# M4 --------------------------------------------------------------------------
FAMILIES = {"poisson": {"family": "poisson", "link": "log"}, "gamma": {"family": "gamma", "link": "log"},
            "tweedie": {"family": "tweedie", "variancePower": 1.5, "linkPower": 0.0}}


@register("glm_families", f"""
SELECT family, round(ln(avg(l_quantity) FILTER (l_linestatus = 'F')), 5) AS intercept,
       round(ln(avg(l_quantity) FILTER (l_linestatus = 'O') / avg(l_quantity) FILTER (l_linestatus = 'F')), 5) AS slope
FROM lineitem CROSS JOIN (VALUES {', '.join(f"('{f}')" for f in FAMILIES)}) t(family) GROUP BY family""")
def glm_families(spark, sf):
    """M4: Poisson, Gamma and Tweedie regressions with a log link of the
    quantity on the line status; with one indicator the means of both groups."""
    li = S.table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("y"), (F.col("l_linestatus") == "O").cast("double").alias("x"))
    rows = []
    for name, options in FAMILIES.items():
        model, _ = M.ml_fit(li, ["x"], "y", "glm", maxIter=50, tol=1e-12, **options)
        rows.append((name, float(model.intercept), float(model.coefficients[0])))
    return spark.createDataFrame(rows, "family string, intercept double, slope double").withColumns(
        {c: F.round(c, 5) for c in ("intercept", "slope")})


# M5 --------------------------------------------------------------------------
@register("adaboost")
def adaboost(spark, sf):
    """M5: AdaBoost of 30 stumps (rate 0.01) of the extended price; train 70 %
    of the order keys, test errors."""
    li = S.table(spark, sf, "lineitem").select("l_orderkey", *LI_X, "l_extendedprice").withColumn("test", F.pmod(F.xxhash64("l_orderkey"), F.lit(10)) >= 7)
    members = B.adaboost_fit(li.filter("NOT test"), LI_X, "l_extendedprice")
    scored = B.adaboost_apply(li.filter("test"), members, LI_X)
    return V.errors(scored, "l_extendedprice", "yhat").withColumn("members", F.lit(len(members)))


# X1 / X5 -----------------------------------------------------------------------
@register("adf_fixed", f"""WITH {ODAILY},
l AS (SELECT "Price" - lag("Price") OVER o AS dy, lag("Price") OVER o AS y1, "Date" FROM od WINDOW o AS (ORDER BY "Date")),
m AS (SELECT *, lag(dy) OVER (ORDER BY "Date") AS d1 FROM l),
t AS (SELECT * FROM m WHERE d1 IS NOT NULL), {ols_ctes("t", ["y1", "d1"], "dy")},
e AS (SELECT count(*) AS n, sum((dy - ({fitted(["y1", "d1"], "ols.")})) ** 2) AS ssr, var_pop(y1) * count(*) AS s11,
             var_pop(d1) * count(*) AS s22, covar_pop(y1, d1) * count(*) AS s12, max(ols.b0) AS b FROM t, ols)
SELECT 'Price' AS col, round(b / sqrt(ssr / (n - 3) * s22 / (s11 * s22 - s12 * s12)), 4) AS stat, CAST(1 AS INTEGER) AS lag, n AS nobs FROM e""")
def adf_fixed(spark, sf):
    """The test's statistic with one lagged difference."""
    a = ST.adf(S.orders_daily(spark, sf), ["Price"], max_lag=1, fixed=True)
    return a.select("col", F.round("stat", 4).alias("stat"), "lag", "nobs")


_CAUSES = ["click", "view", "signup", "error"]


def _granger_sql(p: int) -> str:
    ys, xs = [f"y{i}" for i in range(1, p + 1)], [f"x{i}" for i in range(1, p + 1)]
    def ssr(name, regressors):
        return f"(SELECT sum((y - ({fitted(regressors, 'o.')})) ** 2) FROM l{p} t JOIN {name} o USING (col) WHERE t.col = k.col)"
    return (f"SELECT col, CAST({p} AS INTEGER) AS lag, round((({ssr(f'r{p}', ys)} - {ssr(f'u{p}', ys + xs)}) / {p}) / "
            f"({ssr(f'u{p}', ys + xs)} / ((SELECT count(*) FROM l{p} t WHERE t.col = k.col) - 2 * {p} - 1)), 4) AS \"F\" "
            f"FROM (SELECT DISTINCT col FROM l{p}) k")


def _granger_ctes(p: int) -> str:
    lags = [f'lag({v}, {i}) OVER o AS {v}{i}' for v in ("y", "x") for i in range(1, p + 1)]
    ys, xs = [f"y{i}" for i in range(1, p + 1)], [f"x{i}" for i in range(1, p + 1)]
    return (f'l{p} AS (SELECT * FROM (SELECT col, y, {", ".join(lags)}, row_number() OVER o AS rn FROM long WINDOW o AS (PARTITION BY col ORDER BY "Date")) '
            f'WHERE rn > {p}), {ols_ctes(f"l{p}", ys, "y", ["col"], name=f"r{p}")}, {ols_ctes(f"l{p}", ys + xs, "y", ["col"], name=f"u{p}")}')


_LONG = " UNION ALL ".join(f"""SELECT '{c}' AS col, "Date", "purchase" AS y, "{c}" AS x FROM ew""" for c in _CAUSES)


@register("granger_f", f"WITH {EWIDE}, long AS ({_LONG}), {_granger_ctes(1)}, {_granger_ctes(2)}\n{_granger_sql(1)} UNION ALL {_granger_sql(2)}")
def granger_f(spark, sf):
    """The F statistics of two lag orders."""
    g = ST.granger(S.events_daily_wide(spark, sf), "purchase", _CAUSES, 2)
    return g.select("col", "lag", F.round("F", 4).alias("F"))


# X7 / X10 ------------------------------------------------------------------------
_PAIRS = [(0, 1), (0, 2), (1, 2)]


@register("rfe_ols", f"""WITH {ols_ctes("lineitem", LI_X, "l_extendedprice", name="f")},
{', '.join(ols_ctes("lineitem", [LI_X[i], LI_X[j]], "l_extendedprice", name=f"f{i}{j}") for i, j in _PAIRS)},
one AS (SELECT CASE least(abs(b0), abs(b1), abs(b2)) WHEN abs(b0) THEN 0 WHEN abs(b1) THEN 1 ELSE 2 END AS d FROM f),
two AS (SELECT d, CASE d {' '.join(f'WHEN {3 - i - j} THEN (SELECT CASE WHEN abs(b0) <= abs(b1) THEN {i} ELSE {j} END FROM f{i}{j})' for i, j in _PAIRS)} END AS e FROM one)
SELECT feature, CAST(CASE k WHEN d THEN 3 WHEN e THEN 2 ELSE 1 END AS INTEGER) AS rank, k <> d AND k <> e AS selected
FROM two, (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(LI_X))}) t(k, feature)""")
def rfe_ols(spark, sf):
    """Recursive elimination by least-squares coefficients."""
    return X.rfe(G.gram(S.table(spark, sf, "lineitem"), LI_X, "l_extendedprice"), LI_X, 1, kind="ols")


@register("select_by_coef_ols", f"""WITH {ols_ctes("lineitem", LI_X, "l_extendedprice")},
c AS (SELECT * FROM (SELECT {', '.join(f'b{i} AS {c}' for i, c in enumerate(LI_X))} FROM ols) UNPIVOT (coef FOR feature IN ({', '.join(LI_X)})))
SELECT feature, round(coef, 3) AS coef, row_number() OVER (ORDER BY abs(coef) DESC) <= 2 AS selected FROM c""")
def select_by_coef_ols(spark, sf):
    """The two columns with the largest least-squares coefficients."""
    s = X.select_by_coef(G.gram(S.table(spark, sf, "lineitem"), LI_X, "l_extendedprice"), LI_X, "ols", max_features=2)
    return s.select("feature", F.round("coef", 3).alias("coef"), "selected")


# X15 --------------------------------------------------------------------------
@register("pca_rows", """
WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice / 1000) AS my,
                  0.5 * atan2(2 * covar_pop(l_quantity, l_extendedprice / 1000), var_pop(l_quantity) - var_pop(l_extendedprice / 1000)) AS a FROM lineitem),
d AS (SELECT *, cos(a) AS c, sin(a) AS s FROM m),
e AS (SELECT *, CASE WHEN (CASE WHEN abs(c) >= abs(s) THEN c ELSE s END) < 0 THEN -1 ELSE 1 END AS f,
             CASE WHEN (CASE WHEN abs(s) >= abs(c) THEN -s ELSE c END) < 0 THEN -1 ELSE 1 END AS g FROM d)
SELECT l_orderkey, l_linenumber, round(f * ((l_quantity - mx) * c + (l_extendedprice / 1000 - my) * s), 4) AS pc1,
       round(g * (-(l_quantity - mx) * s + (l_extendedprice / 1000 - my) * c), 4) AS pc2 FROM lineitem, e""")
def pca_rows(spark, sf):
    """Both principal components of quantity and price, by row; in SQL the
    rotation of two columns."""
    li = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"),
                                               (F.col("l_extendedprice") / 1000).alias("p"))
    rows, _ = R.pca_rows(li, ["q", "p"], 2)
    return rows.select("l_orderkey", "l_linenumber", F.round("pc1", 4).alias("pc1"), F.round("pc2", 4).alias("pc2"))


@register("factor_rows")
def factor_rows(spark, sf):
    """Two factors of the numeric lineitem columns, by row."""
    li = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LI_X, "l_extendedprice")
    rows, _, _ = R.factor_rows(li, [*LI_X, "l_extendedprice"], 2)
    return rows.select("l_orderkey", "l_linenumber", "factor1", "factor2")


@register("nmf_rows")
def nmf_rows(spark, sf):
    """Two non-negative factors of the numeric lineitem columns, by row."""
    li = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"),
                                               (F.col("l_discount") * 100).alias("discount"), (F.col("l_tax") * 100).alias("tax"))
    rows, _, _ = R.nmf_rows(li, ["l_quantity", "price", "discount", "tax"], 2, iters=20)
    return rows.select("l_orderkey", "l_linenumber", "w1", "w2")


# O8 -----------------------------------------------------------------------------
@register("best_order", f"SELECT arg_min(p, bic) AS p, arg_min(d, bic) AS d, min(bic) AS bic FROM ({REGISTRY['order_grid'][1]})")
def best_order(spark, sf):
    """O8 over the M7 grid: the order with the least BIC."""
    g = order_grid(spark, sf)
    best = F.min_by(F.struct("p", "d", "bic"), F.struct("bic", "p", "d")).alias("b")
    return g.agg(best).select("b.p", "b.d", "b.bic")


# T16 / T20 / T23 ------------------------------------------------------------------
_PHRASES = ", ".join(f"('{n}', '{p.lower()}')" for n, p in GEO_PHRASES.items())
_UNIT = "list_transform({0}, lambda x: x / sqrt(list_sum(list_transform({0}, lambda y: y * y))))"


@register("phrase_similarity", f"""WITH {T2_SQL}, {WS_TERMS}, {EMB},
ph(name, phrase) AS (VALUES {_PHRASES}),
pt AS (SELECT name, unnest(string_split(phrase, ' ')) AS term FROM ph),
wv AS (SELECT t.term, {_UNIT.format('emb.v')} AS u FROM (SELECT term FROM ws UNION SELECT term FROM pt) t
       JOIN emb ON emb.vec_id = CAST('0x' || substr(sha256(t.term), 1, 8) AS BIGINT) % (SELECT count(*) FROM emb)),
dx AS (SELECT doc_id, unnest(u) AS x, generate_subscripts(u, 1) AS dim FROM ws JOIN wv USING (term)),
dv AS (SELECT doc_id, list(m ORDER BY dim) AS v FROM (SELECT doc_id, dim, avg(x) AS m FROM dx GROUP BY 1, 2) GROUP BY doc_id),
px AS (SELECT name, unnest(u) AS x, generate_subscripts(u, 1) AS dim FROM pt JOIN wv USING (term)),
pv AS (SELECT name, list(m ORDER BY dim) AS v FROM (SELECT name, dim, avg(x) AS m FROM px GROUP BY 1, 2) GROUP BY name),
s AS (SELECT CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS "Date", name, list_cosine_similarity(dv.v, pv.v) AS sim FROM dv, pv)
SELECT "Date", {', '.join(f'round(max(sim) FILTER (name = ' + repr(n) + f'), 5) AS {n}' for n in sorted(GEO_PHRASES))} FROM s GROUP BY 1""")
def phrase_similarity(spark, sf):
    """T16 on documents: cosine of each document's vector with the vectors of
    the six pattern phrases, daily maximum."""
    tokens = _t2_terms(spark, sf).select("doc_id", F.col("term").alias("token"))
    said = spark.createDataFrame(list(GEO_PHRASES.items()), "name string, phrase string").select("name", F.explode(F.split(F.lower("phrase"), " ")).alias("token"))

    def words(rows):
        return with_vectors(spark, sf, rows)

    patterns = VE.inline_patterns(VE.sentence_vectors(said, words, id_col="name"), "name", "sentence_vector")  # six vectors
    dated = S.news(spark, sf).select(F.col("ID").alias("doc_id"), "Date")
    docs = VE.sentence_vectors(tokens, words).join(dated, "doc_id")
    sims = VE.pattern_similarity(docs, "sentence_vector", patterns, prefix="")
    return sims.select("Date", *[F.round(n, 5).alias(n) for n in sorted(GEO_PHRASES)])


@register("first_token_plain", f"""WITH {EMB},
f AS (SELECT doc_id, lower(split_part(text, ' ', 1)) AS term FROM documents),
wv AS (SELECT t.term, emb.v FROM (SELECT DISTINCT term FROM f) t
       JOIN emb ON emb.vec_id = CAST('0x' || substr(sha256(t.term), 1, 8) AS BIGINT) % (SELECT count(*) FROM emb))
SELECT doc_id, generate_subscripts(v, 1) - 1 AS dim, round(unnest(v), 6) AS value FROM f JOIN wv USING (term)""")
def first_token_plain(spark, sf):
    """T20 without the stem fallback: the vector of a text's first token."""
    docs = S.table(spark, sf, "documents")
    words = word_vectors(spark, sf, docs.select(F.lower(F.split("text", " ").getItem(0)).alias("term")).dropna())
    r = VE.first_token_vector(docs, "text", words, "doc_id")
    return _long(r.select("doc_id", F.transform("vector", lambda x: x.cast("double")).alias("vector")), ["doc_id"], "vector")


@register("role_events", f"""WITH {TRIPLES},
x AS (SELECT "Date", role, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM
      (SELECT "Date", 0 AS role, sv AS v FROM tr UNION ALL SELECT "Date", 1, rv FROM tr UNION ALL SELECT "Date", 2, ov FROM tr)),
a AS (SELECT "Date", role, dim, max(x) AS mx, avg(x) AS mn, min(x) AS mi FROM x GROUP BY 1, 2, 3)
SELECT "Date", CAST(role * 192 + part * 64 + dim AS BIGINT) AS dim, round(CASE part WHEN 0 THEN mx WHEN 1 THEN mn ELSE mi END, 6) AS value
FROM a, range(0, 3) t(part)""")
def role_events(spark, sf):
    """T23 by role: maximum, mean and minimum of each role's vectors of a day,
    joined to 900-like columns (here 3 x 3 x 64)."""
    t = _triples(spark, sf)
    return _long(VE.role_events(t, ["sv", "rv", "ov"]), ["Date"], "vec")
