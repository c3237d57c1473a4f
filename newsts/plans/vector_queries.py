"""Vector queries (A4-A7, F16, F17, T16, T19-T23, W15) on ``embeddings``
and on word vectors derived from ``documents`` × ``embeddings``.

Vector results are checked in long form (key, dim, value) so that the
dimension order of the re-assembled arrays is part of the check."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as FV
from ..operators import text as TO
from ..operators import vectors as V
from ..sources import tables as S
from .registry import register
from .text_queries import T2_SQL, WS_TERMS, _t2_terms

EMB = """emb AS (SELECT vec_id, label, CAST(DATE '2024-01-01' + CAST(vec_id % 30 AS INTEGER) AS DATE) AS "Date",
                        CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
EMB_LONG = """el AS (SELECT vec_id, label, "Date", unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM emb)"""


def _long(df, keys, col):
    return df.select(*keys, F.posexplode(col).alias("dim", "value")) \
        .withColumn("value", F.round("value", 6)).withColumn("dim", F.col("dim").cast("bigint"))


@register("vector_mean", f"""WITH {EMB}, {EMB_LONG}
SELECT "Date", dim, round(avg(x), 6) AS value FROM el GROUP BY 1, 2""")
def vector_mean(spark, sf):
    d = V.daily_vectors(S.vectors(spark, sf), "embedding", ("mean",))
    return _long(d, ["Date"], "vec")


@register("vector_maxmeanmin", f"""WITH {EMB}, {EMB_LONG}, a AS (SELECT "Date", dim, max(x) AS mx, avg(x) AS mn, min(x) AS mi FROM el GROUP BY 1, 2)
SELECT "Date", dim, round(mx, 6) AS value FROM a
UNION ALL SELECT "Date", dim + 64, round(mn, 6) FROM a
UNION ALL SELECT "Date", dim + 128, round(mi, 6) FROM a""")
def vector_maxmeanmin(spark, sf):
    d = V.daily_vectors(S.vectors(spark, sf), "embedding", ("max", "mean", "min"))
    return _long(d, ["Date"], "vec")


@register("vector_maxmin", f"""WITH {EMB}, {EMB_LONG}, a AS (SELECT "Date", dim, max(x) AS mx, min(x) AS mi FROM el GROUP BY 1, 2)
SELECT "Date", dim, round(mx, 6) AS value FROM a UNION ALL SELECT "Date", dim + 64, round(mi, 6) FROM a""")
def vector_maxmin(spark, sf):
    d = V.daily_vectors(S.vectors(spark, sf), "embedding", ("max", "min"))
    return _long(d, ["Date"], "vec")


@register("vector_mean_of_mean", f"""WITH {EMB}
SELECT "Date", round(avg(list_sum(v) / len(v)), 6) AS mean_of_mean FROM emb GROUP BY 1""")
def vector_mean_of_mean(spark, sf):
    d = V.daily_scalar_mean(S.vectors(spark, sf), "embedding")
    return d.withColumn("mean_of_mean", F.round("mean_of_mean", 6))


# triples: role = vec_id % 3 (subject, relation, object) of triple k = vec_id div 3
TRIPLES = f"""{EMB}, tr AS (
  SELECT s.vec_id // 3 AS k, s."Date" AS "Date", s.v AS sv, r.v AS rv, o.v AS ov
  FROM emb s JOIN emb r ON r.vec_id = s.vec_id + 1 JOIN emb o ON o.vec_id = s.vec_id + 2 WHERE s.vec_id % 3 = 0)"""


def _triples(spark, sf):
    e = S.vectors(spark, sf)
    k = (F.col("vec_id") / 3).cast("long")
    s = e.filter(F.col("vec_id") % 3 == 0).select(k.alias("k"), "Date", F.col("embedding").alias("sv"))
    r = e.filter(F.col("vec_id") % 3 == 1).select(k.alias("k"), F.col("embedding").alias("rv"))
    o = e.filter(F.col("vec_id") % 3 == 2).select(k.alias("k"), F.col("embedding").alias("ov"))
    return s.join(r, on="k").join(o, on="k")


@register("vector_add", f"""WITH {TRIPLES}
SELECT k, unnest(list_transform(generate_series(1, 64), lambda i: round(sv[i] + rv[i] + ov[i], 6))) AS value,
       generate_subscripts(sv, 1) - 1 AS dim FROM tr""")
def vector_add(spark, sf):
    t = _triples(spark, sf)
    return _long(t.select("k", FV.vec_add(F.transform("sv", lambda x: x.cast("double")), "rv", "ov").alias("v")), ["k"], "v")


@register("vector_concat", f"""WITH {TRIPLES}, c AS (SELECT k, list_transform(list_concat(list_concat(sv, rv), ov), lambda x: round(x, 6)) AS v FROM tr)
SELECT k, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS dim FROM c""")
def vector_concat(spark, sf):
    t = _triples(spark, sf)
    c = t.select("k", FV.vec_concat(*[F.transform(c, lambda x: x.cast("double")) for c in ("sv", "rv", "ov")]).alias("v"))
    return _long(c, ["k"], "v")


@register("daily_events", f"""WITH {TRIPLES},
x AS (SELECT "Date", unnest(list_transform(generate_series(1, 64), lambda i: sv[i] + rv[i] + ov[i])) AS x,
             generate_subscripts(sv, 1) - 1 AS dim FROM tr)
SELECT "Date", dim, round(avg(x), 6) AS value FROM x GROUP BY 1, 2""")
def daily_events(spark, sf):
    t = _triples(spark, sf)
    s = t.select("Date", FV.vec_add(F.transform("sv", lambda x: x.cast("double")), "rv", "ov").alias("v"))
    return _long(V.daily_vectors(s, "v", ("mean",)), ["Date"], "vec")


@register("cosine_next", f"""WITH {EMB}
SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cos FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1""")
def cosine_next(spark, sf):
    e = S.vectors(spark, sf)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("nxt"))
    j = e.join(b, on="vec_id")
    return j.select("vec_id", F.round(FV.cosine("embedding", "nxt"), 6).alias("cos"))


_CENTROIDS = f"""{EMB}, {EMB_LONG}, cd AS (SELECT label, dim, avg(x) AS c FROM el GROUP BY 1, 2),
cen AS (SELECT label, list(c ORDER BY dim) AS cv FROM cd GROUP BY label)"""


def _patterns(spark, sf):
    e = S.vectors(spark, sf)
    return V.inline_patterns(V.centroids(e, "embedding", "label"), "label", "centroid")


@register("pattern_similarity", f"""WITH {_CENTROIDS},
s AS (SELECT emb."Date", cen.label, list_cosine_similarity(emb.v, cen.cv) AS sim FROM emb CROSS JOIN cen)
SELECT "Date", {', '.join(f'round(max(sim) FILTER (WHERE label = {k}), 6) AS sim_{k}' for k in range(10))}
FROM s GROUP BY 1""")
def pattern_similarity(spark, sf):
    e = S.vectors(spark, sf)
    r = V.pattern_similarity(e, "embedding", _patterns(spark, sf))
    return r.select("Date", *[F.round(f"sim_{k}", 6).alias(f"sim_{k}") for k in range(10)])


@register("nearest_vectors", f"""WITH {_CENTROIDS},
s AS (SELECT CAST(cen.label AS VARCHAR) AS query, emb.vec_id, list_cosine_similarity(emb.v, cen.cv) AS sim FROM emb CROSS JOIN cen),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s)
SELECT query, vec_id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM r WHERE rank <= 5""")
def nearest_vectors(spark, sf):
    e = S.vectors(spark, sf)
    pats = [(str(k), v) for k, v in _patterns(spark, sf)]
    r = V.nearest(e, "embedding", "vec_id", pats, 5)
    return r.select("query", "vec_id", "rank", F.round("sim", 6).alias("sim"))


@register("seq_tensor", f"""WITH {EMB}, w AS (
  SELECT label, vec_id, lag(v, 3) OVER p || lag(v, 2) OVER p || lag(v, 1) OVER p AS s, lag(v, 3) OVER p AS f FROM emb
  WINDOW p AS (PARTITION BY label ORDER BY vec_id))
SELECT label, vec_id, unnest(s) AS x, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos FROM w WHERE f IS NOT NULL""")
def seq_tensor(spark, sf):
    """The three vectors before each row, in order, one row per number."""
    e = S.vectors(spark, sf)
    t = V.sequence_tensor(e, "embedding", 3, ["label"], "vec_id")
    return t.select("label", "vec_id", F.posexplode(F.flatten("seq")).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


# word vectors: every T2 term takes the embedding whose vec_id its digest names
WORDVEC_SQL = f"""{T2_SQL}, {WS_TERMS}, {EMB},
wv AS (SELECT t.term, emb.v FROM (SELECT DISTINCT term FROM ws) t
       JOIN emb ON emb.vec_id = CAST('0x' || substr(sha256(t.term), 1, 8) AS BIGINT) % (SELECT count(*) FROM emb))"""


def with_vectors(spark, sf, rows):
    """Rows with a ``term``, joined with its ``vector`` by key: the first 32
    bits of the term's SHA-256 modulo the number of embeddings name its
    ``vec_id``."""
    e = S.table(spark, sf, "embeddings")
    n = e.count()
    keyed = rows.withColumn("vec_id", F.conv(F.substring(F.sha2("term", 256), 1, 8), 16, 10).cast("long") % n)
    return keyed.join(e.select("vec_id", F.col("embedding").alias("vector")), on="vec_id").drop("vec_id")


def word_vectors(spark, sf, terms=None):
    """A vector for every term (by default those of the corpus)."""
    terms = (_t2_terms(spark, sf) if terms is None else terms).select("term").distinct()
    return with_vectors(spark, sf, terms).select("term", "vector")


@register("sentence_vector", f"""WITH {WORDVEC_SQL},
tf AS (SELECT doc_id, term, count(*) AS tf FROM ws GROUP BY 1, 2),
u AS (SELECT term, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM wv),
x AS (SELECT doc_id, tf, unnest(u) AS x, generate_subscripts(u, 1) - 1 AS dim FROM tf JOIN u USING (term))
SELECT doc_id, dim, round(sum(x * tf) / sum(tf), 6) AS value FROM x GROUP BY 1, 2""")
def sentence_vector(spark, sf):
    toks = _t2_terms(spark, sf).withColumnRenamed("term", "token")
    sv = V.sentence_vectors(toks, lambda rows: with_vectors(spark, sf, rows))
    return _long(sv, ["doc_id"], "sentence_vector")


@register("first_token_vector")
def first_token_vector(spark, sf):
    """T20 with the stem fallback (stems from the vocabulary stemmer)."""
    docs = S.table(spark, sf, "documents")
    forms = docs.select(F.lower(F.split("text", " ").getItem(0)).alias("form"))
    stems = TO.stem_vocabulary(forms)
    r = V.first_token_vector(docs, "text", word_vectors(spark, sf), "doc_id", stems)
    return _long(r.select("doc_id", F.transform("vector", lambda x: x.cast("double")).alias("vector")), ["doc_id"], "vector")


@register("word2vec")
def word2vec(spark, sf):
    """Skip-gram vectors (16 dimensions, ten steps for every pair, both
    parameters) trained on the (subject, relation, object) lists of every
    extracted triple (min count 1), looked up for each triple's three words."""
    from ..operators.embed import word2vec as train
    from ..session import cut_lineage
    tr = cut_lineage(TO.triples(S.table(spark, sf, "documents")))
    vectors = train(tr.select(F.array("subject", "relation", "object").alias("tokens")), size=16)
    out = tr
    for role in ("subject", "relation", "object"):
        out = out.join(vectors.select(F.col("word").alias(role), F.col("v").alias(f"{role}_vector")), role)
    return out.select("doc_id", "pos", "subject", "relation", "object", "subject_vector", "relation_vector", "object_vector")
