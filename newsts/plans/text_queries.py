"""Text queries (T1-T10, T15, T17, T18, F18, S8, S10-S12) over whole
documents and pages."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.scale import combined_sentiment as F18
from ..operators import lagged as W
from ..operators import text as TO
from ..sources import landed as L
from ..sources import tables as S
from .registry import register

# ---- SQL fragments ---------------------------------------------------------------
_STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in TX.STOP_WORDS) + "]"
_TOK = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'"
_PUNCT_SQL = "'" + TX.PUNCTUATION.replace("'", "''") + "'"
_FILTER_SQL = "'" + TX.FILTER_CHARS.replace("'", "''").replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '") + "'"

T2_SQL = f"""t2 AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), {_TOK}), lambda x: NOT list_contains({_STOP_SQL}, x)) AS k
  FROM documents),
clean AS (SELECT doc_id, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') || ' ' ELSE '' END AS clean FROM t2)"""

# whitespace terms of the T2 text, with positions
WS_TERMS = """ws AS (
  SELECT doc_id, unnest(parts) AS term, generate_subscripts(parts, 1) - 1 AS pos
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(clean, '\\s+'), lambda x: x <> '') AS parts FROM clean))"""

VOCAB = """vocab AS (
  SELECT term, cnt, CAST(row_number() OVER (ORDER BY term) AS BIGINT) AS term_id FROM (
    SELECT term, count(*) AS cnt FROM ws GROUP BY term HAVING count(*) > 3
    ORDER BY cnt DESC, term LIMIT 2000))"""

DOC_TERM = """dt AS (SELECT ws.doc_id, vocab.term_id, count(*) AS tf FROM ws JOIN vocab USING (term) GROUP BY 1, 2)"""
COOC = """cooc AS (SELECT a.term_id AS i, b.term_id AS j, sum(a.tf * b.tf) AS n_ij
                 FROM dt a JOIN dt b ON a.doc_id = b.doc_id GROUP BY 1, 2)"""

# fixed values: our seed lexicon (term, polarity, subjectivity, intensity); the
# reference used a library lexicon that is not available, so this is an input
SEED_LEXICON = [
    ("good", 0.7, 0.6, 1.0), ("great", 0.8, 0.75, 1.0), ("best", 1.0, 0.3, 1.0), ("strong", 0.43, 0.73, 1.0),
    ("gain", 0.3, 0.4, 1.0), ("bad", -0.7, 0.67, 1.0), ("poor", -0.4, 0.6, 1.0), ("worst", -1.0, 1.0, 1.0),
    ("weak", -0.37, 0.62, 1.0), ("loss", -0.3, 0.4, 1.0), ("worthless", -0.8, 0.9, 1.0), ("risk", -0.2, 0.5, 1.0),
    ("threat", -0.4, 0.5, 1.0), ("war", -0.5, 0.4, 1.0), ("crisis", -0.6, 0.6, 1.0),
    ("very", 0.2, 0.3, 1.3), ("sehr", 0.2, 0.3, 1.3), ("très", 0.2, 0.3, 1.3), ("muy", 0.2, 0.3, 1.3),
    ("thatin", 0.25, 0.4, 1.0), ("ononst", -0.25, 0.5, 1.0), ("inoran", 0.5, 0.7, 1.0), ("hehely", -0.5, 0.6, 1.0),
    ("orantion", 0.1, 0.2, 1.0), ("rewh", 0.35, 0.45, 1.0), ("orre", -0.15, 0.35, 1.0), ("thnt", 0.2, 0.5, 1.0),
    ("heit", 0.3, 0.4, 1.0), ("keit", -0.3, 0.4, 1.0), ("lich", 0.2, 0.6, 1.0), ("ench", -0.2, 0.5, 1.0),
    ("gut", 0.7, 0.6, 1.0), ("schlecht", -0.7, 0.67, 1.0), ("enau", 0.15, 0.3, 1.0), ("ersch", -0.35, 0.55, 1.0),
    ("eau", 0.3, 0.5, 1.0), ("elle", 0.2, 0.4, 1.0), ("eux", -0.2, 0.4, 1.0), ("ment", 0.1, 0.3, 1.0),
    ("bon", 0.7, 0.6, 1.0), ("mauvais", -0.7, 0.67, 1.0), ("éque", -0.4, 0.5, 1.0), ("éeau", 0.4, 0.6, 1.0),
    ("ción", 0.3, 0.5, 1.0), ("mente", -0.3, 0.5, 1.0), ("ado", 0.2, 0.4, 1.0), ("bueno", 0.7, 0.6, 1.0),
    ("malo", -0.7, 0.67, 1.0), ("ciónue", -0.2, 0.3, 1.0), ("ciónas", 0.25, 0.35, 1.0),
]
NEGATIONS = ["not", "never", "no", "nicht", "pas", "kein"]
_LEX_SQL = "lex(term, polarity, subjectivity, intensity) AS (VALUES " + ", ".join(
    f"('{t}', {p}, {s}, {i})" for t, p, s, i in SEED_LEXICON) + ")"
_NEG_SQL = "[" + ", ".join(f"'{w}'" for w in NEGATIONS) + "]"


def lexicon(spark):
    return spark.createDataFrame(SEED_LEXICON, "term string, polarity double, subjectivity double, intensity double")


def _docs(spark, sf):
    return S.table(spark, sf, "documents")


def _t2_texts(spark, sf):
    # a per-row expression: re-evaluating it in the branches of one plan
    # measured cheaper than caching the cleaned corpus (sf0.1, local[8])
    return TO.basic_tokens(_docs(spark, sf))


def _t2_terms(spark, sf):
    return TO.whitespace_terms(_t2_texts(spark, sf))


def _vocab(spark, sf):
    return TO.vocab_top(_t2_terms(spark, sf), 3, 2000)


# T2 -----------------------------------------------------------------------------
@register("clean_tokens", f"WITH {T2_SQL} SELECT doc_id, clean FROM clean")
def clean_tokens(spark, sf):
    return TO.basic_tokens(_docs(spark, sf))


# T1 without stemming ------------------------------------------------------------------
@register("clean_fast", f"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), {_TOK}), lambda x: NOT list_contains({_STOP_SQL}, x)) AS k FROM documents),
u AS (SELECT doc_id, list_filter(list_transform(list_transform(k, lambda x: translate(x, {_PUNCT_SQL}, '')),
        lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN '<NUM>' ELSE x END), lambda x: x <> '') AS k FROM t)
SELECT doc_id, array_to_string(k, ' ') AS clean FROM u""")
def clean_fast(spark, sf):
    return TO.clean_fast(_docs(spark, sf))


@register("clean_stem")
def clean_stem(spark, sf):
    """T1 with vocabulary stemming and the corpus proper-noun rule."""
    return TO.clean(_docs(spark, sf))


# T5 / O7 / A10 ----------------------------------------------------------------------
@register("vocab_topk", f"WITH {T2_SQL}, {WS_TERMS}, {VOCAB} SELECT term, cnt, term_id FROM vocab")
def vocab_topk(spark, sf):
    return _vocab(spark, sf)


@register("term_counts", f"""WITH {T2_SQL}, {WS_TERMS}
SELECT term, count(*) AS cnt FROM ws GROUP BY term""")
def term_counts(spark, sf):
    from ..operators.aggregate import term_counts as tc
    return tc(_t2_terms(spark, sf), "term")


@register("doc_ids", f"""WITH {T2_SQL}, {WS_TERMS}, {VOCAB}
SELECT doc_id, string_agg(CAST(term_id AS VARCHAR), ' ' ORDER BY pos) AS ids
FROM ws JOIN vocab USING (term) GROUP BY doc_id""")
def doc_ids(spark, sf):
    seq = TO.id_sequences(_t2_terms(spark, sf), _vocab(spark, sf))
    return seq.select("doc_id", F.array_join("ids", " ").alias("ids"))


@register("doc_term", f"WITH {T2_SQL}, {WS_TERMS}, {VOCAB}, {DOC_TERM} SELECT doc_id, term_id, tf FROM dt")
def doc_term(spark, sf):
    return TO.doc_term(_t2_terms(spark, sf), _vocab(spark, sf))


# T3 / T4 ----------------------------------------------------------------------------
_FREQ_TERMS = f"""ft AS (
  SELECT doc_id, unnest(parts) AS term, generate_subscripts(parts, 1) - 1 AS pos FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(lower(clean), {_FILTER_SQL}, repeat(' ', {len(TX.FILTER_CHARS)})), '\\s+'),
                               lambda x: x <> '') AS parts FROM clean)),
fv AS (
  SELECT term, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, first_doc, first_pos) AS BIGINT) AS rank FROM (
    SELECT term, count(*) AS cnt, arg_min(doc_id, doc_id * 100000000 + pos) AS first_doc,
           arg_min(pos, doc_id * 100000000 + pos) AS first_pos
    FROM ft GROUP BY term ORDER BY cnt DESC, first_doc, first_pos LIMIT 1999))"""


@register("frequency_vocab", f"WITH {T2_SQL}, {_FREQ_TERMS} SELECT term, cnt, rank FROM fv")
def frequency_vocab(spark, sf):
    return TO.frequency_vocab(TO.basic_tokens(_docs(spark, sf)), n=2000)


@register("pad_sequences", f"""WITH {T2_SQL}, {_FREQ_TERMS},
s AS (SELECT doc_id, pos, rank, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS back FROM ft JOIN fv USING (term)),
k AS (SELECT doc_id, count(*) AS n, string_agg(CAST(rank AS VARCHAR), ' ' ORDER BY pos) AS ids FROM s WHERE back <= 50 GROUP BY doc_id)
SELECT doc_id, CASE WHEN n < 50 THEN repeat('0 ', CAST(50 - n AS INTEGER)) ELSE '' END || ids AS padded, CAST(n AS INTEGER) AS kept FROM k""")
def pad_sequences(spark, sf):
    texts = _t2_texts(spark, sf)
    seq = TO.id_sequences(TO.frequency_terms(texts), TO.frequency_vocab(texts, n=2000), id_name="rank")
    padded = TO.pad("ids", 50)
    return seq.select("doc_id", F.array_join(padded, " ").alias("padded"),
                      F.size(TO.strip_padding(padded)).cast("int").alias("kept"))


# T7 / T8 / T9 -----------------------------------------------------------------------
def _cooc(spark, sf):
    vocab = _vocab(spark, sf)
    # token rows joined to the (broadcast) vocabulary stay in the task of
    # their document, so the partial matrices need no shuffle before them
    hits = _t2_terms(spark, sf).join(F.broadcast(vocab.select("term", "term_id")), on="term")
    dt = hits.select("doc_id", "term_id", F.lit(1.0).alias("tf"))
    return TO.cooccurrence(dt, 2000, docs_whole_in_tasks=True).persist(StorageLevel.MEMORY_AND_DISK), vocab


@register("cooccurrence", f"""WITH {T2_SQL}, {WS_TERMS}, {VOCAB}, {DOC_TERM}, {COOC}
SELECT i, j, CAST(n_ij AS DOUBLE) AS n_ij FROM cooc""")
def cooccurrence(spark, sf):
    c, _ = _cooc(spark, sf)
    return c


@register("ppmi", f"""WITH {T2_SQL}, {WS_TERMS}, {VOCAB}, {DOC_TERM}, {COOC},
r AS (SELECT i, sum(n_ij) AS n_i FROM cooc GROUP BY i), c AS (SELECT j, sum(n_ij) AS n_j FROM cooc GROUP BY j),
tot AS (SELECT sum(n_ij) AS n FROM cooc)
SELECT i, j, round(greatest(0.0, ln(tot.n * n_ij / (n_i * n_j))), 6) AS ppmi FROM cooc JOIN r USING (i) JOIN c USING (j), tot""")
def ppmi(spark, sf):
    c, _ = _cooc(spark, sf)
    return TO.ppmi(c).withColumn("ppmi", F.round("ppmi", 6))


@register("coherence", f"""WITH {T2_SQL}, {WS_TERMS}, {VOCAB}, {DOC_TERM}, {COOC},
top AS (SELECT term_id FROM vocab ORDER BY cnt DESC, term LIMIT 10),
r AS (SELECT i, sum(n_ij) AS c FROM cooc GROUP BY i), tot AS (SELECT sum(n_ij) AS n FROM cooc)
SELECT round(2.0 * coalesce(sum(ln(x.n_ij * tot.n / ra.c / rb.c)), 0) / 10 / 9, 6) AS coherence
FROM cooc x JOIN r ra ON ra.i = x.i JOIN r rb ON rb.i = x.j, tot
WHERE x.j < x.i AND x.i IN (SELECT term_id FROM top) AND x.j IN (SELECT term_id FROM top)""")
def coherence(spark, sf):
    c, vocab = _cooc(spark, sf)
    top = vocab.orderBy(F.col("cnt").desc(), F.col("term")).limit(10)
    return TO.coherence(c, top).withColumn("coherence", F.round("coherence", 6))


# T10 / F18 ----------------------------------------------------------------------------
_SENT_SQL = f"""{_LEX_SQL},
tok AS (SELECT doc_id, unnest(k) AS token, generate_subscripts(k, 1) - 1 AS pos
        FROM (SELECT doc_id, regexp_extract_all(lower(text), {_TOK}) AS k FROM documents)),
tp AS (SELECT doc_id, pos, token, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM tok),
hit AS (SELECT tp.doc_id, lex.polarity, lex.subjectivity, m.intensity AS mult, tp.prev
        FROM tp JOIN lex ON tp.token = lex.term LEFT JOIN (SELECT term, intensity FROM lex WHERE intensity <> 1.0) m ON m.term = tp.prev),
per AS (SELECT doc_id,
          avg(greatest(-1.0, least(1.0, polarity * coalesce(mult, 1.0) * CASE WHEN list_contains({_NEG_SQL}, prev) THEN -0.5 ELSE 1.0 END))) AS polarity,
          avg(least(1.0, subjectivity * coalesce(mult, 1.0))) AS subjectivity FROM hit GROUP BY doc_id),
sent AS (SELECT d.doc_id, coalesce(per.polarity, 0.0) AS polarity, coalesce(per.subjectivity, 0.0) AS subjectivity
         FROM (SELECT DISTINCT doc_id FROM tok) d LEFT JOIN per USING (doc_id))"""


def _sentiment(spark, sf):
    return TO.sentiment(_docs(spark, sf), lexicon(spark), negations=NEGATIONS)


@register("lexicon_sentiment", f"""WITH {_SENT_SQL}
SELECT doc_id, round(polarity, 6) AS polarity, round(subjectivity, 6) AS subjectivity FROM sent""")
def lexicon_sentiment(spark, sf):
    s = _sentiment(spark, sf)
    return s.select("doc_id", F.round("polarity", 6).alias("polarity"), F.round("subjectivity", 6).alias("subjectivity"))


@register("combined_sentiment", f"""WITH {_SENT_SQL},
daily AS (SELECT CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS "Date",
                 avg(polarity) AS "Polarity", avg(subjectivity) AS "Subjectivity" FROM sent GROUP BY 1),
c AS (SELECT *, "Polarity" * (1 + "Subjectivity") AS "Combined_Sentiment" FROM daily),
w AS (SELECT *, row_number() OVER o AS rn,
        "Combined_Sentiment" + 0.8 * lag("Combined_Sentiment", 1) OVER o + 0.6 * lag("Combined_Sentiment", 2) OVER o
        + 0.4 * lag("Combined_Sentiment", 3) OVER o + 0.2 * lag("Combined_Sentiment", 4) OVER o AS acc
      FROM c WINDOW o AS (ORDER BY "Date"))
SELECT "Date", round("Polarity", 6) AS "Polarity", round("Subjectivity", 6) AS "Subjectivity",
       round("Combined_Sentiment", 6) AS "Combined_Sentiment",
       round(CASE WHEN rn <= 5 THEN "Combined_Sentiment" ELSE acc END, 6) AS "Decay_Combined_Sentiment" FROM w""")
def combined_sentiment(spark, sf):
    s = _sentiment(spark, sf)
    dated = S.news(spark, sf).select(F.col("ID").alias("doc_id"), "Date")
    daily = s.join(dated, on="doc_id").groupBy("Date").agg(F.avg("polarity").alias("Polarity"),
                                                           F.avg("subjectivity").alias("Subjectivity"))
    daily = daily.withColumn("Combined_Sentiment", F18("Polarity", "Subjectivity", "service"))
    dec = W.linear_decay(daily, ["Combined_Sentiment"])
    return dec.select("Date", *[F.round(c, 6).alias(c) for c in
                                ("Polarity", "Subjectivity", "Combined_Sentiment", "Decay_Combined_Sentiment")])


# T15 -------------------------------------------------------------------------------------
@register("geo_regex")
def geo_regex(spark, sf):
    """All six families (lookaheads need Java regex): daily sum."""
    n = S.news(spark, sf)
    g = TO.geo_regex(n, "News")
    return g.groupBy("Date").agg(F.sum("GeoIdx").alias("GeoIdx"))


@register("geo_regex_sql", f"""
SELECT CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS "Date",
  CAST(sum(len(regexp_extract_all(text, '{TO.GEO_PATTERNS[3]}')) + len(regexp_extract_all(text, '{TO.GEO_PATTERNS[5]}'))) AS BIGINT) AS "GeoIdx"
FROM documents GROUP BY 1""")
def geo_regex_sql(spark, sf):
    """The lookahead-free families 3 and 5, checkable in SQL."""
    n = S.news(spark, sf)
    g = TO.geo_regex(n, "News", families=(3, 5))
    return g.groupBy("Date").agg(F.sum("GeoIdx").alias("GeoIdx"))


# T17 / T18 -----------------------------------------------------------------------------------
_VERBS_SQL = "[" + ", ".join(f"'{v}'" for v in TO.RELATION_WORDS) + "]"


@register("event_triples", f"""
WITH tok AS (SELECT doc_id, unnest(k) AS token, generate_subscripts(k, 1) - 1 AS pos
             FROM (SELECT doc_id, regexp_extract_all(lower(text), {_TOK}) AS k FROM documents)),
f AS (SELECT *, list_contains({_VERBS_SQL}, token) AS is_rel,
        (NOT list_contains({_VERBS_SQL}, token)) AND regexp_matches(token, '^[\\p{{L}}\\p{{N}}_]+$')
        AND NOT list_contains({_STOP_SQL}, token) AS is_content FROM tok),
n AS (SELECT *, last_value(CASE WHEN is_content THEN token END IGNORE NULLS) OVER
          (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS subject,
        first_value(CASE WHEN is_content THEN token END IGNORE NULLS) OVER
          (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS object FROM f)
SELECT doc_id, pos, subject, token AS relation, object FROM n
WHERE is_rel AND subject IS NOT NULL AND object IS NOT NULL""")
def event_triples(spark, sf):
    t = TO.triples(_docs(spark, sf))
    return t.withColumn("pos", F.col("pos").cast("bigint"))


@register("first_token", "SELECT doc_id, split_part(text, ' ', 1) AS first FROM documents")
def first_token(spark, sf):
    return _docs(spark, sf).select("doc_id", TX.first_token("text").alias("first"))


@register("normalize_text", f"""
SELECT doc_id, array_to_string(regexp_extract_all(lower(text), {_TOK}), ' ') AS norm FROM documents""")
def normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", TX.normalize_text("text").alias("norm"))


# S8 / S10 ------------------------------------------------------------------------------------
@register("json_fields", """
SELECT event_id, CAST(ts AS DATE) AS "Date", CAST(json_extract(props, '$.k') AS INTEGER) AS score, event_type AS title
FROM events""")
def json_fields(spark, sf):
    return L.listing_rows(S.events(spark, sf), "props", "event_type")


@register("listing_sorted", """
SELECT CAST(ts AS DATE) AS "Date", event_type AS title, CAST(json_extract(props, '$.k') AS INTEGER) AS score, event_id
FROM events""")
def listing_sorted(spark, sf):
    rows = L.listing_rows(S.events(spark, sf), "props", "event_type")
    # the order of a listing, within each part of it: nothing is dealt anew
    return rows.sortWithinPartitions(F.col("score").desc(), F.col("event_id")).select("Date", "title", "score", "event_id")


# S11 / S12 -----------------------------------------------------------------------------------
@register("page_items", """
WITH x AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS href,
                  regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS label FROM pages)
SELECT page_id, unnest(href) AS href, unnest(label) AS label, generate_subscripts(href, 1) - 1 AS pos FROM x""")
def page_items(spark, sf):
    return L.page_items(S.table(spark, sf, "pages"), {"href": r'<a href="([^"]*)">([^<]*)</a>',
                                                       "label": r'<a href="([^"]*)">([^<]*)</a>'},
                        groups={"href": 1, "label": 2})


@register("page_title", """
SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h1,
       regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def page_title(spark, sf):
    return L.page_values(S.table(spark, sf, "pages"),
                         {"title": r"<title>(.*?)</title>", "h1": r"<h1>(.*?)</h1>", "lang": r'<html lang="([a-z]+)"'})


# S8 / S9 / S10 ------------------------------------------------------------------------------
def _listing_pages(spark, sf):
    """One landed listing page per event row (derived with to_json)."""
    e = S.events(spark, sf)
    child = F.struct(F.struct(F.get_json_object("props", "$.k").cast("int").alias("score"),
                              F.col("event_type").alias("title")).alias("data"))
    page = F.to_json(F.struct(F.struct(F.array(child).alias("children")).alias("data")))
    return e.select("event_id", "Date", page.alias("json"))


@register("listing_json", """
SELECT CAST(ts AS DATE) AS "Date", CAST(json_extract(props, '$.k') AS INTEGER) AS score, event_type AS title FROM events""")
def listing_json(spark, sf):
    """S8 (+O1): listing pages → (score, title) rows, highest score first
    within a page, stamped with the page's day."""
    return L.listing_json(_listing_pages(spark, sf), "json", stamp=F.col("Date"))


@register("listing_days", """
SELECT CAST(ts AS DATE) AS "Date", CAST(json_extract(props, '$.k') AS INTEGER) AS score, event_type AS title FROM events""")
def listing_days(spark, sf):
    """Pages fetched per back-day t; Date = as_of − t."""
    pages = _listing_pages(spark, sf)
    as_of = S.events(spark, sf).select(F.max("ts")).scalar()
    pages = pages.withColumn("t", F.datediff(F.to_date(as_of), F.col("Date")))
    return L.listing_days(pages, as_of, "t", "json")


@register("series_json", """
WITH p AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS "Date", avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
w AS (SELECT "Date", max(v) FILTER (WHERE k = '1-URGENT') AS "CLC1", max(v) FILTER (WHERE k = '2-HIGH') AS "CLC2",
             max(v) FILTER (WHERE k = '3-MEDIUM') AS "CLC3", max(v) FILTER (WHERE k = '4-NOT SPECIFIED') AS "CLC4" FROM p GROUP BY 1)
SELECT "Date", round("CLC1", 6) AS "CLC1", round("CLC2", 6) AS "CLC2", round("CLC3", 6) AS "CLC3", round("CLC4", 6) AS "CLC4" FROM w
WHERE "CLC1" IS NOT NULL AND "CLC2" IS NOT NULL AND "CLC3" IS NOT NULL AND "CLC4" IS NOT NULL""")
def series_json(spark, sf):
    """Per-contract JSON series ``[[yyyymmdd, value], …]`` → Date →
    outer pivot of the contracts → rows with every contract present."""
    names = {"1-URGENT": "CLC1", "2-HIGH": "CLC2", "3-MEDIUM": "CLC3", "4-NOT SPECIFIED": "CLC4"}
    d = S.orders_daily(spark, sf, keys=["o_orderpriority"]).filter(F.col("o_orderpriority").isin(list(names)))
    mapping = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    point = F.array(F.date_format("Date", "yyyyMMdd"), F.col("Price").cast("string"))
    js = d.select(mapping[F.col("o_orderpriority")].alias("name"),
                  F.to_json(F.struct(F.array(F.struct(F.array(point).alias("data"))).alias("series"))).alias("json"))
    long = L.series_json(js, "name", "json")
    wide = long.groupBy("Date").pivot("name", list(names.values())).agg(F.first("value")).dropna()
    return wide.select("Date", *[F.round(c, 6).alias(c) for c in names.values()])
