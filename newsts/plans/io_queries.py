"""Source / sink round trips (S1-S5, S13-S15, K1-K9).  Each query derives
its files from the driver tables with Spark, writes them under the shared
checkpoint folder, reads them back with the source operator and returns
the parsed result, so the work grows with the tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..sinks import writers as K
from ..sources import files as SF
from ..sources import tables as S
from ..streaming.stream import work_dir
from .core_queries import ODAILY
from .registry import register

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


def _daily_csv(spark, sf, name="daily"):
    d = S.orders_daily(spark, sf).select(F.date_format("Date", "yyyy-MM-dd").alias("Date"), "Price")
    path = os.path.join(work_dir(spark, name), "csv")
    K.write_table(d, path, fmt="csv")
    return path


@register("csv_roundtrip", f"WITH {ODAILY} SELECT \"Date\", round(\"Price\", 6) AS \"Price\" FROM od")
def csv_roundtrip(spark, sf):
    """K1 → S1: write with header, read with a declared schema, parse Date."""
    df = SF.read_table(spark, _daily_csv(spark, sf), "Date string, Price double")
    return df.select("Date", F.round("Price", 6).alias("Price"))


@register("read_series", f"""WITH {ODAILY}, r AS (SELECT *, row_number() OVER (ORDER BY "Date") AS rn, count(*) OVER () AS n FROM od)
SELECT "Date" AS date, round("Price", 6) AS wti FROM r WHERE rn <= floor(n * 0.7)""")
def read_series(spark, sf):
    """Named series, first floor(n·ratio) rows."""
    df = SF.read_series(spark, _daily_csv(spark, sf), "wti", ratio=0.7)
    return df.select("date", F.round("wti", 6).alias("wti"))


@register("csv_preamble", f"WITH {ODAILY} SELECT \"Date\", round(\"Price\", 6) AS \"Price\" FROM od")
def csv_preamble(spark, sf):
    """S3: information lines above the header are skipped."""
    d = S.orders_daily(spark, sf).select(F.concat_ws(",", F.date_format("Date", "yyyy-MM-dd"), F.col("Price").cast("string")).alias("value"))
    pre = spark.createDataFrame([(0, "Source: order book averages"), (1, "Unit: currency per order"), (2, "Date,Price")], "k int, value string")
    path = os.path.join(work_dir(spark, "preamble"), "txt")
    lines = pre.unionByName(d.withColumn("k", F.lit(3))).repartition(1).sortWithinPartitions("k", "value")
    lines.select("value").write.mode("overwrite").text(path)
    df = SF.read_csv_after(spark, path, r"^Date,Price$", "Date date, Price double")
    return df.select("Date", F.round("Price", 6).alias("Price"))


@register("read_contracts", f"""
WITH p AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS "Date", avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT a."Date", round(a.v, 6) AS "CLC1", round(b.v, 6) AS "CLC2", round(c.v, 6) AS "CLC3", round(d.v, 6) AS "CLC4"
FROM p a JOIN p b ON a."Date" = b."Date" AND b.k = '2-HIGH' JOIN p c ON a."Date" = c."Date" AND c.k = '3-MEDIUM'
JOIN p d ON a."Date" = d."Date" AND d.k = '4-NOT SPECIFIED' WHERE a.k = '1-URGENT'""")
def read_contracts(spark, sf):
    """S5 (+J6): four contract files aligned on their common dates."""
    d = S.orders_daily(spark, sf, keys=["o_orderpriority"])
    base = work_dir(spark, "contracts")
    paths = {}
    for i, pr in enumerate(PRIORITIES, 1):
        p = os.path.join(base, f"CLC{i}")
        K.write_table(d.filter(F.col("o_orderpriority") == pr).select(F.date_format("Date", "yyyy-MM-dd").alias("Date"), "Price"),
                      p, fmt="csv")
        paths[f"CLC{i}"] = p
    df = SF.read_contracts(spark, paths)
    return df.select("Date", *[F.round(f"CLC{i}", 6).alias(f"CLC{i}") for i in range(1, 5)])


@register("vector_table", """SELECT vec_id, label, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings""")
def vector_table(spark, sf):
    """K3 → S4: vector cells written and read back as parquet."""
    path = K.write_vectors(S.table(spark, sf, "embeddings"), os.path.join(work_dir(spark, "vectors"), "pq"))
    v = SF.read_vectors(spark, path)
    return v.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@register("word_vector_text", """SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, len(embedding) AS dim,
  round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings""")
def word_vector_text(spark, sf):
    """K9 → S13: ``word v1 … vd`` text lines (with a count/dim header line)."""
    e = S.table(spark, sf, "embeddings")
    lines = e.select(F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")),
                                 F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value"))
    head = e.select(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.lit("64")).alias("value"))
    path = os.path.join(work_dir(spark, "wordvec"), "txt")
    head.unionByName(lines).write.mode("overwrite").text(path)
    wv = SF.read_word_vectors(spark, path, 64)
    return wv.select("word", F.size("vector").alias("dim"),
                     F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@register("doc_terms_text", """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS k FROM documents)
SELECT doc_id, CAST(len(k) AS INTEGER) AS n_ids, CAST(list_sum(list_transform(k, lambda x: length(x))) AS BIGINT) AS id_sum FROM t""")
def doc_terms_text(spark, sf):
    """K9 → S14: per-document id lines ``doc_id id…`` (ids = word lengths
    here) and a vocabulary file, read back."""
    d = S.table(spark, sf, "documents")
    toks = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)
    lines = d.select(F.concat_ws(" ", F.col("doc_id").cast("string"),
                                 F.array_join(F.transform(toks, lambda x: F.length(x).cast("string")), " ")).alias("value"))
    base = work_dir(spark, "docterms")
    lines.write.mode("overwrite").text(os.path.join(base, "docs"))
    vocab = d.select(F.explode(toks).alias("term")).distinct().select(F.concat_ws(" ", "term", F.length("term").cast("string")).alias("value"))
    vocab.write.mode("overwrite").text(os.path.join(base, "vocab"))
    docs, _ = SF.read_doc_terms(spark, os.path.join(base, "docs"), os.path.join(base, "vocab"))
    return docs.select("doc_id", F.size("ids").cast("int").alias("n_ids"),
                       F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@register("topic_matrix_text", """
SELECT label AS "row", round(avg(embedding[1]), 6) AS "Topic1", round(avg(embedding[2]), 6) AS "Topic2",
       round(avg(embedding[3]), 6) AS "Topic3" FROM embeddings GROUP BY label""")
def topic_matrix_text(spark, sf):
    """K9 → S15: a k-column factor matrix as text lines, read back."""
    e = S.table(spark, sf, "embeddings")
    m = e.groupBy("label").agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(f"t{i}") for i in range(3)])
    lines = m.select(F.concat_ws(" ", F.col("label").cast("string"), *[F.format_string("%.17g", f"t{i}") for i in range(3)]).alias("value"))
    path = os.path.join(work_dir(spark, "topics"), "txt")
    lines.write.mode("overwrite").text(path)
    t = SF.read_topic_matrix(spark, path, 3)
    return t.select(F.col("row").cast("int").alias("row"), *[F.round(f"Topic{i}", 6).alias(f"Topic{i}") for i in range(1, 4)])


@register("append_twice", """SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1""")
def append_twice(spark, sf):
    """K2: appending the same rows twice doubles them (no header lines)."""
    path = os.path.join(work_dir(spark, "append"), "csv")
    e = S.table(spark, sf, "events").select("event_id", "event_type", "value")
    K.append_table(e, path, fmt="csv")
    K.append_table(e, path, fmt="csv")
    back = spark.read.schema("event_id long, event_type string, value double").csv(path)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("points_roundtrip", """
SELECT CAST(ts AS DATE) AS "Date", event_type AS field, round(avg(value), 6) AS value FROM events
WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2""")
def points_roundtrip(spark, sf):
    """K4 → S6/P5/P10: daily wide table written as tagged points partitioned
    by measurement; read back with a measurement filter (partition pruning)
    and a field filter."""
    from ..operators.align import keep_series, points_filter
    wide = S.events_daily_wide(spark, sf)
    pts = K.points_long(wide, "events_daily", S.EVENT_TYPES, tags={"type": "closing_price", "h": 0})
    other = K.points_long(wide, "other", ["click"], tags={"type": "closing_price", "h": 0})
    path = os.path.join(work_dir(spark, "points"), "pq")
    K.write_points(pts.unionByName(other), path)
    back = points_filter(spark.read.parquet(path), measurement="events_daily", tags={"type": "closing_price"})
    back = keep_series(back, ["click", "purchase"])
    return back.select("Date", "field", F.round("value", 6).alias("value"))


@register("insert_new", """
WITH firsts AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text)
SELECT doc_id AS "ID", source FROM documents WHERE doc_id IN (SELECT doc_id FROM firsts)
AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def insert_new(spark, sf):
    """K5: keep-first insert keyed by the text (exact copies keep their
    first id); rows already in the target (``labels``) are not inserted."""
    d = S.table(spark, sf, "documents").select(F.col("doc_id").alias("ID"), "text", "source")
    firsts = K.insert_new(d.select("text", "ID", "source"), None, id_col="text")
    target = S.table(spark, sf, "labels").select(F.col("doc_id").alias("ID"))
    return firsts.join(target, on="ID", how="left_anti").select("ID", "source")


@register("params_roundtrip", f"""
WITH {ODAILY}, r AS (SELECT *, row_number() OVER (ORDER BY "Date") AS rn, count(*) OVER () AS n FROM od),
p AS (SELECT min("Price") AS lo, max("Price") AS hi FROM r WHERE rn <= floor(n * 0.7))
SELECT "Date", round(("Price" - lo) / (hi - lo), 6) AS "Price" FROM r, p""")
def params_roundtrip(spark, sf):
    """K7 → M13: a fitted scaler saved as a small table, loaded, applied."""
    from ..functions.scale import minmax_apply, minmax_fit
    from ..operators.align import head_ratio
    d = S.orders_daily(spark, sf)
    path = os.path.join(work_dir(spark, "params"), "scaler")
    K.save_params(minmax_fit(head_ratio(d, 0.7), ["Price"]), path)
    params = K.load_params(spark, path)
    return minmax_apply(d, params, ["Price"]).select("Date", F.round("Price", 6).alias("Price"))


@register("ledger_append", f"""WITH {ODAILY}, d AS (SELECT "Price" AS y, lag("Price") OVER (ORDER BY "Date") AS f FROM od),
e AS (SELECT round(avg(abs(f - y)), 4) AS mae, round(sqrt(avg((f - y) ** 2)), 4) AS rmse, round(avg(abs(f - y) / abs(y)), 6) AS mape
      FROM d WHERE f IS NOT NULL)
SELECT 'random walk; daily orders; h=1' || s AS descriptions, CAST(1 AS INTEGER) AS h, mae, rmse, mape FROM e, (VALUES (''), (' (repeat)')) t(s)""")
def ledger_append(spark, sf):
    """K8: experiment ledger rows (time, description, metrics) appended."""
    from ..operators import evaluate as V
    from ..operators import models as M
    path = os.path.join(work_dir(spark, "ledger"), "pq")
    d = M.random_walk(S.orders_daily(spark, sf), "Price")
    row = V.errors(d, "Price", "yhat").withColumn("h", F.lit(1))
    K.ledger_append(row, path, "random walk; daily orders; h=1")
    K.ledger_append(row, path, "random walk; daily orders; h=1 (repeat)")
    rows = spark.read.parquet(path).filter(F.col("time").isNotNull())  # the clock itself is not compared
    return rows.select("descriptions", "h", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("mape", 6).alias("mape"))


@register("vocab_text", """
WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents)
SELECT term, count(*) AS cnt FROM t GROUP BY term""")
def vocab_text(spark, sf):
    """K9 → S14: a vocabulary written as ``term count`` lines and read back."""
    d = S.table(spark, sf, "documents")
    counts = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("term")) \
        .groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))
    path = os.path.join(work_dir(spark, "vocab"), "txt")
    K.write_terms(counts, path, ("term", "cnt"))
    _, vocab = SF.read_doc_terms(spark, path, path)
    return vocab.select("term", F.col("term_id").alias("cnt"))
