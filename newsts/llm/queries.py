"""The dealt queries ``opN_<name>`` and their SQL (None: tested against
brute force in tests/llm)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, packing
from .common import documents, placed, store, work_folder
from .exact_dedup import exact_dedup
from .html_text import extract_main_text
from .near_dedup import near_dedup
from .quality_rules import STOP_WORDS, quality_rules
from .reversed_search import reversed_search
from .site_quality import site_quality
from .suffix_dedup import suffix_dedup
from .token_alignment import align_tokens
from .token_counts import token_counts
from .toxicity import toxicity
from .url_filter import url_filter

BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
ROW = "__row"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, docs, _labels(spark, sf_dir)).drop("rid")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(placed(documents(spark, sf_dir), ROW), row_col=ROW).select("doc_id", "class_id", "class_size", "kept")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.decode(bpe.encode(documents(spark, sf_dir), BYTE_BPE), BYTE_BPE))


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return site_quality(docs, docs, _labels(spark, sf_dir)).drop("rid")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join(f"'{x}'" for x in sorted({y for w in STOP_WORDS.values() for z in w for y in (z, z.capitalize())}))
OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM again) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_upper,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words
  FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND NOT coalesce(word_chars / n_words < 2.0 OR word_chars / n_words > 12.0, false)
       AND NOT coalesce(n_symbols / n_words > 0.1, false)
       AND NOT coalesce(n_stop_words / n_words < 0.06, false)
       AND NOT coalesce(n_dup_lines / n_lines > 0.5, false)
       AND NOT coalesce(n_upper / word_chars > 0.4, false) AS kept
FROM b
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a new cache for each call, so every call encodes all distinct texts
    counts = token_counts(documents(spark, sf_dir), WORD_BPE, work_folder(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(placed(documents(spark, sf_dir), ROW), row_col=ROW).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(documents(spark, sf_dir), BYTE_BPE)
    pieces = store(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.assign(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(placed(documents(spark, sf_dir), ROW), row_col=ROW).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)
"""

def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH words AS (
  SELECT r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
d AS (SELECT r, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (
  SELECT i, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS i, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY i, term),
names AS (SELECT row_number() OVER () AS i, item_id FROM benchmark),
s AS (
  SELECT q.i, d.r, d.doc_id,
         CAST(sum(times * CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
                  * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN d ON tf.r = d.r CROSS JOIN c GROUP BY q.i, d.r, d.doc_id),
t AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM t JOIN names USING (i) WHERE rank <= 10
"""

# fixed values of the contract: host, path, action
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    found = url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


_RULES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
OP12_SQL = rf"""
WITH rules(h, p, action) AS (VALUES {_RULES}),
u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT row_number() OVER () AS r, page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u),
best AS (
  SELECT r, arg_max(struct_pack(rule := h || p, action := action), length(h) * 100000 + length(p)) AS w
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, w.rule AS rule, coalesce(w.action, 'allow') AS verdict
FROM parts LEFT JOIN best USING (r)
"""

def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(documents(spark, sf_dir), BYTE_BPE, PIECE_BPE)


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_near_dedup": (op2_near_dedup, None),
    "op3_html_text": (op3_html_text, None),
    "op4_bpe": (op4_bpe, None),
    "op5_site_quality": (op5_site_quality, None),
    "op6_quality_rules": (op6_quality_rules, OP6_SQL),
    "op7_token_counts": (op7_token_counts, None),
    "op8_suffix_dedup": (op8_suffix_dedup, None),
    "op9_packing": (op9_packing, None),
    "op10_exact_dedup": (op10_exact_dedup, OP10_SQL),
    "op11_reversed_search": (op11_reversed_search, OP11_SQL),
    "op12_url_filter": (op12_url_filter, OP12_SQL),
    "op13_token_alignment": (op13_token_alignment, None),
}
