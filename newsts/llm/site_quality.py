"""Quality by hierarchical empirical Bayes (operator 5).

A document classifier (logistic, on ratios of the text) gives each document's
evidence.  Hosts and paths of hosts get posteriors from all their documents by
grouped aggregation: a host is shrunk toward the global prior, a path toward
its host, by concentrations estimated from the spread between them, so sparse
sites stay near the prior.  The posterior of the path replaces the global prior
in the document's log odds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, store, strip_white_space
from .quality_rules import STOP_WORDS, SYMBOLS, WORD, _without
from .toxicity import fit_logistic

# documented parameters: labelled documents used for the fit, threshold, most
# log odds that a site may add or take
SAMPLE, THRESHOLD, MOST_SHIFT = 10_000, 0.5, 2.0
EVIDENCE = ["symbols", "upper", "stop", "distinct", "dup_lines", "line_words", "word_chars", "size"]


def evidence(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` (rid, doc_id, host, path, text) without text,
    with one ratio for each name in EVIDENCE; 0 where a text has no words."""
    t, w = F.col("text"), F.col("words")
    stop = sorted({x for words in STOP_WORDS.values() for y in words for x in (y, y.capitalize())})
    split = docs.select("rid", "doc_id", "host", "path", F.coalesce("text", F.lit("")).alias("text")).select(
        "rid", "doc_id", "host", "path",
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"),
        F.length(strip_white_space(t)).alias("chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS + "!"))).alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    n = F.greatest(F.size(w), F.lit(1))
    chars, lines = F.greatest("chars", F.lit(1)), F.greatest(F.size("lines"), F.lit(1))
    ratio = {
        "symbols": F.least(F.col("n_symbols") / n, F.lit(1.0)),
        "upper": F.col("n_upper") / chars,
        "stop": F.size(F.filter(w, lambda x: x.isin(stop))) / n,
        "distinct": F.size(F.array_distinct(w)) / F.pow(n, F.lit(0.8)),
        "dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))) / lines,
        "line_words": F.log1p(n / lines) / 5,
        "word_chars": F.least(chars / n, F.lit(20.0)) / 10,
        "size": F.log1p(n) / 10,
    }
    return split.select("rid", "doc_id", "host", "path", *[ratio[k].cast("double").alias(k) for k in EVIDENCE])


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def fit(table: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights of the document classifier (intercept last), fitted on at most
    SAMPLE labelled documents chosen by the hash of their ids.  The squares of
    the ratios are features too."""
    known = columns(labels, doc_id=("doc_id", "long"), quality=("quality", "int")).dropna()
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = table.join(F.broadcast(known), "doc_id").orderBy("doc_id", "rid").limit(SAMPLE).select("quality", *EVIDENCE).collect()
    x = np.array([list(r)[1:] for r in rows]).reshape(-1, len(EVIDENCE))
    y = np.array([float(r["quality"] > 0) for r in rows])
    return fit_logistic(np.hstack([x, x * x]) * 10, y)


def _linear(weights: np.ndarray) -> Column:
    z = F.lit(float(weights[-1]))
    for k, name in enumerate(EVIDENCE):
        x = F.col(name)
        z = z + x * float(10 * weights[k]) + x * x * float(10 * weights[len(EVIDENCE) + k])
    return F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))


def concentration(groups: DataFrame, n: str, mean: str, center: Column) -> float:
    """Strength of the prior, by moments: the spread of the group means beyond
    what their sizes explain.  Large where groups hardly differ."""
    m, c = F.col(mean), center
    noise = c * (1 - c) / F.col(n)
    row = groups.agg(F.avg(c * (1 - c)).alias("v"), F.avg((m - c) ** 2 - noise).alias("s")).first()
    if row is None or row["v"] is None or row["v"] <= 0:
        return 1.0
    return float(min(max(row["v"] / max(row["s"], 1e-6) - 1, 1.0), 1e6))


def site_quality(docs: DataFrame, training: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """rid, doc_id, p_doc, p_host, p_path, p_quality, kept: one row per input row.

    The classifier is fitted on ``training`` and ``labels`` (doc_id, quality);
    without labels it is undecided and only even odds come out.  Null hosts
    and paths are a host and a path of their own.  A null or empty text is
    judged by its (zero) ratios; repeated rows count like any other.
    """
    def narrow(df: DataFrame) -> DataFrame:
        df = columns(df, doc_id=(id_col, "long"), host=(host_col, "string"), path=(path_col, "string"), text=(text_col, "string"))
        return df.withColumn("rid", F.monotonically_increasing_id())

    table = store(evidence(narrow(docs)), "evidence")
    weights = fit(table if training is docs else evidence(narrow(training)), labels)
    scored = table.select("rid", "doc_id", "host", "path", (1 / (1 + F.exp(-_linear(weights)))).alias("p_doc"))
    paths = store(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s")), "paths")
    hosts = store(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "hosts")
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    prior = float((total["s"] + 0.5) / (total["n"] + 1)) if total["n"] else 0.5
    strength = concentration(hosts.withColumn("m", F.col("hs") / F.col("hn")), "hn", "m", F.lit(prior))
    hosts = hosts.withColumn("p_host", (F.col("hs") + strength * prior) / (F.col("hn") + strength))
    paths = paths.alias("p").join(hosts.alias("h"), F.expr("p.host <=> h.host")).select(
        F.col("p.host").alias("host"), "path", "n", "s", "p_host")
    inner = concentration(paths.withColumn("m", F.col("s") / F.col("n")), "n", "m", F.col("p_host"))
    paths = paths.withColumn("p_path", (F.col("s") + inner * F.col("p_host")) / (F.col("n") + inner))
    shift = F.least(F.greatest(_logit(F.col("p_path")) - _logit(F.lit(prior)), F.lit(-MOST_SHIFT)), F.lit(MOST_SHIFT))
    p = 1 / (1 + F.exp(-(_logit(F.col("p_doc")) + shift)))
    return (scored.alias("d").join(paths.alias("p"), F.expr("d.host <=> p.host AND d.path <=> p.path"))
            .select("rid", "doc_id", "p_doc", "p_host", "p_path", p.alias("p_quality"))
            .withColumn("kept", F.col("p_quality") >= threshold))
