"""Quality rules as one projection (operator 6).

A threshold table names metrics and their allowed range.  It is compiled into
one Spark projection of built-in expressions: length, symbol, stop-word and
line ratios and repeated windows of words, without user functions and without
a shuffle; a document never leaves its row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, strip_white_space

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"  # fixed values of the contract
REPEAT_WINDOW = 8

# fixed values: frequent function words of the four languages
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le".split(),
}

# the threshold table: metric, least, most (None: open).  A text fails with
# the first metric outside its range.
THRESHOLDS = [
    ("n_words", 20, None),
    ("repeat_word_ratio", None, 0.3),
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_word_ratio", None, 0.1),
    ("stop_word_ratio", 0.06, None),
    ("dup_line_ratio", None, 0.5),
    ("upper_char_ratio", None, 0.4),
]


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda an
    expression would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def _covered(starts: Column) -> Column:
    """Words covered by windows with the given sorted starts."""
    w = REPEAT_WINDOW
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-w).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(w), s - a["last"])).alias("n"), s.alias("last")),
        lambda a: a["n"])


def _repeated_starts(words: Column, hashes: Column) -> Column:
    """Sorted starts of the windows whose words occur twice or more.

    The windows are sorted by hash; of those with a neighbour of equal hash
    the words themselves are sorted and compared, so a collision counts
    nothing."""
    def beside(values: Column, same) -> Column:
        def kept(rows: Column) -> Column:
            def keep(x, i):
                before = F.when(i > 0, same(F.get(rows, i - 1), x)).otherwise(F.lit(False))
                after = F.when(i < F.size(rows) - 1, same(F.get(rows, i + 1), x)).otherwise(F.lit(False))
                return before | after
            return F.filter(rows, keep)
        return _let(values, kept)

    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    alike = beside(by_hash, lambda x, y: x["h"] == y["h"])
    texts = F.sort_array(F.transform(alike, lambda x: F.struct(
        x["h"].alias("h"), F.array_join(F.slice(words, x["i"] + 1, REPEAT_WINDOW), " ").alias("w"), x["i"].alias("i"))))
    same = beside(texts, lambda x, y: (x["h"] == y["h"]) & (x["w"] == y["w"]))
    return F.sort_array(F.transform(same, lambda x: x["i"]))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the base counts and further counts of every text."""
    t = F.col("text")
    base = (columns(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
            .select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    split = base.select(
        "doc_id",
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"),
        F.length(strip_white_space(t)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    w = F.col("words")
    hashed = split.select(
        "*", F.size(w).cast("long").alias("n_words"),
        F.when(F.size(w) >= REPEAT_WINDOW,
               F.transform(F.sequence(F.lit(1), F.size(w) - (REPEAT_WINDOW - 1)),
                           lambda i: F.xxhash64(F.slice(w, i, REPEAT_WINDOW))))
        .otherwise(F.array().cast("array<bigint>")).alias("hashes"))
    stop = sorted({x for words in STOP_WORDS.values() for y in words for x in (y, y.capitalize())})
    h = F.col("hashes")
    return hashed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(_repeated_starts(w, h)))
        .otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: x.isin(stop))).cast("long").alias("n_stop_words"))


def compile_rules(thresholds=THRESHOLDS) -> list[tuple[str, Column]]:
    """(metric, failed) for every row of the threshold table.  A metric
    without a value (no words, no lines) fails no rule."""
    n = F.col("n_words")
    metrics = {
        "n_words": n,
        "mean_word_chars": F.try_divide("word_chars", n),
        "symbol_word_ratio": F.try_divide("n_symbols", n),
        "stop_word_ratio": F.try_divide("n_stop_words", n),
        "upper_char_ratio": F.try_divide("n_upper", F.col("word_chars")),
        "dup_line_ratio": F.try_divide("n_dup_lines", F.col("n_lines")),
        "repeat_word_ratio": F.try_divide("n_repeat_words", n),
    }

    def failed(name: str, least, most) -> Column:
        value, bad = metrics[name], F.lit(False)
        if least is not None:
            bad = bad | (value < least)
        if most is not None:
            bad = bad | (value > most)
        return F.coalesce(bad, F.lit(False))

    return [(name, failed(name, least, most)) for name, least, most in thresholds]


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of each text with ``base_failed``, ``failed_rules`` and
    ``kept``: one row per input row.

    A null or empty text has no words and fails the base.  Repeated rows and
    null ids are judged like any other row.
    """
    n = F.col("n_words")
    base_failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    rules = compile_rules(thresholds)
    failed = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())
    return (measures(docs, id_col, text_col)
            .select("*", base_failed.alias("base_failed"), failed.alias("failed_rules"))
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))
