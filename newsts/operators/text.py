"""Text corpus operators.

Documents are never gathered: token work is a per-row expression or an
``posexplode`` into a token table; vocabulary-level work (stemming,
proper-noun statistics, id assignment) runs once per *distinct* term and is
joined back.  Vocabularies cut to a fixed size (top-n) are the only sides
broadcast by hint; an uncut vocabulary joins by shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions.porter import stem as porter_stem
from ..session import cut_lineage
from .vectors import frequent


# token tables -----------------------------------------------------------------
def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lower: bool = True,
                stop: bool = False) -> DataFrame:
    """(doc_id, pos, token) for every token of every whole document."""
    arr = TX.tokens(text_col, lower)
    if stop:
        arr = TX.drop_stop_words(arr)
    return docs.select(id_col, F.posexplode(arr).alias("pos", "token"))


def basic_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """T2 as a column: the cleaned text (one row per document)."""
    return docs.select(id_col, TX.basic_clean(text_col).alias("clean"))


# T1 ---------------------------------------------------------------------------
STEM_CACHE = 300_000  # documented parameter: cleaned tokens kept by a task
STOPS, PUNCTUATION = frozenset(TX.STOP_WORDS), str.maketrans("", "", TX.PUNCTUATION)


HOT_FORMS = 200_000  # documented parameter: proper forms given to every task, at most
FORMS = 200_000  # documented parameter: forms counted before they leave a task


def _capital(token: str) -> bool:
    return unicodedata.category(token[0]) == "Lu"


def proper_forms(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, counts: bool = False) -> DataFrame:
    """Form (and ``n``, how often it occurs there).  A lower-case form is a proper noun when at least ``threshold``
    of its occurrences away from a sentence start are capitalised (a corpus
    statistic replacing a POS tagger).  The sentence start is a test on the
    token before; what is shuffled are counts per form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, find = re.compile("[.!?]+[\u0085\u2028\u2029]?").fullmatch, TX.find_tokens
        inside: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            kept: dict[str, list[int]] = {}
            for w, n in inside.items():
                if unicodedata.category(w[0])[0] == "L":
                    both = kept.setdefault(w.lower(), [0, 0])
                    both[0] += n * _capital(w)
                    both[1] += n
            return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), *[pa.array([v[i] for v in kept.values()], pa.int64()) for i in (0, 1)]],
                                              names=["form", "capital", "n"])

        for batch in batches:
            for text in batch.column("t"):
                toks = find(text.as_py() or "")
                inside.update([t for p, t in zip(toks, toks[1:]) if p[0] not in ".!?" or not end(p)])
                if len(inside) > FORMS:
                    yield out()
                    inside.clear()
        yield out()

    t = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "form string, capital long, n long")
    return (t.groupBy("form").agg((F.sum("capital") / F.sum("n")).alias("cap_share"), F.sum("n").alias("n"))
             .filter(F.col("cap_share") >= threshold).select("form", *(["n"] if counts else [])))


def stem_vocabulary(forms: DataFrame, col: str = "form") -> DataFrame:
    """Stem each distinct form once (mapInPandas over the distinct
    vocabulary, which Spark partitions), to be joined back."""
    def run(it):
        for pdf in it:
            yield pd.DataFrame({col: pdf[col], "stem": [porter_stem(x) for x in pdf[col]]})
    return forms.select(col).distinct().mapInPandas(run, schema=T.StructType(
        [T.StructField(col, T.StringType()), T.StructField("stem", T.StringType())]))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stem: bool = True,
          proper: bool = True, threshold: float = 0.5) -> DataFrame:
    """Tokenize (case kept) → stem every token that is not a proper
    noun (stems are lower-case) → drop stop words (after stemming, case
    sensitive) → delete ASCII punctuation inside tokens → all-digit token →
    ``<NUM>`` → drop empties → join by space, in token order."""
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_s"))
    if not stem:
        w = F.transform(TX.tokens("_s", lower=False), F.lower)
        w = F.transform(TX.drop_stop_words(w), lambda t: TX.strip_punctuation(t))
        w = F.filter(F.transform(w, lambda t: F.when(t.rlike("^[0-9]+$"), F.lit("<NUM>")).otherwise(t)), lambda t: t != "")
        return texts.select(F.col("_id").alias(id_col), F.coalesce(F.array_join(w, " "), F.lit("")).alias("clean"))
    spark, names, rare = docs.sparkSession, frozenset(), False
    if proper:
        # the most frequent proper forms, a bounded number, are given to every task;
        # documents are joined with the rest of theirs, if there are any
        forms = cut_lineage(proper_forms(texts, "_s", threshold, counts=True))
        hot, least = frequent(forms, HOT_FORMS)
        names = frozenset(hot.select("form").toArrow().column("form").to_pylist())  # bounded
        rest = forms if least is None else forms.filter(F.col("n") < least)
        rare = not rest.isEmpty()
    given = spark.sparkContext.broadcast(names)
    texts = texts.withColumn("_own", F.lit(None).cast("array<string>"))
    if rare:
        def capitals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, forms = [], []
                for i, text in enumerate(batch.column("_s")):
                    own = {t.lower() for t in set(TX.find_tokens(text.as_py() or "")) if _capital(t)} - given.value
                    at += [i] * len(own)
                    forms += own
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(at, pa.int64())), pa.array(forms, pa.string())], names=["_id", "form"])

        said = texts.select("_id", "_s").mapInArrow(capitals, T.StructType([texts.schema["_id"], T.StructField("form", T.StringType())]))
        own = said.join(rest.select("form"), "form").groupBy("_id").agg(F.collect_set("form").alias("_own"))
        texts = texts.drop("_own").join(own, "_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, open_ = given.value, {}  # forms of capitalised tokens that a document decides

        def finished(word: str) -> str:
            if word in STOPS:
                return ""
            word = word.translate(PUNCTUATION)
            return "<NUM>" if word.isascii() and word.isdigit() else word

        class Known(dict):
            """What this task has cleaned."""

            def __missing__(self, token: str) -> str:
                if len(self) >= STEM_CACHE:
                    self.clear()
                    open_.clear()
                form = token.lower()
                if _capital(token):
                    if form in hot:
                        self[token] = finished(token)
                        return self[token]
                    open_[token] = form
                self[token] = finished(porter_stem(form))
                return self[token]

        known, find = Known(), TX.find_tokens
        for batch in batches:
            out = []
            for text, own in zip(batch.column("_s"), batch.column("_own").to_pylist(), strict=True):
                toks = find(text.as_py() or "")
                if own:
                    words, own = [], set(own)
                    for t in toks:
                        word = known[t]
                        words.append(finished(t) if open_.get(t) in own else word)
                else:
                    words = map(known.__getitem__, toks)
                out.append(" ".join(filter(None, words)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, pa.string())], names=[id_col, "clean"])

    # documents whose every token was removed keep an empty text
    return texts.select("_id", "_s", "_own").mapInArrow(run, T.StructType([T.StructField(id_col, texts.schema["_id"].dataType), T.StructField("clean", T.StringType())]))


def clean_fast(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """T1 without stemming or the proper-noun rule: one per-row expression
    (lower-case tokens, stop words, punctuation, numbers)."""
    arr = TX.tokens(text_col, lower=True)
    arr = TX.drop_stop_words(arr)
    arr = F.transform(arr, lambda t: TX.strip_punctuation(t))
    arr = F.transform(arr, lambda t: F.when(t.rlike("^[0-9]+$"), F.lit("<NUM>")).otherwise(t))
    arr = F.filter(arr, lambda t: t != "")
    return docs.select(id_col, F.array_join(arr, " ").alias("clean"))


# T3 / T4 ----------------------------------------------------------------------
def frequency_vocab(texts: DataFrame, id_col: str = "doc_id", text_col: str = "clean", n: int = 2000) -> DataFrame:
    """rank = 1 for the most frequent term; ties by first occurrence
    (document id, then position).  Terms with rank < n are usable."""
    t = texts.select(id_col, F.posexplode(TX.frequency_tokens(text_col)).alias("pos", "term"))
    agg = t.groupBy("term").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct(id_col, "pos")).alias("_first"))
    # top n−1 by a bounded TakeOrdered (each task keeps n−1 rows); the rank
    # window then runs on those n−1 rows only
    top = agg.orderBy(F.col("cnt").desc(), F.col("_first")).limit(n - 1)
    w = Window.orderBy(F.col("cnt").desc(), F.col("_first"))
    return top.withColumn("rank", F.row_number().over(w)).select("term", "cnt", "rank")


def id_sequences(terms: DataFrame, vocab: DataFrame, id_col: str = "doc_id", id_name: str = "term_id") -> DataFrame:
    """T3/T5 apply: (doc, pos, term) → ordered list of term ids per
    document, unknown terms dropped.  The planner broadcasts a vocabulary that
    it knows to be small, as a top-n cut; the ordered list is one document's
    own terms."""
    j = terms.join(vocab.select("term", F.col(id_name).alias("_id")), on="term", how="inner")
    s = j.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "_id"))).alias("_s"))
    return s.select(id_col, F.transform("_s", lambda x: x["_id"]).alias("ids"))


def frequency_terms(texts: DataFrame, id_col: str = "doc_id", text_col: str = "clean") -> DataFrame:
    return texts.select(id_col, F.posexplode(TX.frequency_tokens(text_col)).alias("pos", "term"))


def pad(seq, n: int = 50, value: int = 0):
    """T4: left-pad with ``value`` / keep the last n ids (pre-padding and
    pre-truncation)."""
    s = F.col(seq) if isinstance(seq, str) else seq
    last = F.when(F.size(s) > n, F.slice(s, F.size(s) - n + 1, n)).otherwise(s)
    return F.concat(F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(last), F.lit(0))), last)


def strip_padding(seq, value: int = 0):
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.filter(s, lambda x: x != value)


# T5 / T6 ----------------------------------------------------------------------
def whitespace_lists(texts: DataFrame, id_col: str = "doc_id", text_col: str = "clean") -> DataFrame:
    """(doc_id, terms): the tokens of a cleaned text split on whitespace, empty
    pieces dropped, as one array."""
    return texts.select(id_col, F.filter(F.split(F.col(text_col), r"\s+"), lambda t: t != "").alias("terms"))


def whitespace_terms(texts: DataFrame, id_col: str = "doc_id", text_col: str = "clean") -> DataFrame:
    """The tokens of :func:`whitespace_lists`, one row for each."""
    return whitespace_lists(texts, id_col, text_col).select(id_col, F.posexplode("terms").alias("pos", "term"))


def vocab_top(terms: DataFrame, min_count: int = 3, n: int = 2000) -> DataFrame:
    """Terms with count > min_count, the n most frequent (ties by
    term), then ids 1..n in alphabetical order."""
    cnt = terms.groupBy("term").agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > min_count)
    top = cnt.orderBy(F.col("cnt").desc(), F.col("term")).limit(n)
    return top.withColumn("term_id", F.row_number().over(Window.orderBy("term")))


def doc_term(terms: DataFrame, vocab: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term_id, tf) over the vocabulary, which the planner
    broadcasts where it knows it to be small, as a top-n cut."""
    j = terms.join(vocab.select("term", "term_id"), on="term", how="inner")
    return j.groupBy(id_col, "term_id").agg(F.count(F.lit(1)).alias("tf"))


# T7 / T8 / T9 -------------------------------------------------------------------
# documented parameters: terms across a tile of 32 MB, tiles held by a task,
# documents multiplied at once, rows held until there are as many documents
TILE, TILES, DOCS, ROWS = 2048, 16, 512, 500_000


class Tiles:
    """Sums of tf·tf' by term and term, in tiles made when first needed."""

    def __init__(self):
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def add(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Iterator[pd.DataFrame]:
        """Add the rows of whole documents (terms from 0); tiles that have no
        room any more leave as rows."""
        docs, of = np.unique(doc, return_inverse=True)
        order = np.argsort(of, kind="stable")
        of, term, tf = of[order], term[order], tf[order]
        for lo in range(0, len(docs), DOCS):
            n = min(DOCS, len(docs) - lo)
            here = slice(*np.searchsorted(of, [lo, lo + n]))
            at, tile, count = (of[here] - lo) * TILE + term[here] % TILE, term[here] // TILE, tf[here]
            blocks = {b: np.bincount(at[tile == b], count[tile == b], n * TILE).reshape(n, TILE) for b in np.unique(tile).tolist()}
            for i, x in blocks.items():
                for j, y in blocks.items():
                    if (i, j) not in self.held:
                        if len(self.held) >= TILES:
                            yield from self.spill()
                        self.held[i, j] = np.zeros((TILE, TILE))
                    self.held[i, j] += x.T @ y

    def spill(self) -> Iterator[pd.DataFrame]:
        for (i, j), tile in self.held.items():
            rows = np.flatnonzero(tile.any(axis=1))
            yield pd.DataFrame({"i": rows + i * TILE + 1, "block": np.full(len(rows), j), "row": list(tile[rows])})
        self.held = {}


def cooccurrence(dt: DataFrame, n_terms: int, id_col: str = "doc_id", docs_whole_in_tasks: bool = False) -> DataFrame:
    """n_ij = Σ_doc tf_i·tf_j over ordered pairs, self pairs included.

    A task adds some hundred documents at a time to tiles of the term×term
    matrix and carries the last one over, so it holds a bounded number of rows, one
    document and a bounded number of tiles, whatever the number or length of
    the documents.  The rows of the tiles are summed by term with
    ``Summarizer``, a mergeable aggregate; only non-zero cells are kept."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tiles, rest = Tiles(), None
        held, docs, rows = [], 0, 0

        def hold(part: pd.DataFrame) -> None:
            nonlocal docs, rows
            if len(part):
                doc, own = pd.factorize(part[id_col], use_na_sentinel=False)
                held.append((doc + docs, part["term_id"].to_numpy() - 1, part["tf"].to_numpy()))
                docs, rows = docs + len(own), rows + len(part)

        for pdf in it:
            if not len(pdf):
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf])
            last = pdf[id_col].iloc[-1]
            more = (pdf[id_col] == last).to_numpy() if last is not None else pdf[id_col].isna().to_numpy()
            cut = int(np.flatnonzero(~more)[-1]) + 1 if (~more).any() else 0
            rest = pdf.iloc[cut:]
            hold(pdf.iloc[:cut])
            # adding to a tile costs as much for a few documents as for many
            if docs >= DOCS or rows >= ROWS:
                yield from tiles.add(*map(np.concatenate, zip(*held, strict=True)))
                held, docs, rows = [], 0, 0
        if rest is not None:
            hold(rest)
        if held:
            yield from tiles.add(*map(np.concatenate, zip(*held, strict=True)))
        yield from tiles.spill()

    # each document's rows must sit together in one task: dealt and sorted by
    # the document, unless they come straight from exploding one row per
    # document (a scan → explode → broadcast-join chain never splits one)
    src = dt.select(id_col, "term_id", F.col("tf").cast("double").alias("tf")).filter(F.col("term_id").between(1, int(n_terms)))
    if not docs_whole_in_tasks:
        src = src.repartition(id_col).sortWithinPartitions(id_col)
    parts = src.mapInPandas(partial, "i long, block long, row array<double>")
    summed = parts.groupBy("i", "block").agg(Summarizer.sum(array_to_vector("row")).alias("v"))
    cells = summed.select("i", "block", F.posexplode(vector_to_array("v")).alias("j0", "n_ij"))
    return cells.filter(F.col("n_ij") != 0).select("i", (F.col("block") * TILE + F.col("j0") + 1).cast("long").alias("j"), "n_ij")


def ppmi(cooc: DataFrame) -> DataFrame:
    """max(0, ln(N·n_ij / (n_i·n_j))) with row sums n_i, column sums
    n_j and total N; zero cells are absent (= 0)."""
    rows = cooc.groupBy(F.col("i")).agg(F.sum("n_ij").alias("n_i"))
    cols = cooc.groupBy(F.col("j")).agg(F.sum("n_ij").alias("n_j"))
    total = cooc.select(F.sum("n_ij")).scalar()
    j = cooc.join(rows, on="i").join(cols, on="j")
    return j.select("i", "j", F.greatest(F.lit(0.0), F.log(total * F.col("n_ij") / (F.col("n_i") * F.col("n_j")))).alias("ppmi"))


def coherence(cooc: DataFrame, top_ids: DataFrame) -> DataFrame:
    """2·Σ_{a<b} PMI(a,b) / (n(n−1)) over the top keywords, with
    PMI = ln(n_ab·N/(C_a·C_b)) and 0 for a zero pair.  Zero pairs add
    nothing, so only the stored non-zero cells between two keywords are
    read (two semi-joins); no keyword pairs are generated."""
    rows = cooc.groupBy("i").agg(F.sum("n_ij").alias("c"))
    total = cooc.select(F.sum("n_ij")).scalar()
    k = top_ids.select(F.col("term_id"))
    cells = (cooc.filter(F.col("j") < F.col("i"))
                 .join(k.withColumnRenamed("term_id", "i"), on="i", how="left_semi")
                 .join(k.withColumnRenamed("term_id", "j"), on="j", how="left_semi"))
    pc = cells.join(rows.select(F.col("i"), F.col("c").alias("ca")), on="i") \
              .join(rows.select(F.col("i").alias("j"), F.col("c").alias("cb")), on="j")
    pmi = F.log(F.col("n_ij") * total / F.col("ca") / F.col("cb"))
    n = k.select(F.count(F.lit(1))).scalar()
    return pc.agg((F.lit(2.0) * F.coalesce(F.sum(pmi), F.lit(0.0)) / n / (n - 1)).alias("coherence"))


# T10 ----------------------------------------------------------------------------
LEXICON_TERMS = 10_000  # documented parameter: terms of a lexicon that is looked up inside the row


def sentiment(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              negations: Sequence[str] = ("not", "never", "no", "nicht", "pas", "kein")) -> DataFrame:
    """Polarity / subjectivity per document from a lexicon table
    (term, polarity, subjectivity, intensity).  A hit right after a negation
    word has its polarity × −0.5; a hit right after an intensifier (a
    lexicon term with intensity ≠ 1) is multiplied by that intensity.
    Scores are the mean over hits; documents without hits score 0.  The
    neighbour of a token comes from its document's array, so no token rows
    are shuffled to order them."""
    listed = [r[0] for r in lexicon.select("term").limit(LEXICON_TERMS + 1).collect()]
    if len(listed) <= LEXICON_TERMS:
        # a small lexicon is looked up where the document is; only hits leave it
        terms = frozenset(listed)

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, found, before = [], [], []
                for k, text in enumerate(batch.column("_s")):
                    toks = TX.find_tokens(text.as_py() or "")
                    places = [i for i, t in enumerate(toks) if t in terms]
                    if toks:  # a document without a hit has one row, one without tokens none
                        at += [k] * max(len(places), 1)
                        found += [toks[i] for i in places] or [None]
                        before += [toks[i - 1] if i else None for i in places] or [None]
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(before, pa.string())],
                                                 names=[id_col, "token", "prev"])

        texts = docs.select(id_col, F.lower(text_col).alias("_s"))
        rows = texts.mapInArrow(hits, T.StructType([texts.schema[id_col], *[T.StructField(c, T.StringType()) for c in ("token", "prev")]]))
    else:
        arrays = docs.select(id_col, TX.tokens(text_col).alias("_t")).filter(F.size("_t") > 0)
        pairs = F.transform("_t", lambda t, i: F.struct(t.alias("token"), F.get("_t", i - 1).alias("prev")))
        rows = arrays.select(id_col, F.explode_outer(pairs).alias("_p")).select(id_col, "_p.token", "_p.prev")
    hit = rows.join(lexicon.withColumnRenamed("term", "token"), on="token", how="left")
    mult = lexicon.select(F.col("term").alias("prev"), F.col("intensity").alias("_mult")).filter(F.col("_mult") != 1.0)
    hit = hit.join(mult, on="prev", how="left")
    neg = F.coalesce(F.col("prev").isin(list(negations)), F.lit(False))
    pol = F.col("polarity") * F.coalesce(F.col("_mult"), F.lit(1.0)) * F.when(neg, F.lit(-0.5)).otherwise(F.lit(1.0))
    subj = F.least(F.lit(1.0), F.col("subjectivity") * F.coalesce(F.col("_mult"), F.lit(1.0)))
    found = F.col("polarity").isNotNull()
    mean = {"polarity": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pol)), "subjectivity": subj}
    return hit.groupBy(id_col).agg(*[F.coalesce(F.avg(F.when(found, e)), F.lit(0.0)).alias(n) for n, e in mean.items()])


# T15 ----------------------------------------------------------------------------
# fixed values: the six pattern families of the geopolitical index, as published
# (family 0 as in the code, including its 'LatinAmerica' spelling)
GEO_PATTERNS = [
    r"(([G,g]eopoli(tical)*).*(risk|concern|tension|uncertaint))|(^(?=.*(United States))(?=.*tension)(?=.*(military|war|geopolitical|coup|guerrilla|warfare))(?=.*((LatinAmerica)|(Central America)|(South America)|Europe|Africa|(Middle East)|(Far East)|Asia)).*$)",
    r"^(?=.*((tomic war)|(uclear war)|(uclear conflict)|(tomic conflict)|(uclear missile)))(?=.*(fear|threat|risk|peril|menace)).*$",
    r"(war risk)|(risk.* of war)|(fear of war)|(war fear)|(military threat)|(war threat)|(threat of war)|(^(?=.*((military action)|(military operation)|(military force)))(?=.*(risk|threat)).*$)",
    r"(errorist threat)|(hreat of terrorism)|(errorism menace)|(enace of terrorism)|(errorist risk)|(error risk)|(isk of [T,t]errorism)|(error threat)",
    r"(eginning of the war)|(utbreak of the war)|(nset of the war)|(scalation of the war)|(tart of the war)|(^(?=.*(war|militar))(?=.*(ir strike)).*$)|(^(?=.*(war|battle))(?=.*(eavy casualt)).*$)",
    r"(terrorist acts*)",
]
# fixed value: the README spelling of family 0 (flag ``fixed_patterns``)
GEO_FAMILY0_FIXED = GEO_PATTERNS[0].replace("(LatinAmerica)", "(Latin America)")


def geo_patterns(fixed_patterns: bool = False) -> list[str]:
    pats = list(GEO_PATTERNS)
    if fixed_patterns:
        pats[0] = GEO_FAMILY0_FIXED
    return pats


def geo_regex(df: DataFrame, col: str = "News", families: Sequence[int] = range(6),
              fixed_patterns: bool = False, out: str = "GeoIdx") -> DataFrame:
    """Σ over the pattern families of the number of non-overlapping
    matches in the whole text (Java regex, so the lookaheads work).  Python
    ``re`` without flags: ``.`` stops at a line break and ``^``/``$``
    anchor the whole string, as in Java's defaults."""
    pats = geo_patterns(fixed_patterns)
    total = F.lit(0)
    for k in families:
        total = total + F.regexp_count(F.col(col), F.lit(pats[k]))
    return df.withColumn(out, total.cast("long"))


# T17 ----------------------------------------------------------------------------
# fixed values: relation words of the rule-based triple extractor (ours)
RELATION_WORDS = ["is", "are", "was", "were", "be", "has", "have", "had", "ist", "sind", "war", "hat",
                  "est", "sont", "a", "es", "son", "ha", "fue"]


def triples(docs: DataFrame, verbs: Sequence[str] = tuple(RELATION_WORDS), id_col: str = "doc_id", text_col: str = "text",
            stop: bool = True) -> DataFrame:
    """T17 (re-aimed): a relation is a token from the verb table; subject =
    nearest content token on its left, object = nearest on its right
    (content = a word token that is not a stop word or a verb), within one
    document.  Both come from one pass over the document's token array: the
    running state is (last content word, triples still without an object)."""
    def run(it):
        word = re.compile(r"\w+\Z").match
        for pdf in it:
            ids, at, subjects, relations, objects = [], [], [], [], []
            for doc, toks in zip(pdf[id_col], pdf["_t"], strict=True):
                last, waiting = None, []
                for i, t in enumerate(toks if toks is not None else ()):
                    if t in verb_set:
                        if last is not None:
                            waiting.append((i, last, t))
                    elif t not in stop_set and word(t):
                        for k, subject, relation in waiting:
                            ids.append(doc)
                            at.append(k)
                            subjects.append(subject)
                            relations.append(relation)
                            objects.append(t)
                        last, waiting = t, []
            yield pd.DataFrame({id_col: ids, "pos": at, "subject": subjects, "relation": relations, "object": objects})

    verb_set, stop_set = set(verbs), set(TX.STOP_WORDS) if stop else set()
    src = docs.select(id_col, TX.tokens(text_col).alias("_t"))
    schema = T.StructType([src.schema[id_col], T.StructField("pos", T.IntegerType()),
                           *[T.StructField(c, T.StringType()) for c in ("subject", "relation", "object")]])
    return src.mapInPandas(run, schema)
