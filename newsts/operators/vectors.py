"""Vector operators.

Element-wise aggregates never gather a group's vectors: each vector is
``posexplode``d to (group, dim, x), aggregated per (group, dim) with the
usual partial (map-side) aggregation — so a hot day is pre-reduced in
every task — and the d results are re-assembled in dimension order.
Per document, token vectors are pre-aggregated by term frequency first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as FV
from ..session import cut_lineage

_AGG = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}


def assemble(long: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """(keys, dim, part values) → one array per part, in dim order."""
    s = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", *parts))).alias("_s"))
    def field(p):
        return F.transform("_s", lambda r: r[p]).alias(p)
    return s.select(*keys, *[field(p) for p in parts])


def daily_vectors(df: DataFrame, col: str, parts: Sequence[str] = ("mean",), by: Sequence[str] = ("Date",),
                  out: str = "vec", weight: str | None = None) -> DataFrame:
    """A4 (``parts=('mean',)``), A5 (max‖mean‖min), A6 (max‖min):
    element-wise aggregates per group, concatenated in ``parts`` order.
    Uses Spark ML's ``Summarizer`` — a mergeable vector aggregate with a
    partial (map-side) stage — so no group's vectors are gathered and no
    row is exploded per dimension."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    summ = Summarizer.metrics(*parts)
    v = array_to_vector(F.col(col))
    agg = df.groupBy(*by).agg((summ.summary(v, F.col(weight)) if weight else summ.summary(v)).alias("_s"))
    return agg.select(*by, F.concat(*[vector_to_array(F.col(f"_s.{p}")) for p in parts]).alias(out))


def role_events(df: DataFrame, roles: Sequence[str], by: Sequence[str] = ("Date",), out: str = "vec") -> DataFrame:
    """T23 by role: max‖mean‖min (A5) of each role's vector column, the roles
    one after the other; one grouped aggregate for all of them."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    parts = ("max", "mean", "min")
    summ = Summarizer.metrics(*parts)
    agg = df.groupBy(*by).agg(*[summ.summary(array_to_vector(F.col(r))).alias(f"_{r}") for r in roles])
    return agg.select(*by, F.concat(*[vector_to_array(F.col(f"_{r}.{p}")) for r in roles for p in parts]).alias(out))


def daily_scalar_mean(df: DataFrame, col: str, by: Sequence[str] = ("Date",), out: str = "mean_of_mean") -> DataFrame:
    """Mean of each vector, then the group mean."""
    return df.groupBy(*by).agg(F.avg(FV.vec_mean_scalar(col)).alias(out))


def centroids(df: DataFrame, col: str, key: str) -> DataFrame:
    """Mean vector per key (pattern vectors from labelled rows)."""
    return daily_vectors(df, col, ("mean",), by=(key,), out="centroid")


PATTERNS = 1000  # documented parameter: stated query vectors of one call


def inline_patterns(patterns: DataFrame, key: str, col: str) -> list[tuple]:
    """The stated query vectors as literals of the plan, like a fitted model's
    parameters; more than ``PATTERNS`` of them are an error, to be asked in
    several calls."""
    rows = patterns.select(key, col).limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} query vectors")
    return sorted((r[key], list(r[col])) for r in rows)


def pattern_similarity(df: DataFrame, col: str, patterns: list[tuple], by: Sequence[str] = ("Date",),
                       prefix: str = "sim_", how: str = "max") -> DataFrame:
    """Cosine of each row's vector with every pattern vector, then the
    per-group max (one column per pattern)."""
    given = np.array([vec for _, vec in patterns], float)
    size = np.sqrt((given * given).sum(axis=1)) if len(patterns) else np.zeros(0)
    names = [f"{prefix}{name}" for name, _ in patterns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_v")
            known = np.flatnonzero((lists.is_valid().to_numpy(zero_copy_only=False)) & (lists.value_lengths().fill_null(0).to_numpy() == given.shape[1]))
            x = lists.take(pa.array(known)).flatten().to_numpy(zero_copy_only=False).reshape(len(known), given.shape[1])
            den = np.sqrt((x * x).sum(axis=1))[:, None] * size
            sims = np.full((batch.num_rows, len(names)), np.nan)
            sims[known] = np.divide(x @ given.T, den, out=np.full(den.shape, np.nan), where=den > 0)
            none = np.ones(sims.shape, bool)
            none[known] = ~(den > 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], *[pa.array(sims[:, j], mask=none[:, j]) for j in range(len(names))]], names=[*by, *names])

    if not names:
        return df.select(*by).distinct()
    scored = df.select(*by, F.col(col).cast("array<double>").alias("_v"))
    scored = scored.mapInArrow(run, T.StructType([*[scored.schema[c] for c in by], *[T.StructField(n, T.DoubleType()) for n in names]]))
    return scored.groupBy(*by).agg(*[_AGG[how](n).alias(n) for n in names])


def nearest(df: DataFrame, col: str, id_col: str, patterns: list[tuple], n: int = 5) -> DataFrame:
    """The n rows most similar (cosine) to each query vector; ties by
    id.  Ranking windows are partitioned by query."""
    # one pass over the rows: each row gives its similarity to every query
    sims = [F.struct(F.lit(name).alias("query"), FV.cosine(col, F.array(*[F.lit(float(v)) for v in vec])).alias("sim"))
            for name, vec in patterns]
    u = df.select(id_col, F.explode(F.array(*sims)).alias("s")).select("s.query", id_col, "s.sim")
    w = Window.partitionBy("query").orderBy(F.col("sim").desc(), F.col(id_col))
    return u.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# documented parameters: frequent words whose vectors are given to every task, at most
HOT_WORDS = 200_000


# documented parameter: tokens handled at once in a task, or one document
TOKENS = 500_000


def token_parts(batches: Iterator[pa.RecordBatch], col: str, split: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """(some rows, row of each token, tokens) of ``TOKENS`` tokens at a time, from rows
    with one token, an array of them or, with ``split``, a text that is split on white space."""
    for batch in batches:
        if split:
            lo, size, words = 0, [], []
            for i, text in enumerate(batch.column(col)):
                own = (text.as_py() or "").encode().split()  # at ASCII white space
                size.append(len(own))
                words += own
                if len(words) >= TOKENS or i + 1 == batch.num_rows:
                    yield batch.slice(lo, i + 1 - lo), np.repeat(np.arange(i + 1 - lo), size), pa.array(words, pa.string())
                    lo, size, words = i + 1, [], []
            continue
        listed, lo = pa.types.is_list(batch.column(col).type), 0
        ends = np.cumsum(batch.column(col).value_lengths().fill_null(0).to_numpy()) if listed else np.arange(1, batch.num_rows + 1)
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOKENS, "right")))
            part, size = batch.slice(lo, hi - lo), np.diff(ends[lo:hi], prepend=ends[lo - 1] if lo else 0)
            yield part, np.repeat(np.arange(hi - lo), size), part.column(col).flatten() if listed else part.column(col)
            lo = hi


def token_blocks(batches: Iterator[pa.RecordBatch], id_col: str, token_col: str, split: bool = False) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """(different documents, place of each token's document among them, tokens
    without nulls) of the parts."""
    for part, row, said in token_parts(batches, token_col, split):
        ids = part.column(id_col).dictionary_encode("encode")
        if said.null_count:
            row, said = row[said.is_valid().to_numpy(zero_copy_only=False)], said.drop_null()
        if len(said):
            yield ids.dictionary, ids.indices.to_numpy().astype(np.int64)[row], said


def word_counts(tokens: DataFrame, col: str, split: bool = False) -> DataFrame:
    """(w, n): how often each word is among the tokens, one a row, an array of them
    or a text to be split."""
    if not split and not isinstance(tokens.schema[col].dataType, T.ArrayType):
        return tokens.select(F.col(col).alias("w")).filter("w IS NOT NULL").groupBy("w").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, said in token_parts(batches, "w", split):
            found = said.drop_null().value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["w", "n"])

    return tokens.select(F.col(col).alias("w")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[DataFrame, int | None]:
    """(rows of the most frequent words, their least count): at most
    ``most``, cut between counts so that no ranking of all words is made."""
    level = F.floor(F.log2("n") * 8)
    cut, held = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        held += r["words"]
        if held > most:
            break
        cut = r["n"]
    return counts.filter(F.lit(False) if cut is None else F.col("n") >= cut), cut


def sentence_vectors(tokens: DataFrame, word_vectors: DataFrame | Callable[[DataFrame], DataFrame], id_col: str = "doc_id",
                     token_col: str = "token", term_col: str = "term", vec_col: str = "vector", split: bool = False) -> DataFrame:
    """Mean of the unit word vectors of a document's known tokens
    (unknown tokens dropped; a document of such tokens alone has no row).
    ``token_col`` has one token a row or an array of them, or with ``split`` texts
    whose tokens stand between white space.
    ``word_vectors`` is a table of words or a function that joins the vectors
    to rows with a word.

    Tokens of the frequent words, a bounded number, are summed where the
    document is: a batch of tokens leaves one sum for each document.  Only the
    counted tokens of all other words meet their vectors in a join, a few for
    each word; these and the sums are added by document."""
    counts = cut_lineage(word_counts(tokens, token_col, split))

    def looked_up(rows: DataFrame) -> DataFrame:
        named = rows.withColumnRenamed("w", term_col)
        found = word_vectors(named) if callable(word_vectors) else named.join(word_vectors.select(term_col, vec_col), term_col)
        found = found.withColumnRenamed(term_col, "w").withColumn("norm", FV.norm(vec_col))
        return found.filter("norm > 0").withColumnRenamed(vec_col, "v")

    spark, schema = tokens.sparkSession, tokens.schema
    hot = looked_up(frequent(counts, HOT_WORDS)[0].select("w")).select("w", "v", "norm").toArrow()  # bounded
    words, at = _index(hot.column("w"))
    flat, size = hot.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), 0
    if len(at):
        size = len(flat) // len(at)
    # a word that has several vectors counts once for each
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(words)))
    vectors = flat.reshape(len(at), size)[order]
    many, norm = np.diff(np.append(starts, len(at))).astype(float), hot.column("norm").to_numpy()[order]
    if len(at) > len(words):
        vectors, norm = np.add.reduceat(vectors / norm[:, None], starts, axis=0), np.ones(len(words))
    given = spark.sparkContext.broadcast((words, vectors, norm, many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors, norm, many = given.value
        index = pd.Index(words)
        for ids, of, said in token_blocks(batches, "_id", "w", split):
            said = said.dictionary_encode()
            place = index.get_indexer(said.dictionary.to_numpy(zero_copy_only=False)) if len(index) else np.full(len(said.dictionary), -1)
            width = len(said.dictionary)
            cells, n = np.unique(of * width + said.indices.to_numpy(), return_counts=True)
            doc, word = cells // width, cells % width
            n, place = n.astype(float), place[word]
            known = place >= 0
            if known.any():
                d, k = doc[known], place[known]
                starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                total, times = np.empty((len(starts), size)), n[known] / norm[k]
                lo = 0
                while lo < len(starts):  # a few documents at a time stay in the processor's cache
                    hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + 4096, "right")) - 1)
                    here = slice(starts[lo], starts[hi] if hi < len(starts) else None)
                    total[lo:hi] = np.add.reduceat(vectors[k[here]] * times[here, None], starts[lo:hi] - starts[lo], axis=0)
                    lo = hi
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(d[starts])), pa.nulls(len(starts), pa.string()),
                                                  pa.array(np.add.reduceat(n[known] * many[k], starts)), _lists(total)], names=["_id", "w", "n", "total"])
            if not known.all():
                d, k = doc[~known], word[~known]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), said.dictionary.take(pa.array(k)).cast(pa.string()),
                                                  pa.array(n[~known]), pa.nulls(len(d), pa.list_(pa.float64()))], names=["_id", "w", "n", "total"])

    fields = [T.StructField("_id", schema[id_col].dataType), T.StructField("w", T.StringType()), T.StructField("n", T.DoubleType()),
              T.StructField("total", T.ArrayType(T.DoubleType()))]
    read = cut_lineage(tokens.select(F.col(id_col).alias("_id"), F.col(token_col).alias("w")).mapInArrow(run, T.StructType(fields)))
    given.unpersist()
    rest = looked_up(read.filter("w IS NOT NULL").select("w", "_id", "n"))
    rows = read.filter("w IS NULL").select("_id", "n", "total").unionByName(rest.select("_id", "n", "v", "norm"), allowMissingColumns=True)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kind = None, None  # the last document may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column("_id").type
            summed, plain = batch.column("total"), batch.column("v")
            is_sum = summed.is_valid().to_numpy(zero_copy_only=False)
            sums, vectors = summed.drop_null().flatten().to_numpy(), plain.drop_null().flatten().to_numpy()
            width = (len(sums) + len(vectors)) // len(is_sum)
            x, n = np.empty((len(is_sum), width)), batch.column("n").to_numpy()
            x[is_sum] = sums.reshape(-1, width)
            if not is_sum.all():
                x[~is_sum] = vectors.reshape(-1, width) * (n[~is_sum] / batch.column("norm").drop_null().to_numpy())[:, None]
            ids = batch.column("_id")
            code = ids.dictionary_encode("encode").indices.to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            own, total, mass = ids.take(pa.array(starts)).to_pylist(), np.add.reduceat(x, starts, axis=0), np.add.reduceat(n, starts)
            if last is not None and last[0] == own[0]:
                total[0] += last[1]
                mass[0] += last[2]
            elif last is not None:
                yield _means([last[0]], last[1][None], np.array([last[2]]), ids.type, id_col)
            last = own[-1], total[-1].copy(), mass[-1]
            if len(own) > 1:
                yield _means(own[:-1], total[:-1], mass[:-1], ids.type, id_col)
        if last is not None:
            yield _means([last[0]], last[1][None], np.array([last[2]]), kind, id_col)

    out = T.StructType([T.StructField(id_col, schema[id_col].dataType), T.StructField("sentence_vector", T.ArrayType(T.DoubleType()))])
    return rows.repartition("_id").sortWithinPartitions("_id").mapInArrow(add, out)


def _index(words: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(different words, place of each row's word among them)."""
    at, own = pd.factorize(words.to_numpy())
    return np.asarray(own, object), at


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _means(ids: list, total: np.ndarray, n: np.ndarray, kind: pa.DataType | None, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), _lists(total / n[:, None])], names=[name, "sentence_vector"])


def first_token_vector(df: DataFrame, col: str, word_vectors: DataFrame, id_col: str, stems: DataFrame | None = None,
                       term_col: str = "term", vec_col: str = "vector") -> DataFrame:
    """Vector of a field's first token, falling back to its stem's
    vector; rows with neither dropped."""
    first = df.select(id_col, F.lower(F.split(F.col(col), " ").getItem(0)).alias("tok"))
    wv = word_vectors.select(F.col(term_col).alias("tok"), F.col(vec_col).alias("v1"))
    j = first.join(wv, on="tok", how="left")
    if stems is not None:
        st = stems.select(F.col("form").alias("tok"), "stem")
        j = j.join(st, on="tok", how="left").join(
            word_vectors.select(F.col(term_col).alias("stem"), F.col(vec_col).alias("v2")), on="stem", how="left")
        v = F.coalesce("v1", "v2")
    else:
        v = F.col("v1")
    return j.select(id_col, "tok", v.alias("vector")).dropna(subset=["vector"])


def sequence_tensor(df: DataFrame, col: str, past: int, keys: Sequence[str], order_by: str) -> DataFrame:
    """Past × d tensor of the previous rows' vectors (per series)."""
    w = Window.partitionBy(*keys).orderBy(order_by).rowsBetween(-past, -1)
    res = df.withColumn("seq", F.collect_list(col).over(w))
    return res.filter(F.size("seq") == past)
