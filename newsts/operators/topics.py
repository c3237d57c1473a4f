"""Topic models.

T11 fits topics on the edges (document, term, count) with documents and terms
as tables: no vocabulary is collected.  T12 uses Spark ML's distributed LDA on
vectors of fixed length.  T13/T14 (NMF, semantics-assisted NMF) run as alternating, column-wise updates where the documents stay
distributed: the factors of a document are solved where it is, and only the
term factor W — terms × k for a top-n vocabulary, so bounded — travels to
the executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, delete_tables, write_table
from .reduce import nonnegative_solve as nonnegative_weights
from .vectors import HOT_WORDS, token_blocks, word_counts

FLOOR = 1e-20


# T11 --------------------------------------------------------------------------
# documented parameters: pseudo-counts of a topic in a document and of a term
# in a topic, steps of the shares of one document, numbers of terms given to every
# task (terms x topics), rows of other terms summed before they leave a task, edges handled at once
TOPIC_PRIOR, TERM_PRIOR, INNER, DENSE, CELLS, EDGES = 0.25, 0.01, 30, 8_000_000, 200_000, 1 << 15


def term_edges(tokens: DataFrame, id_col: str = "doc_id", term_col: str = "term", split: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, terms), both stored: documents (rid, doc, ids, n) with the
    numbers of its terms in order and how often it holds each, terms (term_id, term), numbered
    from 0 by falling frequency.  ``term_col`` has one token a row, an array of them or, with ``split``, a
    text whose tokens stand between white space.

    The most frequent words, a bounded number, are numbered where the document
    is; only the counted tokens of all other words are joined with their numbers."""
    spark = tokens.sparkSession
    counts = word_counts(tokens, term_col, split)
    ordered, _ = write_table(counts.orderBy(F.col("n").desc(), "w").select(F.col("w").alias("term"), F.monotonically_increasing_id().alias("_at")))
    # numbers without gaps: the rows of all partitions before, one number for each partition
    part, sizes = F.shiftright("_at", 33), {}
    for r in sorted(ordered.groupBy(part.alias("part")).count().collect()):
        sizes[r["part"]] = r["count"]
    before = {p: sum(n for o, n in sizes.items() if o < p) for p in sizes}
    start = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])[part] if before else F.lit(0)
    terms = ordered.select((F.col("_at").bitwiseAND((1 << 33) - 1) + start).cast("int").alias("term_id"), "term")
    hot = terms.filter(F.col("term_id") < HOT_WORDS).orderBy("term_id").toArrow()  # bounded
    given = spark.sparkContext.broadcast(hot.column("term").to_numpy())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pd.Index(given.value, dtype=object)
        for ids, of, said in token_blocks(batches, "doc", "w", split):
            said = said.dictionary_encode()
            known = index.get_indexer(said.dictionary.to_numpy(zero_copy_only=False)) if len(index) else np.full(len(said.dictionary), -1)
            width = len(said.dictionary)
            cells, n = np.unique(of * width + said.indices.to_numpy(), return_counts=True)
            doc, word = cells // width, cells % width
            place = known[word]
            here = np.flatnonzero(place >= 0)
            here = here[np.lexsort((place[here], doc[here]))]
            if len(here):
                own, starts = np.unique(doc[here], return_index=True)
                yield _documents(ids.take(pa.array(own)), starts, place[here], n[here], pa.nulls(len(own), pa.string()))
            rest = np.flatnonzero(place < 0)
            if len(rest):
                yield _documents(ids.take(pa.array(doc[rest])), np.arange(len(rest)), np.full(len(rest), -1), n[rest],
                                 said.dictionary.take(pa.array(word[rest])).cast(pa.string()))

    kind = T.StructField("doc", tokens.schema[id_col].dataType)
    lists = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))]
    counted, path = write_table(tokens.select(F.col(id_col).alias("doc"), F.col(term_col).alias("w"))
                                .mapInArrow(count, T.StructType([kind, *lists, T.StructField("w", T.StringType())])))
    given.destroy()
    late = counted.filter("w IS NOT NULL").join(terms.withColumnRenamed("term", "w"), "w").select("doc", F.array("term_id").alias("ids"), "n")
    parts = counted.filter("w IS NULL").select("doc", "ids", "n").unionByName(late)
    whole = parts.repartition("doc").sortWithinPartitions("doc").mapInArrow(_merge, T.StructType([kind, *lists]))
    docs, _ = write_table(whole.select(F.monotonically_increasing_id().alias("rid"), "doc", "ids", "n"))
    del parts, late, whole, counted
    delete_tables(spark, path)
    return docs, terms


def _documents(docs: pa.Array, starts: np.ndarray, ids: np.ndarray, n: np.ndarray, *more: pa.Array) -> pa.RecordBatch:
    """Rows (doc, ids, n): document i has the edges from ``starts[i]`` on."""
    ends = pa.array(np.append(starts, len(ids)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (ids, n)]
    return pa.RecordBatch.from_arrays([docs, *lists, *more], names=["doc", "ids", "n", "w"][:3 + len(more)])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document, from rows sorted by document."""
    rest = None  # the last document may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        docs, lists = batch.column("doc"), batch.column("ids")
        code = docs.dictionary_encode("encode").indices.to_numpy()
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        of = np.repeat(np.cumsum(np.isin(np.arange(len(code)), first)) - 1, lists.value_lengths().to_numpy())
        ids, n, own = lists.flatten().to_numpy(), batch.column("n").flatten().to_numpy(), docs.take(pa.array(first))
        if rest is not None and rest[0].to_pylist() == own.slice(0, 1).to_pylist():
            of, ids, n = np.concatenate([np.zeros(len(rest[1]), int), of]), np.concatenate([rest[1], ids]), np.concatenate([rest[2], n])
        elif rest is not None:
            yield _documents(rest[0], np.array([0]), rest[1], rest[2])
        cells, at = np.unique(of.astype(np.int64) << 32 | ids, return_inverse=True)
        n, of, ids = np.bincount(at, n, len(cells)), cells >> 32, cells & 0xFFFFFFFF
        starts = np.searchsorted(of, np.arange(len(own)))
        rest = own.slice(len(own) - 1), ids[starts[-1]:], n[starts[-1]:]
        if len(own) > 1:
            yield _documents(own.slice(0, len(own) - 1), starts[:-1], ids[:starts[-1]], n[:starts[-1]])
    if rest is not None:
        yield _documents(rest[0], np.array([0]), rest[1], rest[2])


def shares(n: np.ndarray, phi: np.ndarray, starts: np.ndarray, prior: float = TOPIC_PRIOR, steps: int = INNER) -> np.ndarray:
    """Topic shares of documents (k x documents), by expectation-maximisation from equal
    shares: document i has the edges from ``starts[i]`` on, with counts ``n`` and the
    topic weights ``phi`` (k x edges) of their terms."""
    k, size = len(phi), np.diff(np.append(starts, len(n)))
    theta = np.full((k, len(starts)), 1.0 / k)
    for _ in range(steps if len(n) else 0):
        mass = np.einsum("ke,ke->e", np.repeat(theta, size, axis=1), phi)
        theta *= np.add.reduceat(phi * (n / np.maximum(mass, 1e-300)), starts, axis=1)
        theta += prior
        theta /= theta.sum(axis=0)
    return theta


def _dense(k: int) -> int:
    return DENSE // k


def _met(docs: DataFrame, weights: DataFrame, n_terms: int, k: int) -> tuple[DataFrame, np.ndarray]:
    """(documents with the weights of their rarer terms, ``late`` in the order
    of these terms; the weights of the frequent terms, a bounded number, k x terms)."""
    most = min(_dense(k), n_terms)
    top = weights.filter(F.col("term_id") < most).toArrow()  # bounded
    dense = np.zeros((k, most))
    dense[:, top.column("term_id").to_numpy()] = top.column("phi").combine_chunks().flatten().to_numpy().reshape(-1, k).T
    if n_terms <= most:
        return docs.select("doc", "ids", "n", F.lit(None).cast("array<double>").alias("late")), dense
    rare = docs.select("rid", F.explode(F.filter("ids", lambda x: x >= most)).alias("term_id"))
    late = rare.join(weights.filter(F.col("term_id") >= most), "term_id").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("term_id", "phi"))).alias("_s"))
    return docs.join(late, "rid", "left").select("doc", "ids", "n", F.flatten(F.col("_s.phi")).alias("late")), dense


def _edges(batches: Iterator[pa.RecordBatch], dense: np.ndarray) -> Iterator[tuple]:
    """(documents, their starts, term numbers, counts, weights k x edges) of
    some whole documents at a time."""
    k, most = dense.shape
    for batch in batches:
        ends = np.cumsum(batch.column("ids").value_lengths().to_numpy())
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + EDGES, "right")))
            part = batch.slice(lo, hi - lo)
            lists = part.column("ids")
            term, n = lists.flatten().to_numpy(), part.column("n").flatten().to_numpy().astype(float)
            p = np.empty((k, len(term)))
            known = term < most
            if known.all():
                p[:] = dense[:, term]
            else:
                p[:, known] = dense[:, term[known]]
                p[:, ~known] = part.column("late").drop_null().flatten().to_numpy().reshape(-1, k).T
            starts = np.cumsum(lists.value_lengths().to_numpy()) - lists.value_lengths().to_numpy()
            yield part.column("doc"), starts, term, n, p
            lo = hi


def _expect(docs: DataFrame, phi: DataFrame, n_terms: int, k: int) -> tuple[DataFrame, str]:
    """term_id, s0.. (expected counts of the term in each topic), stored, and their path; the
    row of term -1 holds the log likelihood and the log prior of the shares.

    The weights of the frequent terms are given to every task, where their
    sums are kept too; those of the other terms go to the documents that hold them."""
    s = [f"s{j}" for j in range(k)]
    at, dense = _met(docs, phi, n_terms, k)
    given = docs.sparkSession.sparkContext.broadcast(dense)

    def rows(ids: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), *[pa.array(x) for x in sums]], names=["term_id", *s])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = given.value
        sums, kept, held, total = np.zeros(weights.shape), [], 0, 0.0
        for _, starts, term, n, p in _edges(batches, weights):
            theta = shares(n, p, starts)
            r = np.repeat(theta, np.diff(np.append(starts, len(n))), axis=1)
            r *= p
            mass = np.maximum(r.sum(axis=0), 1e-300)
            total += float(n @ np.log(mass)) + TOPIC_PRIOR * float(np.log(theta).sum())
            r *= n / mass
            ids, of = np.unique(term, return_inverse=True)
            own = np.stack([np.bincount(of, x, len(ids)) for x in r])
            few = int(np.searchsorted(ids, sums.shape[1]))
            sums[:, ids[:few]] += own[:, :few]
            if few < len(ids):
                kept.append((ids[few:], own[:, few:]))
                held += len(ids) - few
            if held > CELLS:
                yield rows(np.concatenate([i for i, _ in kept]), np.concatenate([x for _, x in kept], axis=1))
                kept, held = [], 0
        if kept:
            yield rows(np.concatenate([i for i, _ in kept]), np.concatenate([x for _, x in kept], axis=1))
        some = np.flatnonzero(sums.any(axis=0))
        for lo in range(0, len(some), CELLS):
            yield rows(some[lo:lo + CELLS], sums[:, some[lo:lo + CELLS]])
        yield rows(np.array([-1]), np.array([[total if j == 0 else 0.0] for j in range(k)]))

    part = at.mapInArrow(run, "term_id int, " + ", ".join(f"{c} double" for c in s))
    found = write_table(part.groupBy("term_id").agg(*[F.sum(c).alias(c) for c in s]))
    given.destroy()
    return found


def lda_terms_fit(edges: DataFrame, terms: DataFrame, k: int = 4, seed: int = 42, max_iter: int = 10) -> tuple[DataFrame, list[float]]:
    """T11 fit: (terms with their weights ``phi`` in each topic, log posterior
    of each pass), over the stored tables of :func:`term_edges`.

    Expectation-maximisation for the most probable topics with Dirichlet
    pseudo-counts (declared instead of variational Bayes), ``max_iter`` passes
    over all documents.  The vocabulary is a table like the documents: expected
    counts are grouped sums by term, and what reaches the driver are the k totals and the
    weights of the ``DENSE`` most frequent terms.  A pass deletes the sums of the one before.
    """
    spark = terms.sparkSession
    # start: weights of their own for each term, from a hash of the term
    noise = [1.0 + F.pmod(F.xxhash64("term", F.lit(seed), F.lit(j)), F.lit(1 << 20)) / float(1 << 20) for j in range(k)]
    weights = terms.select("term_id", *[n.alias(f"s{j}") for j, n in enumerate(noise)])
    n_terms, losses, last = terms.count(), [], None
    phi = _normalised(weights, n_terms, k, 0.0)
    for _ in range(max_iter):
        found, path = _expect(edges, phi, n_terms, k)
        losses.append((found.filter("term_id = -1").agg(F.sum("s0")).first()[0] or 0.0) + _log_prior(phi, k))
        phi = _normalised(found.filter("term_id >= 0"), n_terms, k, TERM_PRIOR)
        delete_tables(spark, *([last] if last else []))
        last = path
    return phi.join(terms, "term_id").select("term_id", "term", "phi"), losses


def _normalised(sums: DataFrame, n_terms: int, k: int, prior: float) -> DataFrame:
    total = sums.agg(*[F.sum(f"s{j}") for j in range(k)]).first()
    share = [(F.col(f"s{j}") + prior) / ((total[j] or 0.0) + prior * n_terms) for j in range(k)]
    return sums.select("term_id", F.array(*share).alias("phi"))


def _log_prior(phi: DataFrame, k: int) -> float:
    logs = F.aggregate(F.transform("phi", lambda x: F.log(x)), F.lit(0.0), lambda s, x: s + x)
    return TERM_PRIOR * (phi.agg(F.sum(logs)).first()[0] or 0.0)


def lda_terms_apply(edges: DataFrame, phi: DataFrame, k: int = 4, id_col: str = "doc_id") -> DataFrame:
    """T11 apply: each term is scored once as a one-word document; a
    document's topics are the mean over its words (same result as scoring
    every word occurrence, with V instead of D·L transforms)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("phi").flatten().to_numpy().reshape(-1, k).T
            t = shares(np.ones(batch.num_rows), p, np.arange(batch.num_rows))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([batch.column("term_id"), pa.ListArray.from_arrays(ends, pa.array(t.T.ravel()))], names=["term_id", "phi"])

    scored, _ = write_table(phi.select("term_id", "phi").mapInArrow(score, "term_id int, phi array<double>"))
    at, dense = _met(edges, scored, scored.count(), k)
    given = edges.sparkSession.sparkContext.broadcast(dense)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, starts, _, n, t in _edges(batches, given.value):
            means = np.add.reduceat(t * n, starts, axis=1) / np.add.reduceat(n, starts)
            yield pa.RecordBatch.from_arrays([docs, *[pa.array(x) for x in means]], names=[id_col, *[f"Topic{j + 1}" for j in range(k)]])

    return at.mapInArrow(mean, T.StructType([T.StructField(id_col, edges.schema["doc"].dataType), *[T.StructField(f"Topic{j + 1}", T.DoubleType()) for j in range(k)]]))


# T12 --------------------------------------------------------------------------
# documented parameters: rows handled at once, change of a row's weights at which its inference ends
VECTORS, CHANGE = 2048, 1e-3


def _digamma(x: np.ndarray) -> np.ndarray:
    r = np.zeros_like(x)
    for i in range(6):
        r -= 1.0 / (x + i)
    x = x + 6.0
    f = 1.0 / (x * x)
    t = f * (-1 / 12 + f * (1 / 120 + f * (-1 / 252 + f * (1 / 240 + f * (-1 / 132 + f * (691 / 32760 + f * (-1 / 12 + f * 3617 / 8160)))))))
    return r + np.log(x) - 0.5 / x + t


def _trigamma(x: np.ndarray) -> np.ndarray:
    r = np.zeros_like(x)
    for i in range(6):
        r += 1.0 / (x + i) ** 2
    x = x + 6.0
    f = 1.0 / (x * x)
    return r + 1 / x + f / 2 + f / x * (1 / 6 + f * (-1 / 30 + f * (1 / 42 + f * (-1 / 30 + f * (5 / 66 - f * 691 / 2730)))))


def _expectation(x: np.ndarray) -> np.ndarray:
    """Expected logarithms of Dirichlet shares, row by row."""
    return _digamma(x) - _digamma(x.sum(axis=-1, keepdims=True))


def _theta(gamma: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """exp(digamma(gamma)) times ``scale`` for rows of few numbers, with one
    exponential and two divisions for each."""
    p = gamma * (gamma + 5.0)
    r = (gamma + gamma + 5.0) * ((3.0 * p + 20.0) * p + 24.0) / (p * (p + 4.0) * (p + 6.0))
    x = gamma + 6.0
    i = 1.0 / x
    f = i * i
    t = f * (-1 / 12 + f * (1 / 120 + f * (-1 / 252 + f * (1 / 240 + f * (-1 / 132 + f * (691 / 32760 + f * (-1 / 12 + f * 3617 / 8160)))))))
    return x * np.exp(t - 0.5 * i - r) * scale


def _infer(x: np.ndarray, beta: np.ndarray, alpha: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Topic weights of rows that are not all zero, by variational inference of
    ``VECTORS`` rows at once; rows that change by less than ``CHANGE`` give their places
    to the next."""
    # after one step the weights of a row sum to its own sum and that of the prior
    mass = np.exp(-_digamma(x.sum(axis=1) + alpha.sum()))[:, None]
    done, across = np.empty((len(x), len(alpha))), np.ascontiguousarray(beta.T)
    begin = np.exp(_expectation(start))
    new = 0
    at, going = np.empty(0, int), np.empty(0, bool)
    rows, scale, g, theta = x[:0], mass[:0], done[:0], done[:0]
    while True:
        if going.sum() <= 0.8 * len(at):  # rows that ended leave together
            at, rows, scale, g, theta = at[going], rows[going], scale[going], g[going], theta[going]
            some = np.arange(new, min(len(x), new + VECTORS - len(at)))
            new += len(some)
            at, rows, scale = np.concatenate([at, some]), np.concatenate([rows, x[some]]), np.concatenate([scale, mass[some]])
            g, theta = np.concatenate([g, np.tile(start, (len(some), 1))]), np.concatenate([theta, np.tile(begin, (len(some), 1))])
            if not len(at):
                break
            going, shared = np.ones(len(at), bool), np.empty(rows.shape)
        np.matmul(theta, across, out=shared)
        shared += 1e-100
        np.divide(rows, shared, out=shared)
        last, g = g, theta * (shared @ beta) + alpha
        theta = _theta(g, scale)
        ended = going & ~(np.abs(g - last).sum(axis=1) > CHANGE * len(alpha))
        if ended.any():
            done[at[ended]] = g[ended]
            going &= ~ended
    return done


def lda_vectors_fit(df: DataFrame, col: str, k: int = 5, seed: int = 42, max_iter: int = 10):
    """Fit on non-negative (min-max scaled) dense vectors: ``max_iter`` passes,
    each over all rows.

    The steps, samples and random starts are those of Spark ML's online LDA
    with all rows a pass, and its model comes back; a task infers many rows at once, where
    the library takes them one by one."""
    from pyspark.ml.clustering import LDA, LocalLDAModel
    from pyspark.ml.linalg import Vectors
    spark = df.sparkSession
    data = cut_lineage(df.select(F.col(col).cast("array<double>").alias("x")))
    first = data.first()
    if first is None:
        raise ValueError("no vectors to fit topics on")
    size = len(first["x"])
    lda = LDA(k=k, seed=seed, maxIter=max_iter, optimizer="online", subsamplingRate=1.0)
    # the library's random start, from no pass at all
    one = spark.createDataFrame([(Vectors.dense(np.ones(size)),)], ["features"])
    begun = lda.copy({lda.maxIter: 0}).fit(one)
    weights = begun.topicsMatrix().toArray().T.copy()
    alpha, eta = begun.estimatedDocConcentration().toArray().copy(), 1.0 / k
    jvm = spark._jvm
    draws = jvm.java.util.Random(seed)
    draws.nextLong()  # went into the weights
    for i in range(1, max_iter + 1):
        batch = data.sample(True, 1.0, draws.nextLong())
        own = draws.nextLong()
        beta = np.exp(_expectation(weights)).T
        stats, logs, n = _pass(batch, beta, alpha, [_start(jvm, own + p, k) for p in range(data.rdd.getNumPartitions())])
        if not n:
            continue
        rho = (lda.getLearningOffset() + i) ** -lda.getLearningDecay()
        weights = (1 - rho) * weights + rho * (stats * beta.T + eta)
        alpha = _concentration(alpha, logs / n, n, rho)
    return _model(spark, lda, weights, alpha, eta, draws.nextLong(), LocalLDAModel)


def _start(jvm, seed: int, k: int) -> np.ndarray:
    """Random weights with which the rows of one partition begin."""
    seed = (seed + (1 << 63)) % (1 << 64) - (1 << 63)
    basis = jvm.breeze.stats.distributions.RandBasis(jvm.org.apache.commons.math3.random.MersenneTwister(seed))
    gamma = jvm.breeze.stats.distributions.Gamma(100.0, 0.01, basis)
    return np.array([gamma.draw() for _ in range(k)])


def _pass(batch: DataFrame, beta: np.ndarray, alpha: np.ndarray, starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """(sums k x dimensions, sum of the expected log shares, rows that are not all zero)."""
    size, k = beta.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        start = starts[TaskContext.get().partitionId()]
        total = np.zeros(k * size + k + 1)
        for part in batches:
            lists = part.column("x")
            every = lists.flatten().to_numpy().reshape(part.num_rows, size)
            x = every[every.any(axis=1)]
            logs = _expectation(_infer(x, beta, alpha, start))
            theta = np.exp(logs)
            total += np.concatenate([(theta.T @ (x / (theta @ beta.T + 1e-100))).ravel(), logs.sum(axis=0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["total"])

    found = batch.mapInArrow(run, "total array<double>").toArrow().column("total")  # one row for each task
    total = found.combine_chunks().flatten().to_numpy().reshape(-1, k * size + k + 1).sum(axis=0)
    return total[:k * size].reshape(k, size), total[k * size:-1], float(total[-1])


def _concentration(alpha: np.ndarray, logs: np.ndarray, n: float, rho: float) -> np.ndarray:
    """One Newton step of the prior of the shares, kept positive."""
    grad = n * (logs - _expectation(alpha))
    c, q = n * float(_trigamma(alpha.sum(keepdims=True))[0]), -n * _trigamma(alpha)
    step = -(grad - (grad / q).sum() / (1.0 / c + (1.0 / q).sum())) / q
    return alpha + rho * step if (alpha + rho * step > 0).all() else alpha


def _model(spark, lda, weights: np.ndarray, alpha: np.ndarray, eta: float, seed: int, kind):
    """Spark ML's model with these topics and the parameters of the estimator."""
    jvm, (k, size) = spark._jvm, weights.shape

    def numbers(x: np.ndarray):
        out = spark.sparkContext._gateway.new_array(jvm.double, len(x))
        for i, v in enumerate(x.tolist()):
            out[i] = v
        return out

    linalg = jvm.org.apache.spark.mllib.linalg
    old = jvm.org.apache.spark.mllib.clustering.LocalLDAModel(
        linalg.DenseMatrix(size, k, numbers(weights.ravel())), linalg.DenseVector(numbers(alpha)), float(eta), 100.0)
    old.setSeed(seed)
    lda._transfer_params_to_java()
    made = jvm.org.apache.spark.ml.clustering.LocalLDAModel(lda.uid, size, old, spark._jsparkSession)
    lda._java_obj.copyValues(made, lda._java_obj.extractParamMap())
    return lda._copyValues(kind(made))


def lda_vectors_apply(df: DataFrame, col: str, lda, keep: Sequence[str] = ()) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    out = lda.transform(df.select(*keep, array_to_vector(col).alias("features")))
    t = vector_to_array("topicDistribution")
    return out.select(*keep, *[t[i].alias(f"Topic{i + 1}") for i in range(lda.getK())])


# T13 / T14 --------------------------------------------------------------------
def _side_product(S: DataFrame, M: np.ndarray, transposed: bool) -> np.ndarray:
    """S·M or Sᵀ·M for rows (i, cells of (j, ppmi)); terms x k numbers come back."""
    n, k = M.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, k))
        for batch in batches:
            lists = batch.column("cells")
            flat = lists.flatten()
            i = np.repeat(batch.column("i").to_numpy() - 1, lists.value_lengths().to_numpy())
            j, x = flat.field("j").to_numpy() - 1, flat.field("ppmi").to_numpy()
            to, of = (j, i) if transposed else (i, j)
            for c in range(k):
                total[:, c] += np.bincount(to, M[of, c] * x, n)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(total[some, j]) for j in range(k)]], names=["row", *[f"s{j}" for j in range(k)]])

    part = S.mapInArrow(run, "row long, " + ", ".join(f"s{j} double" for j in range(k)))
    found = part.groupBy("row").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toArrow()
    out = np.zeros((n, k))
    out[found.column("row").to_numpy()] = np.stack([found.column(f"s{j}").to_numpy() for j in range(k)], axis=1)
    return out


def _factor_pass(rows: DataFrame, W: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A·H, HᵀH) for the document factors that fit W best: each document's
    factor is found and used where the document is, sums leave the task."""
    n, k = W.shape
    given = rows.sparkSession.sparkContext.broadcast(W)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = given.value, np.zeros((n + k, k))
        for batch in batches:
            h, doc, term, a = _factors(batch, w)
            for j in range(k):
                total[:n, j] += np.bincount(term, h[doc, j] * a, n)
            total[n:] += h.T @ h
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(total[some, j]) for j in range(k)]], names=["row", *[f"s{j}" for j in range(k)]])

    part = rows.select("terms").mapInArrow(run, "row long, " + ", ".join(f"s{j} double" for j in range(k)))
    found = part.groupBy("row").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toArrow()  # terms + k rows
    out = np.zeros((n + k, k))
    out[found.column("row").to_numpy()] = np.stack([found.column(f"s{j}").to_numpy() for j in range(k)], axis=1)
    given.unpersist()
    return out[:n], out[n:]


def _factors(batch: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(factors of the documents; document, term and count of each edge)."""
    lists = batch.column("terms")
    flat = lists.flatten()
    term, a = flat.field("term_id").to_numpy() - 1, flat.field("a").to_numpy()
    doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
    fit = np.stack([np.bincount(doc, w[term, j] * a, batch.num_rows) for j in range(w.shape[1])], axis=1)
    return np.maximum(FLOOR, nonnegative_weights(fit, w.T @ w)), doc, term, a


def nmf_fit(doc_term: DataFrame, n_terms: int, k: int = 4, iters: int = 500, tol: float = 1e-4, seed: int = 0,
            ppmi: DataFrame | None = None, alpha: float = 0.1, id_col: str = "doc_id") -> tuple[np.ndarray, DataFrame, list]:
    """A ≈ W·Hᵀ with A the term×document counts (edge table
    (doc, term_id, tf)), by column updates with a floor, unit-norm W
    columns, stopping when the relative loss gain falls below ``tol``.
    With ``ppmi`` (edges (i, j, ppmi)) and ``alpha`` > 0 the W step also
    fits S ≈ W·Wcᵀ (semantics-assisted NMF; the sparsity term is used
    with β = 0 as in the published run).  A pass reads the documents once: their factors are solved
    from W where they are, and only sums of terms x k numbers are grouped.
    Returns (W, H, losses), H being the factors of the last loss."""
    rng = np.random.default_rng(seed)
    W = rng.random((n_terms, k))
    W /= np.linalg.norm(W, axis=0, keepdims=True)
    Wc = rng.random((n_terms, k)) if ppmi is not None else None
    # one row for each document, with its own terms: made once, read in every pass
    edge = F.struct("term_id", F.col("tf").cast("double").alias("a"))
    A = cut_lineage(doc_term.groupBy(id_col).agg(F.collect_list(edge).alias("terms")))
    square = F.aggregate("terms", F.lit(0.0), lambda s, x: s + x["a"] * x["a"])
    a2 = A.agg(F.sum(square)).first()[0] or 0.0
    s2 = 0.0
    if ppmi is not None and alpha > 0:
        # one row for each term of the bounded vocabulary: made once, read twice in every pass
        cell = F.struct(F.col("j").cast("long").alias("j"), "ppmi")
        S = cut_lineage(ppmi.groupBy(F.col("i").cast("long").alias("i")).agg(F.collect_list(cell).alias("cells")))
        s2 = S.agg(F.sum(F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["ppmi"] * x["ppmi"]))).first()[0]
    losses: list[float] = []
    before = W.copy()
    for _ in range(iters):
        before = W.copy()
        AHm, HtH = _factor_pass(A, W)
        if ppmi is not None and alpha > 0:
            SWc = _side_product(S, Wc, False)
            WcWc = Wc.T @ Wc
        for j in range(k):
            num = W[:, j] * HtH[j, j] + AHm[:, j] - W @ HtH[:, j]
            den = HtH[j, j]
            if ppmi is not None and alpha > 0:
                num = num + alpha * (W[:, j] * WcWc[j, j] + SWc[:, j] - W @ WcWc[:, j])
                den = den + alpha * WcWc[j, j]
            W[:, j] = np.maximum(FLOOR, num / den)
            W[:, j] /= max(np.linalg.norm(W[:, j]), FLOOR)
        if ppmi is not None and alpha > 0:
            WtW2 = W.T @ W
            StW = _side_product(S, W, True)
            for j in range(k):
                Wc[:, j] = np.maximum(FLOOR, Wc[:, j] + (StW[:, j] - Wc @ WtW2[:, j]) / WtW2[j, j])
        loss = float(a2 - 2.0 * np.sum(W * AHm) + np.sum((W.T @ W) * HtH))
        if ppmi is not None and alpha > 0:  # + alpha·‖S − W·Wcᵀ‖² over all cells
            loss += alpha * float(s2 - 2.0 * np.sum(Wc * StW) + np.sum((W.T @ W) * (Wc.T @ Wc)))
        losses.append(loss)
        if len(losses) > 1 and abs(losses[-2] - losses[-1]) <= tol * max(abs(losses[-2]), 1.0):
            break

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _factors(batch, before)[0]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(list(h), pa.list_(pa.float64()))], names=[id_col, "h"])

    schema = T.StructType([A.schema[id_col], T.StructField("h", T.ArrayType(T.DoubleType()))])
    return W, A.mapInArrow(factors, schema), losses
