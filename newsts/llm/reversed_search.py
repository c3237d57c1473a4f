"""Ranked lexical search with the items as the index (operator 11).

The items are few and the documents are many, so the inverted index is built
over the terms of the items and broadcast, and the documents stream through
it.  One pass over the whole texts keeps, for each document, its length and
the counts of the terms that occur in items; grouped aggregation of these
gives the corpus statistics.  A second pass reads the kept counts: each term
of a document adds its part to the items in the term's posting list, and each
item has a heap of its best documents so far, bounded by ``top``.  At the end
of a task the heaps are its rows; they are merged in two levels.

The index holds at most a documented number of bytes of item texts; more items
are dealt into several indexes, each with its own passes.  An item is in one
index whatever its length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, columns, passing, store

TOP = 10
ITEM_BYTES = 16 << 20  # documented parameter: bytes of item texts in one broadcast index
CELLS = 1 << 21  # documented parameter: scores (documents x items), and postings, that a task works on at once

# bytes of terms: digits, letters (lower case) and all bytes of characters beyond ASCII
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


class ItemIndex:
    """Items as (number, item_id, text); ``vocabulary`` numbers their terms,
    and the postings of a term are the items that hold it and how often."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.item_ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        postings: list[list[tuple[int, int]]] = []
        for k, (_, text) in enumerate(items):
            for term, n in Counter(terms(text)).items():
                t = self.vocabulary.setdefault(term, len(postings))
                if t == len(postings):
                    postings.append([])
                postings[t].append((k, n))
        self.sizes = np.array([len(p) for p in postings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        flat = np.array([x for p in postings for x in p], np.int64).reshape(-1, 2)
        self.items, self.times = flat[:, 0].copy(), flat[:, 1].copy()


def term_counts(docs: DataFrame, index) -> DataFrame:
    """doc_id, n (terms of the document), term, tf: the counts of the terms of
    the index, for every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value.vocabulary.get
        for batch in bounded_batches(batches, "text"):
            ids, sizes, ends, found, times = [], [], [0], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = terms(text)
                if not words:
                    continue
                for word, n in Counter(words).items():
                    if (t := known(word)) is not None:
                        found.append(t)
                        times.append(n)
                ids.append(doc_id)
                sizes.append(len(words))
                ends.append(len(found))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(found, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(times, pa.int32()))], names=["doc_id", "n", "term", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


class Heaps:
    """The ``top`` best documents of each item: (score, -doc_id), so that of
    equal scores the smaller id is better; a null id is the last."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.heaps: list[list[tuple[int, float]]] = [[] for _ in range(n_items)]
        self.floor = np.ones(n_items, np.int64)  # the least score that can enter

    def offer(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """``scores``: documents x items."""
        for d, k in zip(*(x.tolist() for x in np.nonzero(scores >= self.floor)), strict=True):
            doc, heap = ids[d], self.heaps[k]
            entry = (int(scores[d, k]), -doc if doc is not None else -math.inf)
            if len(heap) < self.top:
                heappush(heap, entry)
            elif entry > heap[0]:
                heapreplace(heap, entry)
            if len(heap) == self.top:
                self.floor[k] = heap[0][0]


def blocks(work: np.ndarray, n_items: int) -> Iterator[tuple[int, int]]:
    """(first, past) runs of documents whose scores and postings (``work`` for
    each document) are at most CELLS, or of one document."""
    start, used, most = 0, 0, max(1, CELLS // n_items)
    for i, n in enumerate(work.tolist()):
        if i > start and (used + n > CELLS or i - start >= most):
            yield start, i
            start, used = i, 0
        used += n
    if len(work):
        yield start, len(work)


def scored(counts: DataFrame, index, weights, n_docs: int, n_terms: int, n_items: int, top: int) -> DataFrame:
    """part, item (its number), doc_id, score: each task's heaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, weight = index.value, weights.value
        heaps = Heaps(n_items, top)
        for batch in batches:
            sizes = batch.column("term").value_lengths().to_numpy()
            term = batch.column("term").flatten().to_numpy().astype(np.int64)
            tf = batch.column("tf").flatten().to_numpy().astype(np.int64)
            ids = batch.column("doc_id").to_pylist()
            m = 100 - 75 + (75 * batch.column("n").to_numpy() * n_docs) // n_terms
            gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes)))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            postings = np.concatenate([[0], np.cumsum(ix.sizes[term])])[ends]
            for a, b in blocks(np.diff(postings), n_items):
                here = slice(ends[a], ends[b])
                # every posting of every term: the cell of (document, item)
                long = ix.sizes[term[here]]
                at = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long - ix.starts[term[here]], long)
                doc = np.repeat(np.repeat(np.arange(b - a), sizes[a:b]), long)
                cells = np.zeros((b - a) * n_items, np.int64)
                np.add.at(cells, doc * n_items + ix.items[at], np.repeat(gain[here], long) * ix.times[at])
                heaps.offer(cells.reshape(b - a, n_items), ids[a:b])
        rows = [(k, None if d == -math.inf else -d, s) for k, heap in enumerate(heaps.heaps) for s, d in heap]
        number = TaskContext.get().partitionId()
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                names=["part", "item", "doc_id", "score"])

    return counts.mapInArrow(run, "part long, item long, doc_id long, score long")


def merged(heaps: DataFrame, top: int) -> DataFrame:
    """item, rank, doc_id, score: the heaps of all tasks merged, first those
    of about the square root of the tasks, then what they left."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    tasks = heaps.select(F.max("part")).first()[0] or 0
    groups = F.pmod("part", F.lit(math.isqrt(tasks) + 1))
    first = Window.partitionBy("item", "some").orderBy(*best)
    some = heaps.withColumn("some", groups).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    last = Window.partitionBy("item").orderBy(*best)
    return (some.select("item", "doc_id", "score").withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top)
            .select("item", "rank", "doc_id", "score"))


def reversed_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                    item_id_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` highest scoring documents of
    every item, equal scores by ascending doc_id (a null id last).

    Null and empty texts have no terms: such documents are in no result and
    not counted, such items have no rows.  Repeated documents are documents of
    their own; repeated items have their rows once for each repetition.
    Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    narrow = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    asked = columns(items, item_id=(item_id_col, "long"), text=(item_text_col, "string"))
    # dealt by content, so that an index is the same whenever its rows are read
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    parts = max(1, -(-int(size) // item_bytes))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        built = ItemIndex(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))
        if not built.vocabulary:
            continue
        index = spark.sparkContext.broadcast(built)
        with passing(spark) as keep:
            counts = store(term_counts(narrow, index), "term-counts")
            n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
            if not n_docs:
                continue
            weight = np.full(len(built.vocabulary), 0, np.int64)
            # one row for each term of the broadcast index
            for t, df in counts.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*")).collect():
                weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            heaps = keep(scored(counts, index, spark.sparkContext.broadcast(weight), n_docs, n_terms, len(rows), top), "heaps")
        names = spark.createDataFrame([(i, built.item_ids[i]) for i in range(len(rows))], "item long, item_id long")
        found = found.union(merged(heaps, top).join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return found
