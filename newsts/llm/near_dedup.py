"""Near-duplicates by ProbMinHash (operator 2).

A document is the multiset of its five-word shingles.  Each distinct shingle
with weight w (its count) is a Poisson process of rate w: its arrivals fall
into registers at random, and a register keeps the shingle that arrives first.
Two documents agree in a register with the probability of their probability
Jaccard similarity.  Shingles whose next arrival comes after the latest
register of the document is filled stop early.

Documents with equal word sequences are one representative before anything
else.  Bands of registers are the bucket keys.  The members of a bucket are
compared with a few leaders: those that share their buckets with most others,
so the original of many copies leads wherever it is.  The members of buckets
that are still of several classes then meet by their rare shingles.

With p and q the weights of two documents divided by their sums, and the
shingles in one order from rare to common, let a and b be the masses before
the first common shingle.  These have no partner, and so the similarity is at
most (1 - a)(1 - b) / (1 - ab).  A pair of the wanted similarity therefore has
a common shingle where this bound is kept, which both documents have within
their first 1 - similarity of mass, and one of them even earlier.  The members
are joined on these shingles under this bound, so no link is lost, and members
that can never join, such as different texts around one passage, form no pair.
Copies that were changed in different places differ in common shingles too: a
bit for each cell of the shingles' numbers tells shingles that the other text
lacks for certain, which gives a and b anew for the same bound.

Pairs whose registers agree far too little are left out, the others are
verified on their whole texts, and the verified links give the classes as
connected components, computed by Spark joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, numbered, passing, spread_join, store
from .shingles import WordHashes, mix, probability_jaccard, weighted

WIDTH, SIMILARITY = 5, 0.8
# documented parameters: at similarity 0.8 a pair shares a band with
# probability 1 - (1 - 0.8^5)^20 = 0.9996, and more above it
BANDS, ROWS = 20, 5
# pairs that agree in fewer than this share of the registers are not verified:
# five standard deviations below 0.8 for 100 registers (a chance of 3e-7)
LEAST_AGREEMENT = 0.6
LEADERS = 4  # leaders of a bucket
STEP_BYTES = 3 << 20  # documented parameter: bytes of text sketched or verified at once, or one text
MEMBERS = 512  # members of a leader verified by one group; larger groups are salted
# documented parameter: counters of the sketch that orders shingles from rare
# to common, 8 bytes each.  Any order gives the same links; the sketch makes
# the common ones late
COUNTERS = 1 << 18
LONGS = 16  # documented parameter: 64-bit words of the cells of a text; more cells tell more of longer texts apart
MEETING = 4096  # rows of one shingle joined by one group; larger groups are salted


def prob_min_hash(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """n_docs x registers: the shingle that arrives first in each register (0
    for a document without shingles)."""
    latest = np.full(n_docs * registers, np.inf)
    first = np.zeros(n_docs * registers, np.uint64)
    t, arrival = np.zeros(len(value)), 0
    while len(value):
        arrival += 1
        u = mix(value + np.uint64(arrival * 0x9E3779B97F4A7C15 % (1 << 64)))
        # 53 random bits for the waiting time, the others for the register
        t = t - np.log1p(-((u >> np.uint64(11)).astype(np.float64) * 2.0 ** -53)) / weight
        at = doc * registers + (mix(u) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(latest, at, t)
        won = t == latest[at]
        first[at[won]] = value[won]
        stop = latest.reshape(n_docs, registers).max(axis=1)
        on = t < stop[doc]
        doc, value, weight, t = doc[on], value[on], weight[on], t[on]
    return first.reshape(n_docs, registers)


def band_keys(first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n_docs x bands: one number for the registers of each band."""
    keys = np.empty((len(first), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(first), b + 1, np.uint64)
        for r in range(rows):
            k = mix(k * np.uint64(0x9E3779B97F4A7C15) + first[:, b * rows + r])
        keys[:, b] = k
    return keys


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """rid, doc_id, words (digest of the word sequence; null without words),
    keys (one per band), registers (32 bits of each)."""

    def lists(x: np.ndarray, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.view(kind).ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in bounded_batches(batches, "text", STEP_BYTES):
            words = [hashes(x) for x in batch.column("text").to_pylist()]
            doc, value, weight = weighted(words, WIDTH)
            first = prob_min_hash(doc, value, weight, len(words), bands * rows)
            digest = [xxhash.xxh3_128_digest(w) if w else None for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), pa.array(digest, pa.binary()),
                 lists(band_keys(first, bands, rows), np.int64), lists(first.astype(np.uint32), np.int32)],
                names=["rid", "doc_id", "words", "keys", "registers"])

    return docs.select("rid", "doc_id", "text").mapInArrow(
        run, "rid long, doc_id long, words binary, keys array<long>, registers array<int>")


def one_way(pairs: DataFrame) -> DataFrame:
    """Each unordered pair (a, b) once; a stays first where it ever is."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    each = pairs.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.max(F.col("a") < F.col("b")).alias("up"))
    return each.select(F.when(F.col("up"), F.col("lo")).otherwise(F.col("hi")).alias("a"),
                       F.when(F.col("up"), F.col("hi")).otherwise(F.col("lo")).alias("b"))


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in enough registers."""
    a = reps.select(F.col("rep").alias("a"), F.col("registers").alias("ra"))
    b = reps.select(F.col("rep").alias("b"), F.col("registers").alias("rb"))
    agree = F.size(F.filter(F.zip_with("ra", "rb", lambda x, y: x == y), lambda same: same))
    # the original of many copies stands first in many pairs, of two numbers
    # each: adaptive execution splits them where they are many
    return pairs.join(a, "a").join(b, "b").filter(agree >= LEAST_AGREEMENT * F.size("ra")).select("a", "b")


def verify(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts are at least ``similarity`` alike.

    The rows of a leader ``a`` are dealt in salted groups of bounded size,
    each with its own copy of the leader's text; a task reads the rows in
    order and holds one leader's shingles.
    """
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salts = F.floor(F.col("n") / MEMBERS).cast("int") + 1
    members = (pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"), F.col("b").alias("rid")))
    leaders = sizes.select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("a").alias("rid"))
    texts = (docs.select("rid", "text").hint("merge").join(members.unionByName(leaders), "rid")
             .select("a", "salt", "rid", "text", (F.col("a") != F.col("rid")).alias("member")))
    groups = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, leader, own = WordHashes(), None, None
        for batch in bounded_batches(batches, "text", STEP_BYTES):
            _, a, rid, text = (batch.column(c).to_pylist() for c in ("salt", "a", "rid", "text"))
            doc, value, weight = weighted([hashes(x) for x in text], WIDTH)
            order = np.lexsort((value, doc))
            doc, value, weight = doc[order], value[order], weight[order]
            ends = np.searchsorted(doc, np.arange(len(text) + 1))
            good = []
            for k in range(len(text)):
                this = value[ends[k]:ends[k + 1]], weight[ends[k]:ends[k + 1]]
                if a[k] == rid[k]:
                    leader, own = a[k], this
                elif leader == a[k] and probability_jaccard(own, this) >= similarity - 1e-9:
                    good.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good], pa.int64()),
                                              pa.array([rid[k] for k in good], pa.int64())], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label: one node of each connected component stands for it, for
    every node of a link (a, b).

    The nodes of a round are ordered by a hash salted with the round, so long
    chains of rising numbers are as short as any.  Every node takes its lowest
    neighbour as its parent, if that is lower, and then its parent's parent;
    the links shrink to links between different parents, until none is left.
    The rounds grow with the logarithm of the nodes, and the tables of parents
    shrink from round to round; in the end they are followed from the first on.
    """
    edges = store(links.select(F.col("a").alias("x"), F.col("b").alias("y"))
                  .union(links.select("b", "a")).filter("x <> y").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(rounds) + 1

        def place(c: str, turn: int = turn):
            return F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id"))

        hooked = edges.groupBy("x").agg(F.min(place("y")).alias("low")).select("x", F.least("low", place("x"))["id"].alias("parent"))
        above = hooked.select(F.col("x").alias("parent"), F.col("parent").alias("above"))
        parents = store(hooked.join(above, "parent").select("x", F.col("above").alias("parent")), "parents")
        rounds.append(parents)
        left = edges.join(parents.withColumnRenamed("parent", "px"), "x").select("px", "y")
        other = parents.select(F.col("x").alias("y"), F.col("parent").alias("py"))
        edges = store(left.distinct().join(other, "y").filter("px <> py")
                      .select(F.col("px").alias("x"), F.col("py").alias("y")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("label"))
    labels = rounds.pop().select(F.col("x").alias("node"), F.col("parent").alias("label"))
    while rounds:
        later = labels.select(F.col("node").alias("parent"), F.col("label"))
        labels = rounds.pop().join(later, "parent", "left").select(F.col("x").alias("node"), F.coalesce("label", "parent").alias("label"))
    return labels


def joined(labels: DataFrame, pairs: DataFrame, reps: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The labels (node, label; a stored table) with the classes of every pair
    (a, b) that is verified made one."""
    with passing(labels.sparkSession) as keep:
        links = verify(store(likely(one_way(pairs), reps), "likely"), texts, similarity)
        a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in ("a", "b"))
        between = links.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        parts = components(between).select(F.col("node").alias("label"), F.col("label").alias("least"))
        return keep(labels.join(parts, "label", "left").select("node", F.coalesce("least", "label").alias("label")), "labels")


def common_first(texts: DataFrame) -> np.ndarray:
    """Counts of the shingles of all texts by ``shingle % COUNTERS``: a table
    of fixed size, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(COUNTERS, np.int64)
        for batch in bounded_batches(batches, "text"):
            _, value, _ = weighted([hashes(x) for x in batch.column("text").to_pylist()], WIDTH)
            total += np.bincount((value % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    counted = texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(COUNTERS, np.int64)
    found = counted.toArrow()
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def prefixes(texts: DataFrame, similarity: float) -> DataFrame:
    """rep, label, shingle, before: the first shingles of each text from rare
    to common, up to 1 - similarity of its mass, with the mass before each;
    and of each text its ``cells`` (bits) and ``least``, the mass of its
    lightest shingle."""
    counts = texts.sparkSession.sparkContext.broadcast(common_first(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in bounded_batches(batches, "text"):
            doc, value, weight = weighted([hashes(x) for x in batch.column("text").to_pylist()], WIDTH)
            order = np.lexsort((value, counts.value[(value % np.uint64(COUNTERS)).astype(np.int64)], doc))
            doc, value, weight = doc[order], value[order], weight[order]
            mass = np.bincount(doc, weight, batch.num_rows)
            upto = np.cumsum(weight) - weight
            first = np.searchsorted(doc, np.arange(batch.num_rows))
            before = (upto - upto[np.minimum(first, max(0, len(upto) - 1))][doc]) / mass[doc] if len(doc) else upto
            lightest = np.full(batch.num_rows, np.inf)
            np.minimum.at(lightest, doc, weight)
            cells = np.zeros((batch.num_rows, 64 * LONGS), bool)
            cells[doc, (value >> np.uint64(32)).astype(np.int64) % (64 * LONGS)] = True
            cells = np.packbits(cells, axis=1, bitorder="little").view("<i8")
            kept = before <= 1 - similarity + 1e-9
            of = pa.array(doc[kept], pa.int64())
            many = pa.array(np.arange(int(kept.sum()) + 1) * LONGS, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid").take(of), batch.column("label").take(of), pa.array(value[kept].view(np.int64)), pa.array(before[kept]),
                 pa.ListArray.from_arrays(many, pa.array(cells[doc[kept]].ravel())), pa.array((lightest / mass)[doc[kept]])],
                names=["rep", "label", "shingle", "before", "cells", "least"])

    return texts.select("rid", "label", "text").mapInArrow(
        run, "rep long, label long, shingle long, before double, cells array<long>, least double")


def meeting(first: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different labels whose similarity the bound allows.

    Of the rows of a shingle those of the most frequent label meet the others
    only, never each other; at least one of a pair has the shingle within
    ``short`` of its mass.
    """
    short = (1 - similarity) / (1 + similarity) + 1e-9
    parts = first.groupBy("shingle", "label").agg(F.count("*").alias("n"), F.min("before").alias("least"))
    groups = (parts.groupBy("shingle").agg(F.count("*").alias("labels"), F.sum("n").alias("rows"), F.min("least").alias("least"),
                                           F.max_by("label", F.struct("n", "label")).alias("major"))
              .filter((F.col("labels") > 1) & (F.col("least") <= short))
              .select("shingle", "major", (F.floor(F.col("rows") / MEETING) + 1).alias("salts")))
    rows = store(first.join(groups, "shingle").withColumn("early", F.col("before") <= short), "meeting")
    # an early row meets all, a late one early ones
    left = (rows.filter("label <> major").select("shingle", F.col("early").alias("any"), F.col("rep").alias("x"), F.col("label").alias("lx"),
                                                 F.col("before").alias("bx"), F.col("cells").alias("cx"), F.col("least").alias("wx"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")))
    turns = F.when(F.col("early"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    right = rows.select("shingle", F.explode(turns).alias("any"), F.col("rep").alias("y"), F.col("label").alias("ly"), F.col("before").alias("by"),
                        F.col("cells").alias("cy"), F.col("least").alias("wy"),
                        F.pmod(F.xxhash64("rep"), F.col("salts")).alias("salt"))

    def can(a, b):
        return (1 - a) * (1 - b) >= (similarity - 1e-9) * (1 - a * b)

    def lacking(a, b):  # cells of a that b has not
        return reduce(add, [F.bit_count(a[i].bitwiseAND(F.bitwise_not(b[i]))) for i in range(LONGS)])

    x, y = F.col("cx"), F.col("cy")
    possible = ((F.col("lx") != F.col("ly")) & can(F.col("bx"), F.col("by"))
                & can(lacking(x, y) * F.col("wx"), lacking(y, x) * F.col("wy")))
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("shingle", "any", "salt")]
    return (left.alias("l").join(right.alias("r"), [*on, possible])
            .select(F.col("x").alias("a"), F.col("y").alias("b")))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """rid, doc_id, label: ``label`` is the rid of one row of the class.
    ``docs`` (rid, doc_id, text) should be a stored table."""
    table = store(sketches(docs, bands, rows), "sketches")
    reps = store(table.filter("words IS NOT NULL").groupBy("words")
                 .agg(F.min("rid").alias("rep"), F.first("keys").alias("keys"), F.first("registers").alias("registers")), "reps")
    members = reps.select("rep", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # meets: members of all buckets of a document; at most one row for each band
    members = store(members.join(shared, "key").groupBy("rep").agg(F.sum("n").alias("meets"), F.collect_list("key").alias("keys"))
                    .select("rep", "meets", F.explode("keys").alias("key")), "members")
    # texts meet ids by a merge join at every size, as the ids have no bound
    labels = store(members.select(F.col("rep").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    texts = store(docs.select("rid", "text").hint("merge").join(labels.select(F.col("node").alias("rid")), "rid"), "texts")
    chosen = Window.partitionBy("key").orderBy(F.desc("meets"), "rep")
    lead = members.withColumn("k", F.row_number().over(chosen)).filter(F.col("k") <= LEADERS).select("key", F.col("rep").alias("lead"))
    pairs = members.join(lead, "key").filter("lead <> rep").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    labels = joined(labels, pairs, reps, texts, similarity)
    # members of buckets that still hold several classes
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep")
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo <> hi AND n > 2")
    waiting = store(named.join(mixed.select("key"), "key", "left_semi").select("rep", "label").distinct(), "waiting")
    if not waiting.isEmpty():
        with passing(docs.sparkSession) as keep:
            apart = store(texts.hint("merge").join(waiting.select(F.col("rep").alias("rid"), "label"), "rid"), "apart")
            met = keep(meeting(store(prefixes(apart, similarity), "prefixes"), similarity), "met")
        labels = joined(labels, met, reps, texts, similarity)
    classes = reps.select("words", "rep").join(labels, F.col("rep") == F.col("node"), "left")
    classes = classes.select("words", F.coalesce("label", "rep").alias("label"))
    return (table.select("rid", "doc_id", "words").join(classes, "words", "left")
            .select("rid", "doc_id", F.coalesce("label", "rid").alias("label")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
               bands: int = BANDS, rows: int = ROWS, row_col: str | None = None) -> DataFrame:
    """rid, doc_id, class_id, class_size, kept: one row per input row.

    ``class_id`` is the smallest doc_id of the class, whose row ``kept``
    marks; with equal or null ids the first row stays.  A text without words
    (or null) is alone in its class.  Repeated rows are one class.
    """
    with passing(docs.sparkSession) as keep:
        narrow = numbered(docs, row_col, doc_id=(id_col, "long"), text=(text_col, "string"))
        named = keep(near_classes(narrow, similarity, bands, rows), "classes")
    best = F.max(F.struct((-F.col("doc_id")).alias("d"), (-F.col("rid")).alias("r"))).alias("best")
    classes = (named.groupBy("label").agg(best, F.count("*").alias("class_size"))
               .select("label", "class_size", (-F.col("best.d")).alias("class_id"), (-F.col("best.r")).alias("keep")))
    return (spread_join(named, store(classes, "sizes"), "label", "rid")
            .select("rid", "doc_id", "class_id", "class_size", (F.col("rid") == F.col("keep")).alias("kept")))
