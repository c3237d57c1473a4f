"""Removal of repeated passages by a distributed merge sort of suffixes
(operator 8).

A byte goes when a ``LENGTH``-byte string that covers it also starts earlier:
in a smaller doc_id, or earlier in the same document.

1. Every task marks the anchors of its texts (see ``suffixes``) and sends
   their gram numbers to buckets; a gram that repeats within the batch is sent
   once.  Anchors of grams that occur once in the corpus decide nothing and
   end here.
2. The suffixes at the other anchors, with the bytes before them, are sorted
   within each batch.  Equal ones stay, as the windows around all but the
   first of them are known to repeat; the others leave as front-coded sorted
   runs, one for each bucket.
3. A bucket merges its runs with a loser tree that never compares a known
   common prefix again.  Equal neighbours (full common prefix) repeat as a
   whole; of different neighbours that share the gram, the windows around the
   anchor are compared one by one.
4. A gram of very many contexts is *hot*: at the edges of a passage that
   millions of documents share, its contexts are nearly all different.  They
   are not sorted in one task: each batch sends, of every window around its
   hot anchors, the earliest occurrence, and Spark groups these by the
   window's bytes.
5. The spans of each document are joined to its text and cut out.

Everything that moves is bounded by the text.  The number of buckets follows
the number of anchors, so a bucket holds a bounded share besides the contexts
of one gram, of which there are fewer than a hot gram's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffixes as S
from .common import bounded_batches, numbered, passing, spread_join, store

# documented parameters
CHUNK = 1 << 18  # bytes hashed at once
LAST = (1 << 63) - 1  # stands for a null doc_id, which comes last
BUCKET = 200_000  # anchors in a bucket, about
HOT, HOT_GRAMS = 100_000, 1_000_000  # contexts of a hot gram; hot grams broadcast, at most (8 bytes each)


def _buckets(df: DataFrame, anchors: int) -> int:
    """More buckets than partitions, so that none is large."""
    return max(4 * max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))), -(-anchors // BUCKET))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK or k == len(texts) - 1:
            yield start, k + 1
            start, held = k + 1, 0


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _split(bucket: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Arrays cut where the sorted bucket numbers change, as bytes."""
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    cuts = [*at.tolist(), len(bucket)]
    return bucket[at], [[a[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)] for a in arrays]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of one bucket after the other, from a partition sorted by bucket."""
    bucket, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                if rows:
                    yield bucket, rows
                bucket, rows = row["bucket"], []
            rows.append(row)
    if rows:
        yield bucket, rows


def _join(rows: list[dict], name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), kind)


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """rid, pos: anchors whose gram occurs at two or more of them; rows with a
    ``gram`` instead name one of more than ``HOT`` contexts, as the batches
    count different ones, ``pos`` how many."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, hot_from = _buckets(docs, size // 35), HOT

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text"):
            texts, rids = _bytes(batch), batch.column("rid").to_numpy()
            grams, around, of, at = [], [], [], []
            for lo, hi in _chunks(texts):
                data = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
                ends = np.cumsum([len(x) for x in texts[lo:hi]])
                starts = np.concatenate([[0], ends[:-1]])
                found, context = S.anchors(data, starts, ends)
                around.append(context)
                doc = np.searchsorted(ends, found, "right")
                grams.append(S.gram_ids(data, found))
                of.append(rids[lo + doc])
                at.append(found - starts[doc])
            gram, rid, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, of, at))
            gram, context = gram.astype(np.uint64), np.concatenate(around) if around else np.zeros(0, np.uint64)
            order = np.lexsort((context, gram))
            gram, context, rid, pos = gram[order], context[order], rid[order], pos[order].astype(np.int32)
            new = np.concatenate([[True], gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, bool)
            alone = new & np.append(new[1:], True) if len(gram) else new
            # known to repeat: they pass the exchange in buckets of their own
            known = ~alone
            yield _anchor_rows(-1 - (rid[known] % buckets), rid[known], pos[known], np.zeros(0, np.uint64), known=True)
            # one of each gram; -1 - the contexts where the batch has already decided its anchors
            other = new.copy()
            other[1:] |= context[1:] != context[:-1]
            times = np.add.reduceat(other, np.flatnonzero(new), dtype=np.int64) if len(gram) else np.zeros(0, np.int64)
            rid = np.where(alone[new], rid[new], -1 - times)
            yield _anchor_rows((gram[new] % np.uint64(buckets)).astype(np.int64), rid, pos[new], gram[new], known=False)

    def _anchor_rows(bucket, rid, pos, gram, known) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        arrays = [rid[order], pos[order]] + ([] if known else [gram[order]])
        b, parts = _split(bucket[order], *arrays)
        parts = parts if not known else [*parts, [b""] * len(b)]
        return pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32), pa.int32()), *[pa.array(p, pa.binary()) for p in parts]],
                                          names=["bucket", "rid", "pos", "gram"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            rid, pos = _join(rows, "rid", "<i8"), _join(rows, "pos", "<i4")
            if bucket >= 0:
                gram = _join(rows, "gram", "<u8")
                order = np.argsort(gram, kind="stable")
                gram, rid, pos = gram[order], rid[order], pos[order]
                same = gram[1:] == gram[:-1]
                again = np.append(same, False) | np.concatenate([[False], same]) if len(gram) else np.zeros(0, bool)
                starts = np.flatnonzero(np.concatenate([[True], ~same])) if len(gram) else np.zeros(0, np.int64)
                total = np.add.reduceat(np.where(rid < 0, -1 - rid, 1), starts) if len(gram) else starts
                many = total > hot_from
                yield _found(np.full(many.sum(), -1), np.minimum(total[many], (1 << 31) - 1), gram[starts[many]].view(np.int64))
                again &= rid >= 0
                rid, pos = rid[again], pos[again]
            yield _found(rid, pos)

    def _found(rid, pos, gram=None) -> pa.RecordBatch:
        gram = pa.nulls(len(rid), pa.int64()) if gram is None else pa.array(gram, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(pos, pa.int32()), gram], names=["rid", "pos", "gram"])

    sent = docs.select("rid", "text").mapInArrow(mark, "bucket int, rid binary, pos binary, gram binary")
    return (sent.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(decide, "rid long, pos int, gram long"))


def _first_of_equal(run: np.ndarray, doc: np.ndarray, rid: np.ndarray, pos: np.ndarray):
    """Order of the contexts (equal ones by occurrence) and whether each is
    the first of its equals."""
    order = np.lexsort((pos, rid, doc))
    order = order[np.argsort(run[order], kind="stable")]
    key = run[order]
    return order, np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)


def _whole(rows: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes covered by all windows around the anchors; a context always has one."""
    before, after = S.reaches(rows)
    return pos - before, pos + np.minimum(after, S.LENGTH)


def hot_grams(found: DataFrame) -> np.ndarray:
    """The hot grams, sorted; the most frequent ``HOT_GRAMS`` of them, which a
    passage in a third of all texts is among."""
    rows = found.filter("gram IS NOT NULL").orderBy(F.desc("pos"), "gram").limit(HOT_GRAMS).select("gram").toArrow()
    return np.sort(rows.column("gram").to_numpy().astype(np.int64).view(np.uint64))


def hot_spans(sent: DataFrame) -> DataFrame:
    """rid, lo, hi of the windows (window, doc, rid, start) that also start
    earlier: all but the earliest of each."""
    place = F.struct("doc", "rid", "start")
    least = store(sent.groupBy("window").agg(F.min(place).alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"), "earliest")
    later = spread_join(sent, least, "window", "rid").filter(F.col("least").isNotNull() & (place > F.col("least")))
    return later.select("rid", F.col("start").alias("lo"), (F.col("start") + S.LENGTH).alias("hi"))


def repeated_spans(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """rid, lo, hi: spans of bytes that repeat earlier ones; they may overlap."""
    found = anchors.filter("gram IS NULL")
    buckets, hot = _buckets(docs, found.count()), docs.sparkSession.sparkContext.broadcast(hot_grams(anchors))
    lists = found.groupBy("rid").agg(F.collect_list("pos").alias("pos"))  # at most one for each byte of a text
    texts = docs.join(lists, "rid").select("rid", F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text", "pos")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text", 2 << 20):
            texts, at = _bytes(batch), [np.sort(np.array(x, np.int64)) for x in batch.column("pos").to_pylist()]
            n = [len(x) for x in at]
            rid, doc = (np.repeat(batch.column(c).to_numpy(), n) for c in ("rid", "doc_id"))
            pos = np.concatenate(at)
            rows = np.concatenate([S.contexts(t, x) for t, x in zip(texts, at, strict=True)])
            order, first = _first_of_equal(np.ascontiguousarray(rows).view(f"S{S.WIDTH}").ravel(), doc, rid, pos)
            rows, rid, doc, pos = rows[order], rid[order], doc[order], pos[order]
            lo, hi = _whole(rows[~first], pos[~first])
            yield _run_rows(-1 - (rid[~first] % buckets), rid[~first], lo, hi, None)
            rows, rid, doc, pos = rows[first], rid[first], doc[first], pos[first]
            gram = S.gram_ids(rows.reshape(-1), np.arange(len(rows)) * S.WIDTH)
            apart = np.isin(gram, hot.value)
            yield from _window_rows(rows[apart], rid[apart], doc[apart], pos[apart])
            own = ~apart
            yield _run_rows((gram[own] % np.uint64(buckets)).astype(np.int64), rid[own], doc[own], pos[own], rows[own])

    def _window_rows(rows, rid, doc, pos) -> Iterator[pa.RecordBatch]:
        """Of each window around the anchors the earliest occurrence; the
        others repeat it."""
        if not len(rows):
            return
        before, after = S.reaches(rows)
        line = np.concatenate([rows[:, :S.LENGTH - 1:-1], rows[:, :S.LENGTH]], axis=1)
        for o in range(S.REACH + 1):
            some = np.flatnonzero((before >= o) & (after >= S.LENGTH - o))
            order = some[np.lexsort((pos[some], rid[some], doc[some]))]
            text = [t.tobytes() for t in line[order, S.REACH - o:S.WIDTH - o]]
            seen: set[bytes] = set()
            first = np.array([t not in seen and not seen.add(t) for t in text], bool)
            again = order[~first]
            if len(again):
                yield _run_rows(-1 - (rid[again] % buckets), rid[again], pos[again] - o, pos[again] - o + S.LENGTH, None)
            at = order[first]
            yield _rows_of(window=pa.array([t for t, f in zip(text, first, strict=True) if f], pa.binary()), doc=pa.array(doc[at], pa.int64()),
                           at=pa.array(rid[at], pa.int64()), start=pa.array(pos[at] - o, pa.int64()))

    def _run_rows(bucket, rid, x, y, rows) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        b, (rids, xs, ys) = _split(bucket[order], rid[order], x[order], y[order])
        if rows is None:
            lcp = rest = [b""] * len(b)
        else:
            cuts = np.append(np.searchsorted(bucket[order], b), len(order))
            coded = [S.front_code(rows[order[i:j]]) for i, j in zip(cuts, cuts[1:], strict=False)]
            lcp, rest = [c[0] for c in coded], [c[1] for c in coded]
        return _rows_of(bucket=pa.array(b.astype(np.int32), pa.int32()),
                        **{n: pa.array(p, pa.binary()) for n, p in zip(("rid", "x", "y", "lcp", "rest"), (rids, xs, ys, lcp, rest), strict=True)})

    kinds = {"bucket": pa.int32(), **dict.fromkeys(("rid", "x", "y", "lcp", "rest", "window"), pa.binary()),
             **dict.fromkeys(("doc", "at", "start"), pa.int64())}

    def _rows_of(**given) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, runs in _by_bucket(batches):
            rid, x, y = (_join(runs, c, "<i8") for c in ("rid", "x", "y"))
            if bucket < 0:
                yield _span_rows(rid, x, y)
                continue
            start = np.cumsum([0] + [len(r["lcp"]) for r in runs])[:-1]
            taken, at, lcps, kept = [0] * len(runs), [], [], []
            for lcp, row, i in S.merge_runs([(r["lcp"], r["rest"]) for r in runs]):
                at.append(start[i] + taken[i])
                taken[i] += 1
                lcps.append(lcp)
                if lcp < S.WIDTH:
                    kept.append(row)
            at, lcps = np.array(at), np.array(lcps)
            lcps[:1] = 0  # the first row of a bucket starts both a gram and a context
            rid, doc, pos = rid[at], x[at], y[at]
            by_time = np.lexsort((pos, rid, doc))
            rank = np.empty(len(at), np.int64)
            rank[by_time] = np.arange(len(at))
            context = np.cumsum(lcps < S.WIDTH) - 1
            gram = np.cumsum(lcps < S.GRAM) - 1
            rows = np.frombuffer(b"".join(kept), np.uint8).reshape(-1, S.WIDTH)
            earliest = by_time[np.unique(context[by_time], return_index=True)[1]]
            first = np.zeros(len(at), bool)
            first[earliest] = True
            lo, hi = _whole(rows[context[~first]], pos[~first])
            yield _span_rows(rid[~first], lo, hi)
            of = gram[earliest]
            several = np.flatnonzero(np.bincount(of)[of] > 1)
            some = earliest[several]
            hit = S.repeated_windows(rows[several], of[several], rank[some])
            row, lo, hi = S.spans_of(hit, pos[some])
            yield _span_rows(rid[some][row], lo, hi)

    def _span_rows(rid, lo, hi) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())],
                                          names=["rid", "lo", "hi"])

    sent = texts.mapInArrow(sort, "bucket int, rid binary, x binary, y binary, lcp binary, rest binary, window binary, doc long, at long, start long")
    hot_found = len(hot.value) > 0
    if hot_found:  # read twice then
        sent = store(sent, "contexts")
    spans = (sent.filter("window IS NULL").select("bucket", "rid", "x", "y", "lcp", "rest").repartition("bucket").sortWithinPartitions("bucket")
             .mapInArrow(merge, "rid long, lo long, hi long"))
    if hot_found:
        windows = sent.filter("window IS NOT NULL").select("window", "doc", F.col("at").alias("rid"), "start")
        spans = spans.unionByName(hot_spans(windows))
    return spans


def _union(lo: list[int], hi: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(lo, hi, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False,
                 row_col: str | None = None) -> DataFrame:
    """rid, doc_id, n_bytes, n_removed, spans (start, end; half open, in bytes),
    kept (the remaining bytes): one row per input row.

    With ``as_text`` ``kept`` is a string; bytes of characters that were cut
    apart are left out.
    A null text counts as empty; a text of fewer than 100 bytes loses nothing.
    Rows with the same doc_id come in their order, null ids last; of repeated
    rows the first keeps its text.
    """
    narrow = numbered(docs, row_col, doc_id=(id_col, "long"), text=(text_col, "string"))
    with passing(docs.sparkSession) as keep:
        spans = keep(repeated_spans(narrow, store(repeated_anchors(narrow), "anchors")), "spans")
    lists = spans.groupBy("rid").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text"):
            kept, spans, texts = [], [], _bytes(batch)
            sizes = pa.array([len(x) for x in texts], pa.int64())
            for text, lo, hi in zip(texts, batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True):
                cuts = _union(lo or [], hi or [])
                bounds = [0, *[x for c in cuts for x in c], len(text)]
                kept.append(b"".join(text[i:j] for i, j in zip(bounds[::2], bounds[1::2], strict=True)))
                spans.append([{"start": i, "end": j} for i, j in cuts])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            texts = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), sizes, pa.array(spans, kind), texts],
                                             names=["rid", "doc_id", "n_bytes", "spans", "kept"])

    joined = narrow.join(lists, "rid", "left").select("rid", "doc_id", "text", "lo", "hi")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    schema = f"rid long, doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept {'string' if as_text else 'binary'}"
    return joined.mapInArrow(cut, schema).select("rid", "doc_id", "n_bytes", removed.alias("n_removed"), "spans", "kept")
