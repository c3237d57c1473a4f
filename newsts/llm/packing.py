"""Packing documents into fixed windows by best-fit decreasing (operator 9).

Overlong documents are first cut into full windows.  The pieces are placed in
order of decreasing length, each into the open window whose remaining capacity
is the tightest that takes it; a segment tree indexed by remaining capacity
finds that capacity.

Pieces of one length are interchangeable, and so are windows of one remaining
capacity.  The placement therefore needs only the number of pieces of each
length: at most ``window`` counts, reduced by Spark, whatever the corpus.  It
moves whole runs of equal pieces at a time and gives, for each length, ranges
of ranks and the windows they go to.  Spark ranks the pieces of each length in
salted groups and looks the windows up.  The result is the global best-fit
decreasing packing, without any task that sees all pieces.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PIECES, ByteBpe
from .common import bounded_batches, columns, store, tokenizer_path

WINDOW = 1024
# the compiled pattern engine steps back through white space character by
# character on a stack of its own; longer runs are cut out before it
LONG_BLANK = 1000


class OpenWindows:
    """Segment tree over remaining capacities; a leaf holds the runs
    (first window, how many) of open windows with that capacity."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = [0] * (2 * self.size)  # number of runs below a node
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _count(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.any[node] += by
            node //= 2

    def put(self, capacity: int, first: int, many: int) -> None:
        if capacity and many:
            self.runs[capacity].append((first, many))
            self._count(capacity, 1)

    def take(self, capacity: int) -> tuple[int, int]:
        self._count(capacity, -1)
        return self.runs[capacity].pop()

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` with an open window."""
        node = least + self.size
        if self.any[node]:
            return least
        while node > 1 and (node % 2 or not self.any[node + 1]):
            node //= 2
        if node <= 1:
            return None
        node += 1
        while node < self.size:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Rows (length, first rank, past rank, first window, offset): the piece
    of that length with rank ``first rank + i`` starts at ``offset`` in
    ``first window + i``.  ``counts``: pieces of each length in 1..window."""
    tree, rows, opened = OpenWindows(window), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = window, window // length
                first, many = opened, -(-left // each)
                opened += many
            else:
                first, many = tree.take(room)
                each = room // length
            # a window takes pieces of this length until none fits any more
            whole = min(many, left // each)
            for j in range(each if whole else 0):
                rows.append((length, rank, rank + whole, first, window - room + j * length))
                rank += whole
            tree.put(room - each * length, first, whole)
            left -= whole * each
            rest = many - whole
            if rest and left and left < each:
                for j in range(left):
                    rows.append((length, rank, rank + 1, first + whole, window - room + j * length))
                    rank += 1
                tree.put(room - left * length, first + whole, 1)
                left, whole, rest = 0, whole + 1, rest - 1
            tree.put(room, first + whole, rest)
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


class CompiledBpe:
    """Ids of whole texts by a compiled byte-level BPE, from the vocabulary of
    a ``tokenizers`` file whose ids follow the order of its merges."""

    def __init__(self, path: str):
        import tiktoken
        model = ByteBpe(path)
        if any(a >= b for a, b in pairwise(model.merged)):
            raise ValueError("the ids do not follow the merges")
        made = {*model.byte_ids, *model.merged}
        ranks = {s: i for i, s in enumerate(model.strings) if i in made}
        self.plain = tiktoken.Encoding("plain", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added, self.cut = model.chunks.added, model.chunks.cut
        self.piece, self.strings = model.encode_piece, model.strings
        self.blanks = regex.compile(r"\p{White_Space}{%d,}" % LONG_BLANK)

    def plain_ids(self, text: str) -> bytes:
        """Ids of a text without added tokens.  The pattern takes a run of
        white space as one piece, but for its last character where more text
        follows."""
        out, at = [], 0
        for run in self.blanks.finditer(text):
            past = run.end() - (run.end() < len(text))
            out += [array("I", self.plain(text[at:run.start()])).tobytes(), self.piece(text[run.start():past])]
            at = past
        out.append(array("I", self.plain(text[at:])).tobytes())
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit; none for a null text."""
        out = []
        for text in texts:
            parts = self.cut.split(text) if self.cut and text else [text or ""]
            out.append(b"".join(self.added[x] if k % 2 else self.plain_ids(x) for k, x in enumerate(parts)))
        return out


@lru_cache(maxsize=2)
def _ids(name: str) -> CompiledBpe:
    return CompiledBpe(tokenizer_path(name))


def cut_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, start, length, doc_tokens, ids: the pieces of every
    document, at most ``window`` ids each; ``ids`` holds little-endian
    unsigned 32-bit numbers.  Every document ends with ``end_id``, so a null
    or empty text is one piece of one id.  ``row`` tells rows with the same
    doc_id apart."""
    narrow = (columns(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
              .withColumn("row", F.monotonically_increasing_id()))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ids(tokenizer)
        for batch in bounded_batches(batches, "text"):
            of, starts, ids, totals = [], [], [], []
            for k, blob in enumerate(model.encode(batch.column("text").to_pylist())):
                blob += end
                cuts = range(0, len(blob), 4 * window)
                of += [k] * len(cuts)
                starts += [c // 4 for c in cuts]
                ids += [blob[c:c + 4 * window] for c in cuts]
                totals += [len(blob) // 4] * len(cuts)
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(take), batch.column("doc_id").take(take), pa.array(starts, pa.int64()),
                 pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary())],
                names=["row", "doc_id", "start", "length", "doc_tokens", "ids"])

    return narrow.mapInArrow(run, "row long, doc_id long, start long, length long, doc_tokens long, ids binary")


def assign(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.  ``pieces`` should be a
    stored table; it needs row, start and length.  No piece, no row."""
    spark = pieces.sparkSession
    salts = max(32, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_decreasing(counts, window)  # its size depends on the window alone
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = spark.sparkContext.broadcast(plan[order])
    inside = Window.partitionBy("length", "salt").orderBy("row", "start")
    ranked = (salted.withColumn("inside", F.row_number().over(inside) - 1)
              .join(groups.select("length", "salt", "base"), ["length", "salt"])
              .withColumn("rank", F.col("base") + F.col("inside")).drop("salt", "inside", "base"))
    fields = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, `offset` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        key = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = table[np.searchsorted(key, length << 48 | rank, "right") - 1]
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at[:, 3] + rank - at[:, 1]), pa.array(at[:, 4])],
                                             names=[*names, "sequence_id", "offset"])

    names = pieces.columns
    return ranked.select(*names, "rank").mapInArrow(run, fields)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ids, sequence_id and offset: one row per piece."""
    return assign(store(cut_pieces(docs, tokenizer, window, end_id, id_col, text_col), "pieces"), window)
