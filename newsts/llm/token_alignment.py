"""Alignment of two tokenizers over the distinct texts (operator 13).

1. The texts are shuffled by their full text; each distinct text is tokenised
   and aligned once, with the number of its copies beside it.
2. The byte offsets where tokens of either side end cut a text into segments.
   A segment lies in one token of each side, and two tokens that overlap share
   one segment, so segments and links are the same.  Offsets where both sides
   end close a group.
3. Texts are aligned in blocks of bounded bytes.  A block lists its distinct
   pairs of ids with their links, copies counted, and each text keeps its
   links as positions in that list.  The sums over all blocks are the
   corpus-wide counts; they go back to the blocks' lists, not to each link.
4. The measures of a distinct text are joined to the rows that hold it by the
   text's SHA-256; keys with many rows are dealt over salted copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns, passing, spread_join, store, tokenizer_path
from .packing import CompiledBpe

BLOCK_BYTES = 4 << 20  # documented parameter: bytes of text in a block, or one text
STEP_BYTES = 1 << 18  # documented parameter: bytes of text tokenised at once, or one text
PAIR_ROWS = 4096  # pairs in one row of a block's list

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Side:
    """One tokenizer: ids of texts, and the bytes of every id."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            self.strings = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                            for i, p in enumerate(pieces)]
            # the library puts the space in front by itself
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            model = CompiledBpe(path)  # the ids of the file's library, in less time
            self.strings = model.strings
            self.encode = lambda texts: [np.frombuffer(model.plain_ids(" " + t), "<u4").tolist() for t in texts]
        self.sizes = np.array([len(s) for s in self.strings], np.int64)

    def spells(self, ids: list[int], text: bytes) -> bool:
        return b"".join(map(self.strings.__getitem__, ids)) == text


class Aligner:
    def __init__(self, a: str, b: str):
        self.a, self.b = Side(a), Side(b)
        # decimal ids of both sides, followed by each separator
        many = max(len(self.a.strings), len(self.b.strings))
        self.written = [f"{i}{end}" for end in ",|;" for i in range(many)]
        self.many = many

    def align(self, texts: list[str]) -> tuple[list[bool], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(which texts have tokens; and of those: their groups as text; a row
        of n_a, n_b, n_groups, n_links; all links as a << 32 | b, text by text;
        the number of links up to the end of each text)."""
        ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
        whole = [(" " + t).encode("utf-8", "surrogatepass") for t in texts]
        good = [bool(t) and self.a.spells(x, w) and self.b.spells(y, w)
                for t, w, x, y in zip(texts, whole, ids_a, ids_b, strict=True)]
        bytes_to = np.cumsum([len(w) for w, g in zip(whole, good, strict=True) if g], dtype=np.int64)
        flat_a, n_a = self._flat(ids_a, good)
        flat_b, n_b = self._flat(ids_b, good)
        if not len(bytes_to):
            return good, [], np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        end_a, end_b = np.cumsum(self.a.sizes[flat_a]), np.cumsum(self.b.sizes[flat_b])
        at_a, at_b = np.zeros(bytes_to[-1] + 1, bool), np.zeros(bytes_to[-1] + 1, bool)
        at_a[end_a] = True
        at_b[end_b] = True
        segment = np.flatnonzero(at_a | at_b)
        in_a, in_b = at_a[segment], at_b[segment]
        both = in_a & in_b
        # ends before a segment's end: the number of the token, or group, that it lies in
        links = flat_a[np.cumsum(in_a) - in_a] << 32 | flat_b[np.cumsum(in_b) - in_b]
        group = np.cumsum(both) - both
        links_to = np.searchsorted(segment, bytes_to, "right")
        groups_to = np.cumsum(both)[links_to - 1]
        counts = np.stack([n_a, n_b, np.diff(groups_to, prepend=0), np.diff(links_to, prepend=0)], axis=1)
        return good, self._groups(flat_a, flat_b, group[in_a], group[in_b], n_a + n_b), counts, links, links_to

    @staticmethod
    def _flat(ids: list[list[int]], good: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        kept = [np.array(x, np.int64) for x, g in zip(ids, good, strict=True) if g]
        return np.concatenate([np.zeros(0, np.int64), *kept]), np.array([len(x) for x in kept], np.int64)

    def _groups(self, flat_a, flat_b, group_a, group_b, sizes) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        past_a, past_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
        written = np.empty(len(flat_a) + len(flat_b), np.int64)
        for flat, place, past, end in ((flat_a, np.concatenate([[0], past_b])[group_a], past_a, 1), (flat_b, past_a[group_b], past_b, 2)):
            ids = flat.copy()
            ids[past - 1] += end * self.many
            written[np.arange(len(flat)) + place] = ids
        to, out, get = 0, [], self.written.__getitem__
        for n in sizes.tolist():
            out.append("".join(map(get, written[to:to + n].tolist()))[:-1])
            to += n
        return out


@lru_cache(maxsize=1)
def _aligner(a: str, b: str) -> Aligner:
    return Aligner(tokenizer_path(a), tokenizer_path(b))


def aligned_blocks(texts: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of two kinds for each block of texts (text, digest, n).  A text
    with tokens: digest, n_a, n_b, n_groups, n_links, groups and ``at``, the
    positions of its links in the block's list as little-endian 32-bit.  A part
    of the list: start, pairs and their links in the block, copies counted."""
    names = ["block", "digest", "n_a", "n_b", "n_groups", "n_links", "groups", "at", "start", "pairs", "links"]
    schema = ("block long, digest binary, n_a long, n_b long, n_groups long, n_links long, groups string, at binary, "
              "start long, pairs array<long>, links array<long>")
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.int64(), *[pa.list_(pa.int64())] * 2]

    def rows(**given) -> pa.RecordBatch:
        n = len(given["block"])
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a, b)
        block = TaskContext.get().partitionId() << 32
        for batch in bounded_batches(batches, "text", BLOCK_BYTES):
            digests, parts, sizes, groups, counts = [], [], [], [], []
            for step in bounded_batches([batch], "text", STEP_BYTES):
                good, said, count, links, to = aligner.align(step.column("text").to_pylist())
                mask = pa.array(good, pa.bool_())
                digests += step.column("digest").filter(mask).to_pylist()
                copies = step.column("n").filter(mask).to_numpy()
                parts.append(links)
                sizes.append(np.repeat(copies, np.diff(to, prepend=0)))
                groups += said
                counts.append(count)
            if not digests:
                continue
            pairs, at = np.unique(np.concatenate(parts), return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, at, np.concatenate(sizes))
            counts, at = np.concatenate(counts), at.astype("<u4")
            cut = np.concatenate([[0], np.cumsum(counts[:, 3])]).tolist()
            yield rows(block=pa.array([block] * len(digests), pa.int64()), digest=pa.array(digests, pa.binary()),
                       **{c: pa.array(counts[:, k]) for k, c in enumerate(MEASURES[:4])}, groups=pa.array(groups, pa.string()),
                       at=pa.array([at[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary()))
            starts = list(range(0, len(pairs), PAIR_ROWS))
            edge = pa.array([*starts, len(pairs)], pa.int32())
            yield rows(block=pa.array([block] * len(starts), pa.int64()), start=pa.array(starts, pa.int64()),
                       pairs=pa.ListArray.from_arrays(edge, pa.array(pairs)), links=pa.ListArray.from_arrays(edge, pa.array(total)))
            block += 1

    return texts.select("text", "digest", "n").mapInArrow(run, schema)


def pair_counts(lists: DataFrame) -> DataFrame:
    """pair, count, best (whether no pair with the same right id has more)."""
    each = lists.select(F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("p.pairs", "p.links")
    counts = store(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("links").alias("count")), "pair-counts")
    right = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("right")
    most = counts.groupBy(right).agg(F.max("count").alias("most"))
    return (counts.select("pair", "count", right).join(most, "right")
            .select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def scored_texts(blocks: DataFrame) -> DataFrame:
    """digest and measures (and groups) of every aligned text."""
    lists = blocks.filter("start IS NOT NULL").select("block", "start", "pairs", "links")
    texts = blocks.filter("start IS NULL")
    listed = (lists.select("block", "start", F.posexplode("pairs").alias("k", "pair"))
              .join(pair_counts(lists), "pair")
              .select("block", (F.col("start") + F.col("k")).alias("k"), "count", "best"))
    own = [c for c in texts.columns if c not in ("block", "start", "pairs", "links")]
    # a block's list comes first, in order, then its texts
    dealt = listed.unionByName(texts.select("block", *own), allowMissingColumns=True)
    dealt = dealt.repartition("block").sortWithinPartitions("block", F.asc_nulls_last("k"))
    out = [c for c in own if c != "at"]
    fields = ", ".join(f"{n} {t}" for n, t in texts.select(out).dtypes) + ", n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, known = None, [], None
        for batch in bounded_batches(batches, "at"):
            block = batch.column("block").to_numpy()
            is_text = batch.column("k").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (is_text[1:] != is_text[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(i, j - i)
                if block[i] != current:
                    current, parts, known = block[i], [], None
                if not is_text[i]:
                    parts.append((part.column("count").to_numpy(), part.column("best").to_numpy(zero_copy_only=False)))
                    continue
                if known is None:
                    known = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    parts = []
                best, total = [], []
                for links in part.column("at"):
                    at = np.frombuffer(links.as_buffer(), "<u4")
                    best.append(int(known[1][at].sum()))
                    total.append(int(known[0][at].sum()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in out], pa.array(best, pa.int64()), pa.array(total, pa.int64())],
                                                 names=[*out, "n_best", "count_sum"])

    return dealt.mapInArrow(run, fields)


def align_tokens(docs: DataFrame, a: str, b: str, with_groups: bool = False, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256
    (and ``groups`` itself if asked): one row per input row.

    ``a`` is a byte-level ``tokenizers`` file, ``b`` a sentencepiece model.
    Null and empty texts, and texts that the tokens of one side do not spell,
    have no tokens: zeros and empty strings.  Repeated rows, copies and null
    ids keep their rows; a link of a text counts once for each copy.
    """
    narrow = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    rows = store(narrow.select(F.monotonically_increasing_id().alias("rid"), "doc_id", digest), "rows")
    texts = narrow.filter("text <> ''").groupBy("text").agg(F.count("*").alias("n")).select("text", "n", digest)
    blocks = aligned_blocks(texts, a, b).withColumn("groups_sha256", F.sha2("groups", 256))
    with passing(docs.sparkSession) as keep:
        found = keep(scored_texts(store(blocks if with_groups else blocks.drop("groups"), "aligned")), "measures")
    said = ["groups_sha256", *(["groups"] if with_groups else [])]
    return (spread_join(rows, found, "digest", "rid")
            .select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in MEASURES],
                    *[F.coalesce(c, F.lit("")).alias(c) for c in said]))
