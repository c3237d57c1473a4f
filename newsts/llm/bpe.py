"""Byte-level BPE encoding and decoding (operator 4).

A text is split at added tokens, then into pieces by the byte-level pattern.
A piece is encoded by a priority queue of merge ranks over a doubly linked
list of symbols: the cheapest merge is taken, its neighbours are queued anew
and entries whose symbols have changed since are skipped as stale.  Decoding
concatenates the vocabulary's byte strings.

Pieces repeat, so a task keeps the encodings of the pieces and of the
blank-separated chunks that it has seen, in dictionaries of bounded size.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BoundedMemo, ChunkMemo
from .common import bounded_batches, columns, tokenizer_path

# fixed value: the pattern of the byte-level pre-tokeniser, with white space
# as Unicode defines it
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
          r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
MARKS = ".,;:!?%$#*&|"  # marks, neither letters nor digits, that often follow a word
PIECE_BYTES = 24 << 20  # documented parameter: bytes of pieces kept by a task
LONG_PIECE = 1 << 16  # bytes from which a piece's links are kept in arrays of 4 bytes each


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1
    stands for itself, the other bytes follow from U+0100 in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(own))
    return table


class ByteBpe:
    """Encoder and decoder read from a ``tokenizers`` file of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without a normaliser are read")
        if pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["model"].get("ignore_merges"):
            raise ValueError("prefix spaces, plain splitting and ignored merges are not supported")
        alphabet = byte_alphabet()
        byte_of = {c: b for b, c in alphabet.items()}
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or need word bounds are not supported")
        self.strings = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            known = all(c in byte_of for c in token)
            self.strings[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.byte_ids = [vocab[alphabet[b]] for b in range(256)]
        # for each left id the right ids that merge with it, and the rank; the id that each rank makes
        self.rank: list[dict[int, int]] = [{} for _ in self.strings]
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a]][vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.sizes = np.array([len(x) for x in self.strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.strings), np.uint8)
        self.find = regex.compile(PIECES).findall
        self.pieces = BoundedMemo(PIECE_BYTES)
        self.chunks = ChunkMemo(self.encode_plain, added)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the symbols of one piece.  A queue entry is rank and position
        in one number, so that the leftmost of equal ranks goes first; it is
        stale if the symbols there no longer make a pair of that rank."""
        n, rank, merged = len(ids), self.rank, self.merged
        bits = n.bit_length()
        here = (1 << bits) - 1
        queue = [r << bits | i for i, (a, b) in enumerate(pairwise(ids)) if (r := rank[a].get(b)) is not None]
        if not queue:
            return ids
        heapify(queue)
        after, before = range(1, n + 1), range(-1, n - 1)
        after, before = (list(after), list(before)) if n < LONG_PIECE else (array("i", after), array("i", before))
        while queue:
            entry = heappop(queue)
            i = entry & here
            j = after[i]
            left = ids[i]
            if left < 0 or j >= n or rank[left].get(ids[j]) != entry >> bits:
                continue
            new = ids[i] = merged[entry >> bits]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank[new].get(ids[k])) is not None:
                    heappush(queue, r << bits | i)
            h = before[i]
            if h >= 0 and (r := rank[ids[h]].get(new)) is not None:
                heappush(queue, r << bits | h)
        return [i for i in ids if i >= 0]

    def encode_piece(self, piece: str) -> bytes:
        return array("I", self.merge([self.byte_ids[b] for b in piece.encode()])).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.encode_piece(piece)
            self.pieces.remember(piece, ids)
        return ids

    def encode_plain(self, text: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit, of a text without added tokens."""
        if text[:1] == " " and (word := text[1:].rstrip(MARKS)).isalpha():
            # the common chunk, a word with marks after it, needs no pattern
            if len(word) == len(text) - 1:
                return self.encode_piece(text)
            return self.chunks.later[word] + self._piece(text[len(word) + 1:])
        return b"".join(map(self._piece, self.find(text)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.chunks.encode(texts)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the ids before each end: the vocabulary's byte strings one
        after the other."""
        n = self.sizes[ids]
        past = np.cumsum(n)
        data = self.bytes[np.arange(past[-1] if len(past) else 0) + np.repeat(self.starts[ids] - past + n, n)]
        at = [0, *np.concatenate([[0], past])[ends].tolist()]
        return [data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=2)
def _model(name: str) -> ByteBpe:
    return ByteBpe(tokenizer_path(name))


def ids_column(blobs: list[bytes]) -> pa.Array:
    """A list column of ids from little-endian blobs."""
    ends = np.cumsum([0, *map(len, blobs)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                    pa.array(np.frombuffer(b"".join(blobs), "<i4"), pa.int32()))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: one row per input row, in any order.

    A null or empty text has no ids.  Repeated rows and repeated or null ids
    are encoded like any other row; other columns are not read.
    """
    narrow = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(tokenizer)
        for batch in bounded_batches(batches, "text"):
            blobs = model.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids_column(blobs)], names=["doc_id", "ids"])

    return narrow.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the decoded ``text``; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(tokenizer)
        for batch in bounded_batches(batches, "ids", 1 << 20):
            ids = batch.column("ids")
            ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy())
            texts = model.decode(ids.flatten().to_numpy(), ends)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())],
                                             names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of decoded rows."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(ids, 256).alias("ids_sha256"),
                          F.sha2("text", 256).alias("decoded_sha256"))
