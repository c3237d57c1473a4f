"""Weighted word shingles as 64-bit numbers (used by the near-duplicate operator)."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .chunks import BoundedMemo

_WORDS = re.compile(r"\w+").findall


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Hashes of a text's words (runs of letters, digits and underscores, in
    lower case), 8 bytes a word; blank-separated chunks are remembered."""

    def __init__(self):
        self.known = BoundedMemo()

    def __call__(self, text: str | None) -> bytes:
        chunks = (text or "").split()
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            found = {c: self.known.get(c) for c in chunks}
            for c, known in found.items():
                if known is None:
                    found[c] = b"".join(xxhash.xxh64_digest(w) for w in _WORDS(c.lower()))
                    self.known.remember(c, found[c])
            return b"".join(map(found.__getitem__, chunks))


def shingle_rows(words: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document number, shingle) of every shingle of a list of documents.  A
    document with fewer than ``width`` words, but one at least, has one
    shingle of all its words; one without words has none."""
    sizes = np.array([len(w) // 8 for w in words], dtype=np.int64)
    flat = np.frombuffer(b"".join(words), dtype="<u8").astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    n = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(words)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[doc]
    length = np.minimum(sizes[doc], width)
    padded = np.concatenate([flat, np.zeros(width, np.uint64)])
    value = np.zeros(len(doc), np.uint64)
    for k in range(width):
        word = np.where(k < length, padded[at + k], np.uint64(k + 1)) if (length < width).any() else padded[at + k]
        value = value * np.uint64(0x9E3779B97F4A7C15) + word
        value ^= value >> np.uint64(29)
    return doc, mix(value)


def weighted(words: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle, count) of the distinct shingles."""
    doc, value = shingle_rows(words, width)
    key = mix(value + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(key)))
    return doc[order[first]], value[order[first]], counts.astype(np.float64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two sets of (sorted shingles, weights):
    the sum over common d of 1 / sum over d' of max(a(d')/a(d), b(d')/b(d)).
    With equal weights it is the Jaccard similarity of the sets."""
    (x, wx), (y, wy) = a, b
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if wx.max() == wx.min() and wy.max() == wy.min():
        return len(common) / (len(x) + len(y) - len(common))
    ratio = wx[i] / wy[j]
    order = np.argsort(ratio)
    r, p, q = ratio[order], wx[i][order], wy[j][order]
    only_x, only_y = wx.sum() - p.sum(), wy.sum() - q.sum()
    # at ratio r: elements with a larger ratio count a(d'), the others r * b(d')
    at = np.searchsorted(r, r, "left")
    suffix = np.concatenate([np.cumsum(p[::-1])[::-1], [0.0]])[at] + only_x
    prefix = np.concatenate([[0.0], np.cumsum(q)])[at] + only_y
    return float(np.sum(p / (suffix + r * prefix)))
