"""Encodings of blank-separated chunks, remembered by a task.

A blank between two characters that are not white space always starts a new
piece of the tokenizers used here, so the chunks between such blanks are
encoded independently and a text's ids are the chunks' ids in order.  A text
with a blank beside other white space, or at an end, is encoded as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from sys import getsizeof

import regex

# documented parameters: bytes held by a task's memo, with the places of its
# entries, and the longest key that is remembered.  In text without blanks a
# chunk may be a paragraph, which is encoded whenever it comes
MEMO_BYTES, LONGEST, ENTRY_BYTES = 96 << 20, 64, 120


class BoundedMemo(dict):
    """Results of short strings, of at most ``most`` bytes in all."""

    def __init__(self, most: int = MEMO_BYTES):
        super().__init__()
        self.most, self.held = most, 0

    def remember(self, key: str, value) -> None:
        if len(key) > LONGEST:
            return
        size = getsizeof(key) + getsizeof(value) + ENTRY_BYTES
        if self.held + size > self.most:
            self.halve()
        self[key] = value
        self.held += size

    def halve(self) -> None:
        """Keep the older half: what came early comes often."""
        old, self.held = list(self.items()), 0
        self.clear()
        for key, value in old:
            size = getsizeof(key) + getsizeof(value) + ENTRY_BYTES
            if self.held + size > self.most // 2:
                break
            self[key] = value
            self.held += size


class _Whole(Exception):
    """A chunk that is empty or has white space at an end: the blank beside it
    is no place to cut at."""


class _Memo(BoundedMemo):
    """Ids of chunks, encoded when first asked for."""

    def __init__(self, encode: Callable[[str], bytes], prefix: str, most: int):
        super().__init__(most)
        self.encode, self.prefix = encode, prefix

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Whole
        ids = self.encode(self.prefix + chunk)
        self.remember(chunk, ids)
        return ids


class ChunkMemo:
    """``encode_plain`` gives the ids (bytes) of a text without added tokens;
    ``added`` holds the ids of the added tokens, which stand for themselves
    wherever their strings appear."""

    def __init__(self, encode_plain: Callable[[str], bytes], added: dict[str, int], most: int = MEMO_BYTES):
        self.encode_plain = encode_plain
        self.added = {k: v.to_bytes(4, "little") for k, v in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.first = _Memo(encode_plain, "", most // 8)  # a chunk that starts a text
        self.later = _Memo(encode_plain, " ", most)  # a chunk after a blank

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        head, *rest = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.later.__getitem__, rest))
        except _Whole:
            return self.encode_plain(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit; none for a null text."""
        out = []
        for text in texts:
            parts = self.cut.split(text) if self.cut and text else [text or ""]
            out.append(b"".join(self.added[x] if k % 2 else self._plain(x) for k, x in enumerate(parts)))
        return out
