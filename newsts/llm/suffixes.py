"""Array helpers of the suffix-array operator: anchors, contexts, front-coded
runs and their merge.

An *anchor* is a position whose ``GRAM`` bytes have the smallest hash of some
window of ``LENGTH`` bytes.  Equal windows choose the same anchor, so a window
that occurs twice holds an anchor whose gram occurs twice.  The *context* of
an anchor is the suffix from it, cut at ``LENGTH`` bytes, followed by the bytes
before it in reverse; ends of documents are marked by 0xFF, which UTF-8 never
holds.  A context decides every window that holds the anchor's gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .shingles import mix

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # bytes of a window before its anchor, at most
WIDTH = LENGTH + REACH
END = 0xFF

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best(x[i:i+width]) for every i that has so many values."""
    done = 1
    while 2 * done <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (width - done)], x[width - done:]) if width > done else x


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted positions of the anchors in ``data``, bytes, whose documents
    lie at [starts, ends); a hash of the context of each)."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, base = _TABLE[data], 0x01000193
    for _ in range(GRAM.bit_length() - 1):
        step = (n - len(h)) + 1
        h = h[:-step] * np.uint32(base) + h[step:]
        base = base * base % (1 << 32)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(13))) | np.uint32(1)
    low = _slide(h, REACH + 1, np.minimum)  # of the window that starts here
    valid = np.zeros(n + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - (LENGTH - 1), -1)
    low = np.where(np.cumsum(valid[: len(low)]) > 0, low, np.uint32(0))
    edge = np.zeros(REACH, np.uint32)
    high = _slide(np.concatenate([edge, low, edge]), REACH + 1, np.maximum)
    found = np.flatnonzero(h == high)
    doc = np.searchsorted(ends, found, "right")
    context = np.zeros(len(found), np.uint64)
    for by in (-REACH, -REACH + GRAM, -GRAM, GRAM, LENGTH - GRAM):
        at = np.clip(found + by, starts[doc], ends[doc] - GRAM)
        context = mix(context * np.uint64(0x9E3779B97F4A7C15) + h[at].astype(np.uint64))
    return found, context


def gram_ids(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit numbers of the grams at the given positions."""
    grams = np.lib.stride_tricks.sliding_window_view(data, GRAM)[at] if len(at) else np.zeros((0, GRAM), np.uint8)
    words = np.ascontiguousarray(grams).view("<u8")
    h = np.full(len(at), 0x51, np.uint64)
    for k in range(words.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
    return h


def contexts(data: bytes, at: np.ndarray) -> np.ndarray:
    """One context (``WIDTH`` bytes) for each position of one document."""
    ends = np.full(WIDTH, END, np.uint8)
    padded = np.concatenate([ends[:REACH], np.frombuffer(data, np.uint8), ends[:LENGTH]])
    around = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at]
    return np.concatenate([around[:, REACH:], around[:, REACH - 1::-1]], axis=1)


def reaches(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the document before and from the anchor of each context."""
    return REACH - (rows[:, LENGTH:] == END).sum(axis=1), LENGTH - (rows[:, :LENGTH] == END).sum(axis=1)


def front_code(rows: np.ndarray) -> tuple[bytes, bytes]:
    """(common prefix with the row before, remaining bytes) of sorted rows."""
    differ = rows[1:] != rows[:-1]
    lcp = np.zeros(len(rows), np.uint8)
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
    return lcp.tobytes(), rows[np.arange(WIDTH) >= lcp[:, None]].tobytes()


def read_run(lcp: bytes, rest: bytes) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the row before, row) of a front-coded run."""
    row, at = b"", 0
    for k in lcp:
        row = row[:k] + rest[at:at + WIDTH - k]
        at += WIDTH - k
        yield k, row


def merge_runs(runs: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, bytes, int]]:
    """Merge sorted front-coded runs: (common prefix with the row before, row,
    run).  A loser tree keeps for each run the prefix that its row shares with
    the last row given out; of two rows the one that shares more is smaller,
    and only rows that share equally much are compared, from there on."""
    readers = [read_run(*r) for r in runs]
    n = len(readers)
    rows: list[bytes | None] = [None] * n
    known = [0] * n

    def advance(i: int) -> None:
        known[i], rows[i] = next(readers[i], (-1, None))

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one shared with the winner."""
        x, y = known[i], known[j]
        if x > y:
            return i, j
        if y > x:
            return j, i
        if x < 0:
            return i, j
        a, b = rows[i], rows[j]
        gap = int.from_bytes(a[x:], "big") ^ int.from_bytes(b[x:], "big")
        if not gap:
            known[max(i, j)] = WIDTH
            return min(i, j), max(i, j)
        at = WIDTH - (gap.bit_length() + 7) // 8
        if a[at] < b[at]:
            known[j] = at
            return i, j
        known[i] = at
        return j, i

    if not n:
        return
    for i in range(n):
        advance(i)
    losers = [-1] * n  # of the inner nodes 1..n-1; the leaves are n..2n-1
    winners = [0] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if n > 1 else 0
    while rows[top] is not None:
        yield known[top], rows[top], top
        advance(top)  # its prefix with the row just given out is the run's own
        node = (top + n) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeated_windows(rows: np.ndarray, gram: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of different contexts, with the number of their gram and their rank in
    the order of occurrence: len(rows) x (REACH + 1), true at [i, o] if the
    window that starts ``o`` bytes before anchor i occurs with a lower rank."""
    order = np.argsort(rank, kind="stable")
    rows, gram = rows[order], gram[order].astype(np.uint64)
    before, after = reaches(rows)
    line = np.concatenate([rows[:, :LENGTH - 1:-1], rows[:, :LENGTH]], axis=1)
    base = 0x9E3779B97F4A7C15
    sums = np.zeros((WIDTH + 1, len(rows)), np.uint64)
    for k in range(WIDTH):
        sums[k + 1] = sums[k] * np.uint64(base) + line[:, k] + np.uint64(1)
    lead = np.uint64(pow(base, LENGTH, 1 << 64))
    found = np.zeros((len(rows), REACH + 1), bool)
    for o in range(REACH + 1):
        inside = np.flatnonzero((before >= o) & (after >= LENGTH - o))
        a, b = REACH - o, WIDTH - o
        key = mix(sums[b, inside] - sums[a, inside] * lead + gram[inside] * np.uint64(0xD6E8FEB86659FD93))
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        later = np.flatnonzero(first[of] != np.arange(len(inside)))
        here, there = inside[later], inside[first[of[later]]]
        same = (line[here, a:b] == line[there, a:b]).all(axis=1) & (gram[here] == gram[there])
        found[here[same], o] = True
        for i in here[~same]:  # equal hashes of different windows: look at the windows themselves
            text = line[i, a:b].tobytes()
            found[i, o] = any(gram[j] == gram[i] and line[j, a:b].tobytes() == text for j in inside[inside < i])
    out = np.empty_like(found)
    out[order] = found
    return out


def spans_of(found: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end): bytes covered by the windows found, one entry for
    each run of neighbouring windows.  ``at``: position of the anchors."""
    wide = np.zeros((len(found), REACH + 3), np.int8)
    wide[:, 1:-1] = found
    step = np.diff(wide, axis=1)
    row, least = np.nonzero(step == 1)
    _, past = np.nonzero(step == -1)
    return row, at[row] - (past - 1), at[row] - least + LENGTH
