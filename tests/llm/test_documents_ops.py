"""Operators 4, 6, 7, 8, 9, 10 against brute force on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsts.llm import bpe, packing, suffixes
from newsts.llm.common import tokenizer_path, work_folder
from newsts.llm.exact_dedup import exact_dedup
from newsts.llm.quality_rules import quality_rules
from newsts.llm.suffix_dedup import suffix_dedup
from newsts.llm.token_counts import CACHE_SCHEMA, token_counts

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return {n: Tokenizer.from_file(tokenizer_path(n)) for n in (BYTE, WORD)}


def bag(rows):
    return Counter(map(tuple, rows))


# ---- 10

def test_exact_dedup(df, corpus):
    got = exact_dedup(df, block_chars=64).collect()
    groups = defaultdict(list)
    for i, t in corpus:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, len(t or "")))
    assert len(got) == len(corpus)
    assert len({r["rid"] for r in got}) == len(corpus)
    want = Counter()
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0]))[0]
        for i, _ in members:
            want[i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert bag((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_weak_fingerprint(df):
    """Names stay free of collisions when nearly all fingerprints collide."""
    def show(x):
        return bag(x.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    weak = exact_dedup(df, block_chars=64, fingerprint=lambda c: F.pmod(F.xxhash64(c), F.lit(3)))
    assert show(weak) == show(exact_dedup(df))


def test_exact_dedup_empty(empty):
    assert exact_dedup(empty).count() == 0


# ---- 8

def brute_spans(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(b[p:p + 100])
        cuts = [(m.start(), m.end()) for m in re.finditer(rb"\x01+", gone)]
        out.append((i, len(b), tuple(cuts), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_suffix_dedup(spark, df, corpus):
    order = df.select("doc_id", "text").collect()  # equal ids come in the order of the table
    got = suffix_dedup(df).collect()
    assert bag((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in got) \
        == bag(brute_spans(order))
    assert all(r["n_removed"] == r["n_bytes"] - len(r["kept"]) for r in got)


def test_suffix_dedup_as_text(df, corpus):
    got = suffix_dedup(df, as_text=True).collect()
    assert sorted(len(r["kept"]) for r in got) == sorted(len(x[3].decode("utf-8", "ignore")) for x in brute_spans(df.select("doc_id", "text").collect()))


def test_suffix_dedup_empty(empty):
    assert suffix_dedup(empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=8).map(lambda s: s.encode().ljust(suffixes.WIDTH, b"c")), max_size=12), max_size=5))
def test_merge_runs(runs):
    coded = []
    for r in runs:
        rows = np.frombuffer(b"".join(sorted(r)), np.uint8).reshape(-1, suffixes.WIDTH)
        coded.append(suffixes.front_code(rows) if len(rows) else (b"", b""))
    out = list(suffixes.merge_runs(coded))
    assert [x[1] for x in out] == sorted(x for r in runs for x in r)
    for (_, before, _), (lcp, row, _) in zip(out, out[1:]):
        assert before[:lcp] == row[:lcp] and (lcp == suffixes.WIDTH or before[lcp] != row[lcp])


@settings(max_examples=20, deadline=None)
@given(st.text("abcdefgh", min_size=100, max_size=600))
def test_every_window_holds_an_anchor(text):
    data = np.frombuffer(text.encode(), np.uint8)
    found = set(suffixes.anchors(data, np.array([0]), np.array([len(data)]))[0].tolist())
    for p in range(len(data) - suffixes.LENGTH + 1):
        assert any(q in found for q in range(p, p + suffixes.REACH + 1))


# ---- 6

def test_quality_rules(df, corpus):
    want = Counter()
    for i, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = len(w)
        grams = Counter(tuple(w[k:k + 8]) for k in range(n - 7))
        cover = {k + j for k in range(n - 7) if grams[tuple(w[k:k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[i, n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover),
             n < 20 or 100 * len(cover) > 30 * n] += 1
    got = quality_rules(df).collect()
    assert bag((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert all(r["kept"] == (not r["base_failed"] and not r["failed_rules"]) for r in got)


def test_quality_rules_repeats_and_native(spark, empty):
    from .conftest import frame
    text = "one two three four five six seven eight nine " * 2 + "ten eleven"
    row = quality_rules(frame(spark, [(1, text)])).first()
    assert (row["n_words"], row["n_repeat_words"]) == (20, 18)
    assert quality_rules(empty).count() == 0
    plan = quality_rules(empty)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# ---- 4

def test_bpe(df, corpus, library):
    t = library[BYTE]
    want = Counter()
    for i, x in corpus:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
    got = bpe.decode(bpe.encode(df, BYTE), BYTE).collect()
    assert bag((r["doc_id"], tuple(r["ids"]), r["text"]) for r in got) == want


def test_bpe_digests(spark, empty, library):
    from .conftest import frame
    row = bpe.digests(bpe.decode(bpe.encode(frame(spark, [(1, "Hello world")]), BYTE), BYTE)).first()
    ids = library[BYTE].encode("Hello world").ids
    assert row["n_tokens"] == len(ids)
    assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(b"Hello world").hexdigest()
    assert bpe.encode(empty, BYTE).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'.,sdabe 　")), max_size=60))
def test_bpe_any_text(library, text):
    ids = library[BYTE].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe._model(BYTE).encode([text])[0], "<u4").tolist() == ids
    assert np.frombuffer(packing._ids(BYTE).encode([text])[0], "<u4").tolist() == ids
    assert bpe._model(BYTE).decode(np.array(ids, np.int64), np.array([len(ids)])) == [library[BYTE].decode(ids, skip_special_tokens=False)] == [text]


# ---- 7

def test_token_counts(spark, df, corpus, library):
    t, path = library[WORD], work_folder(spark, "test-cache")
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 100) for i, x in corpus)
    got = token_counts(df, WORD, path, limit=100).collect()
    assert bag((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert not any(r["cached"] for r in got)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    n = stored.count()
    assert n == stored.select("tokenizer", "digest").distinct().count()
    # a second call takes every count from the cache and appends nothing
    again = token_counts(df, WORD, path, limit=100).collect()
    assert bag((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in again) == want
    assert all(r["cached"] for r in again) and spark.read.schema(CACHE_SCHEMA).parquet(path).count() == n
    # another tokenizer shares nothing with the first
    other = token_counts(df, BYTE, path).collect()
    assert not any(r["cached"] for r in other)
    assert bag((r["doc_id"], r["n_tokens"]) for r in other) == Counter(
        (i, len(library[BYTE].encode(x or "", add_special_tokens=False).ids)) for i, x in corpus)


def test_token_counts_hot_texts(spark, df, monkeypatch):
    """Rows of texts with many copies, dealt over salts, get the same counts."""
    from newsts.llm import common
    want = bag(token_counts(df, WORD, work_folder(spark, "test-cache")).select("doc_id", "n_tokens").collect())
    monkeypatch.setattr(common, "HOT_LEAST", 1)
    got = token_counts(df, WORD, work_folder(spark, "test-cache"))
    assert bag(got.select("doc_id", "n_tokens").collect()) == want


def test_token_counts_empty(spark, empty):
    assert token_counts(empty, WORD, work_folder(spark, "test-cache")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\x0b\x0c\r'.,sdABé ")), max_size=40))
def test_token_count_any_text(library, text):
    from newsts.llm.token_counts import _counter
    n = len(library[WORD].encode(text, add_special_tokens=False).ids)
    norm = re.sub(r"[\x20\x09-\x0D]+", " ", text).strip(" ")
    assert _counter(WORD).count([norm]) == [n]


# ---- 9

def brute_bfd(counts, window):
    """One piece at a time; remaining capacities of the windows."""
    room = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in room if r >= length]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - length)
            else:
                room.append(window - length)
    return sorted(room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 20), max_size=12))
def test_best_fit_decreasing(counts):
    plan = packing.best_fit_decreasing(counts, 32)
    used, ranks = defaultdict(list), defaultdict(list)
    for length, lo, hi, first, offset in plan.tolist():
        ranks[length] += range(lo, hi)
        for i in range(hi - lo):
            used[first + i].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 32
    assert sorted(32 - sum(n for _, n in p) for p in used.values()) == brute_bfd(counts, 32)


def test_pack(df, corpus, library):
    t = library[BYTE]
    got = packing.pack(df, BYTE, window=64).collect()
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for i, x in corpus)
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r["row"], r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], np.frombuffer(r["ids"], "<u4").tolist()))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    found = Counter()
    for (_, i, n), pieces in docs.items():
        ids = []
        for start, length, part in sorted(pieces):
            assert start == len(ids) and length == len(part)
            ids += part
        assert n == len(ids)
        found[i, tuple(ids)] += 1
    assert found == want
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    tokens = sum(r["length"] for r in got)
    assert sum(64 - sum(n for _, n in p) for p in seqs.values()) <= 64 + 0.05 * tokens


def test_pack_empty(empty):
    assert packing.pack(empty, BYTE).count() == 0


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\r\n ", "\u3000"])
def test_packing_long_white_space(library, blank):
    """Runs that the compiled pattern engine cannot step back through."""
    model = packing._ids(BYTE)
    for n, around in [(5_000_000, "{}"), (1_000_000, "a {}b{}"), (3_000, "{}x{}<|endoftext|>{}."), (999, "{}a"), (1_000, "{} a"), (1_001, "\n{}\t1")]:
        text = around.replace("{}", blank * (n // len(blank)))
        assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == library[BYTE].encode(text, add_special_tokens=False).ids


def test_crc_of_ids(df):
    pieces = packing.cut_pieces(df, BYTE, 64).withColumn("crc", F.crc32("ids")).collect()
    assert all(r["crc"] == zlib.crc32(bytes(r["ids"])) for r in pieces)


# ---- memos

def test_memos_are_bounded_in_bytes():
    """Paragraphs without blanks are not remembered, and what is remembered
    stays within its bytes."""
    from sys import getsizeof

    from newsts.llm.chunks import LONGEST, BoundedMemo
    from newsts.llm.shingles import WordHashes
    model = bpe.ByteBpe(tokenizer_path(BYTE))
    plain = [f"{i:05d}" + "\u6f22\u5b57" * 500 for i in range(300)]
    before = bpe.ByteBpe(tokenizer_path(BYTE)).encode(plain[:3])
    assert model.encode(plain)[:3] == before
    assert len(model.chunks.later) == len(model.chunks.first) == 0 and all(len(k) <= LONGEST for k in model.pieces)
    hashes = WordHashes()
    assert hashes(plain[0]) and not hashes.known
    memo = BoundedMemo(20_000)
    for i in range(5_000):
        memo.remember(f"word{i}", b"x" * (i % 50))
        held = sum(getsizeof(k) + getsizeof(v) for k, v in memo.items())
        assert held <= memo.held <= 20_000
    assert memo and "word4999" in memo


# ---- rows are numbered once

def test_numbers_do_not_follow_the_splits(spark, tmp_path, corpus):
    """The splits of a scan follow the cores of the moment: a table that is
    planned anew for every job gives the same rows."""
    import corpus_pipeline
    from newsts.llm import common
    from newsts.llm.near_dedup import near_dedup

    from .conftest import frame
    rows = [(1000 * k + (i or 0), t) for k in range(3) for i, t in corpus]
    frame(spark, rows).repartition(6).write.parquet(str(tmp_path / "t"))
    docs, kept = spark.read.parquet(str(tmp_path / "t")), common.store

    def show():
        found = [corpus_pipeline.exact_dedup_stage, corpus_pipeline.near_dedup_stage, corpus_pipeline.suffix_dedup_stage]
        return [bag((r["doc_id"], r["text"]) for r in stage(spark, docs, "").collect()) for stage in found] + [
            bag((r["doc_id"], bytes(r["kept"])) for r in suffix_dedup(docs).collect()),
            bag((r["doc_id"], r["class_id"], r["kept"]) for r in near_dedup(docs).collect())]

    want, turn = show(), [0]

    def shaken(df, what):
        turn[0] += 1
        for name, value in (("leafNodeDefaultParallelism", (4, 64)[turn[0] % 2]), ("files.maxPartitionBytes", (1 << 14, 1 << 27)[turn[0] % 2])):
            spark.conf.set(f"spark.sql.{name}", str(value))
        return kept(df, what)

    import newsts.llm.exact_dedup as e
    import newsts.llm.near_dedup as n
    import newsts.llm.suffix_dedup as s
    places = [common, corpus_pipeline, e, n, s]
    try:
        for m in places:
            m.store = shaken
        got = show()
    finally:
        for m in places:
            m.store = kept
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert turn[0] > 20 and got == want


# ---- 8, hot grams

def test_suffix_dedup_of_hot_grams(spark, corpus, monkeypatch):
    """Windows of frequent grams, grouped by their bytes, give the same cuts,
    whatever counts as frequent."""
    import random

    from newsts.llm import suffix_dedup as s

    from .conftest import frame, words
    rng = random.Random(8)
    passage = words(rng, 60)
    rows = [(i, words(rng, 8) + " " + passage + " " + words(rng, 8)) for i in range(120)] + [(1000 + (i or 0), t) for i, t in corpus if t and len(t) < 5000]
    table = frame(spark, rows).repartition(5)
    want = bag((i, n, len(cuts), kept) for i, n, cuts, kept in brute_spans(rows))
    calls, kept = [], s.hot_spans
    monkeypatch.setattr(s, "hot_spans", lambda sent: calls.append(1) or kept(sent))
    for hot in (1, 20, 10**6):
        monkeypatch.setattr(s, "HOT", hot)
        got = s.suffix_dedup(table).collect()
        assert bag((r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in got) == want
    assert len(calls) == 2
