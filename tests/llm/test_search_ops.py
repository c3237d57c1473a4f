"""Operators 11, 12 and 13 against brute force on awkward rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsts.llm import reversed_search as search
from newsts.llm import token_alignment as align
from newsts.llm.common import spread_join, store, tokenizer_path
from newsts.llm.queries import BYTE_BPE, OP11_SQL, OP12_SQL, PIECE_BPE, URL_RULES, op11_reversed_search, op12_url_filter
from newsts.llm.url_filter import RuleTrie, url_filter

from .conftest import SF001, frame, words


def bag(rows):
    return Counter(map(tuple, rows))


def in_sql(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(sql)


# ---- 11

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_search(docs, items, top):
    counted = [(i, Counter(brute_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        asked, scores = Counter(brute_terms(text)), []
        for i, c in counted:
            n = sum(c.values())
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item_id, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return out


ITEMS = [(0, None), (1, ""), (2, "!?"), (None, "zzz"), (5, "zzz zzz"), (5, "zzz zzz")]


def test_terms():
    text = "It's A-1_b\x00É漢字 İK\x7f😀[x]"
    assert [t.decode() for t in search.terms(text)] == brute_terms(text)
    assert search.terms(None) == search.terms(" .,") == []


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_terms_of_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert [t.decode() for t in search.terms(text)] == brute_terms(text)


@pytest.mark.parametrize("item_bytes", [search.ITEM_BYTES, 200])
def test_reversed_search(spark, df, corpus, item_bytes):
    """Also with the items dealt into several indexes."""
    items = ITEMS + [(i, corpus[i][1][:300]) for i in range(6, 12)]
    got = search.reversed_search(df, frame(spark, items, "item_id"), 4, item_bytes=item_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert bag(got.collect()) == bag(brute_search(corpus, items, 4))


def test_reversed_search_ties_and_blocks(spark, monkeypatch):
    """Equal scores by ascending id, null ids last, over many tasks and blocks."""
    rows = [(i, "same words here") for i in range(40)] + [(None, "same words here"), (99, "other words")] * 3
    monkeypatch.setattr(search, "CELLS", 3)
    got = search.reversed_search(frame(spark, rows).repartition(7), frame(spark, [(1, "same same")], "item_id"), 45)
    assert bag(got.collect()) == bag(brute_search(rows, [(1, "same same")], 45))


def test_reversed_search_empty(spark, df, empty):
    items = frame(spark, ITEMS, "item_id")
    assert search.reversed_search(empty, items).count() == 0
    assert search.reversed_search(df, items.limit(0)).count() == 0
    assert search.reversed_search(frame(spark, [(1, None), (2, "  ")]), items).count() == 0


def test_reversed_search_sql(spark):
    want = in_sql(OP11_SQL, documents=f"{SF001}/documents.parquet", benchmark=f"{SF001}/benchmark.parquet").fetchall()
    assert bag(op11_reversed_search(spark, SF001).collect()) == bag(want) and want


def test_blocks_bound_the_work():
    import numpy as np
    work = np.array([5, 1, search.CELLS, 7, 0, 0])
    assert list(search.blocks(work, 1)) == [(0, 2), (2, 3), (3, 6)]
    assert list(search.blocks(work[:0], 1)) == []


# ---- 12

URLS = ["http://Example.COM/en/1", "https://www.example.com/en/2?x=/en/", "http://a.www.example.com/en/", "http://notexample.com/en/",
        "http://example.com/en", "http://example.com", "http://com/", "http://x.net/es/1#t", "http://x.net/fr", "http://net/fr/",
        "ftp://x.org/a", "x.com/en/", "", None, "a://b://c.com/x", "http://x.com:80/", "http://u@x.com/\n/y", "http://.com/", "http:///en/",
        "http://É.com/É", "http://a..net/es/", "https://x.com?y=/z", "http://net./es/"]


def brute_rule(url, rules):
    rest = (url or "").partition("://")
    rest = rest[2] if rest[1] else ""
    host = re.sub("[A-Z]", lambda m: m.group().lower(), re.match("[^/?#]*", rest).group())
    path = re.match("[^?#]*", rest[len(host):]).group()
    fit = [(h.count(".") + bool(h), len(p), a == "block", h + p, a) for h, p, a in rules
           if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def rule_rows(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, action string").withColumn("verdict", F.lit("x"))


RULES = [*URL_RULES, ("example.com", "/en/1", "allow"), ("x.net", "/e", "allow"), ("x.net", "/e", "block"), ("org", "", "block"),
         ("", "/es", "block"), ("net", "/es/", "block"), ("X.com", "/a/b", "block")]


@pytest.mark.parametrize("rules", [URL_RULES, RULES])
@pytest.mark.parametrize("rule_bytes", [1 << 20, 30])
def test_url_filter(spark, rules, rule_bytes):
    """Also with the rules dealt into several tries."""
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[1])]
    got = url_filter(frame(spark, rows, "page_id", "url"), rule_rows(spark, rules), rule_bytes=rule_bytes)
    want = [(i, u, *brute_rule(u, [(h.lower(), p, a) for h, p, a in rules])) for i, u in rows]
    assert bag(got.collect()) == bag(want)


labels = st.lists(st.sampled_from(["a", "b", "", "ab"]), min_size=1, max_size=3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(labels, labels, st.booleans()), max_size=8), labels, labels)
def test_trie(rules, host, path):
    listed = [(".".join(h), "/".join(p), "block" if b else "allow") for h, p, b in rules]
    trie = RuleTrie(listed)
    found = trie.match(".".join(host), "/".join(path)) or (None, None, "allow")
    fit = [(len(h) if ".".join(h) else 0, len("/".join(p)), b, ".".join(h), "/".join(p)) for h, p, b in rules
           if not ".".join(h) or host[-len(h):] == h and "/".join(path).startswith("/".join(p))]
    fit = [f for f in fit if "/".join(path).startswith(f[4])]
    best = max(fit, default=None)
    assert (found[:2], found[2]) == (((best[3], best[4]), "block" if best[2] else "allow") if best else ((None, None), "allow"))


def test_trie_deep_and_empty(spark):
    import pickle
    deep = [(".".join("x" * 5000), "/" + "a/" * 5000, "block")]
    trie = pickle.loads(pickle.dumps(RuleTrie(deep)))
    assert trie.match(deep[0][0], deep[0][1] + "b") == deep[0]
    assert trie.match("x.x", "/a/") is None
    no_rules = rule_rows(spark, URL_RULES).limit(0)
    rows = frame(spark, [(1, "http://x.com/"), (2, None)], "page_id", "url")
    assert {r["verdict"] for r in url_filter(rows, no_rules, "block").collect()} == {"block"}
    assert url_filter(rows.limit(0), rule_rows(spark, URL_RULES)).count() == 0
    with pytest.raises(ValueError):
        url_filter(rows, rule_rows(spark, [("x", "/", "maybe")]))


def test_url_filter_sql(spark):
    want = in_sql(OP12_SQL, pages=f"{SF001}/pages.parquet").fetchall()
    assert bag(op12_url_filter(spark, SF001).collect()) == bag(want) and want


# ---- 13

@pytest.fixture(scope="module")
def sides():
    return align.Side(tokenizer_path(BYTE_BPE)), align.Side(tokenizer_path(PIECE_BPE))


def brute_alignment(sides, rows):
    """Rows (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    a, b = sides
    links, said = {}, {}
    for t in {t for _, t in rows if t}:
        spans = []
        for side in (a, b):
            ids, end, out = side.encode([t])[0], 0, []
            for i in ids:
                out.append((end, end + len(side.strings[i]), i))
                end = out[-1][1]
            spans.append(out)
        whole = (" " + t).encode()
        if any(b"".join(side.strings[i] for *_, i in out) != whole for side, out in zip(sides, spans)):
            continue
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        for e in both:
            groups.append("|".join(",".join(str(i) for x, y, i in out if start < y <= e) for out in spans))
            start = e
        links[t] = [(i, j) for x, y, i in spans[0] for u, v, j in spans[1] if x < v and u < y]
        said[t] = (len(spans[0]), len(spans[1]), len(groups), ";".join(groups))
    counts = Counter(p for _, t in rows for p in links.get(t, ()))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for i, t in rows:
        if t not in links:
            out.append((i, 0, 0, 0, 0, 0, 0, "", ""))
            continue
        n_a, n_b, n_groups, groups = said[t]
        best = sum(counts[p] == most[p[1]] for p in links[t])
        out.append((i, n_a, n_b, n_groups, len(links[t]), best, sum(counts[p] for p in links[t]),
                    hashlib.sha256(groups.encode()).hexdigest(), groups))
    return out


ODD = [(900, "a  b\n\tc \u2581x"), (901, "<s> </s> <unk> <0x41> <|endoftext|>"), (902, "ﬁne ① ﷺ"), (903, "\x00 null"), (904, " "),
       (905, "\u200b\ufeff"), (906, "é"), (907, "é😀"), (908, "\u2581"), (909, "\r\n\x85\u3000")]


@pytest.mark.parametrize("block", [align.BLOCK_BYTES, 700])
def test_alignment(spark, sides, corpus, monkeypatch, block):
    rows = [(i, t if t is None else t[:3000]) for i, t in corpus] + ODD
    monkeypatch.setattr(align, "BLOCK_BYTES", block)
    monkeypatch.setattr(align, "STEP_BYTES", block // 3)
    monkeypatch.setattr(align, "PAIR_ROWS", 37)
    got = align.align_tokens(frame(spark, rows).repartition(3), BYTE_BPE, PIECE_BPE, with_groups=True)
    assert got.columns == ["doc_id", *align.MEASURES, "groups_sha256", "groups"]
    assert bag(got.collect()) == bag(brute_alignment(sides, rows))


def test_alignment_empty(empty):
    got = align.align_tokens(empty, BYTE_BPE, PIECE_BPE)
    assert got.count() == 0 and got.columns == ["doc_id", *align.MEASURES, "groups_sha256"]


def test_alignment_of_whole_table(spark, sides):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 4000]
    got = align.align_tokens(docs.filter("coalesce(length(text), 0) < 4000"), BYTE_BPE, PIECE_BPE, with_groups=True)
    assert bag(got.collect()) == bag(brute_alignment(sides, rows))


def test_spread_join(spark, monkeypatch):
    """A hot key, null keys and keys without a group; every row once."""
    from newsts.llm import common
    monkeypatch.setattr(common, "HOT_LEAST", 10)
    monkeypatch.setattr(common, "HOT_SHARE", 20)
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}" if i % 3 == 1 else None) for i in range(900)]
    table = store(spark.createDataFrame(rows, "rid long, key string"), "rows")
    groups = store(spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("unused", 4)], "key string, x long"), "groups")
    want = {"hot": 1, "k1": 2, "k2": 3}
    assert bag(spread_join(table, groups, "key", "rid").select("rid", "key", "x").collect()) == bag((i, k, want.get(k)) for i, k in rows)


def test_random_texts(sides):
    """The vectorised groups and links of one text after another."""
    import random
    rng = random.Random(3)
    aligner = align.Aligner(tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE))
    texts = [words(rng, 1 + rng.randrange(30)) for _ in range(20)] + ["", "\u2581", "x"]
    good, groups, counts, links, to = aligner.align(texts)
    want = brute_alignment(sides, list(enumerate(texts)))
    assert good == [bool(w[1]) for w in want]
    assert groups == [w[8] for w in want if w[1]]
    assert [tuple(c) for c in counts.tolist()] == [w[1:5] for w in want if w[1]]
    assert to[-1] == len(links) == sum(w[4] for w in want)
