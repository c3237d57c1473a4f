"""Operators 1, 2, 3, 5 and the pipeline: brute force, held-out accuracy,
awkward rows."""

import html
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from newsts.llm import toxicity as T
from newsts.llm.html_text import extract_main_text
from newsts.llm.near_dedup import near_dedup, prob_min_hash
from newsts.llm.shingles import WordHashes, probability_jaccard, weighted
from newsts.llm.site_quality import site_quality

from .conftest import SF001, SF01, frame, words


def slow_similarity(x, y):
    """Probability Jaccard by its definition, on counts of word five-grams."""
    def grams(t):
        w = re.findall(r"\w+", (t or "").lower())
        return Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()
    a, b = grams(x), grams(y)
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in set(a) & set(b))


def brute_classes(rows, similarity=0.8):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [set(re.findall(r"\w+", (t or "").lower())) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.3 * max(len(sets[i]), len(sets[j])) \
                    and slow_similarity(rows[i][1], rows[j][1]) >= similarity - 1e-9:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r[0])
    return groups.values()


def test_near_dedup(df, corpus):
    rows = [r for r in corpus if len(r[1] or "") < 50_000]
    got = near_dedup(df.filter("doc_id is null or doc_id <> 502")).collect()
    want = Counter()
    for ids in brute_classes(rows):
        first = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, first, len(ids)] += 1
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(list(brute_classes(rows))) and all(r["doc_id"] == r["class_id"] for r in kept)


def test_near_dedup_mixed_buckets(spark):
    """Documents around one passage: buckets hold several classes, and a chain
    of near copies is one class even where its ends differ."""
    rng = random.Random(3)
    shared = words(rng, 120)
    rows = [(i, shared + " " + words(rng, 45)) for i in range(30)]
    chain = words(rng, 200).split()
    for i in range(6):
        chain = chain[5:] + words(rng, 5).split()
        rows.append((100 + i, " ".join(chain)))
    got = near_dedup(frame(spark, rows), bands=25, rows=4).collect()
    want = {tuple(sorted(g)) for g in brute_classes(rows)}
    found = defaultdict(list)
    for r in got:
        found[r["class_id"]].append(r["doc_id"])
    assert {tuple(sorted(g)) for g in found.values()} == want
    assert max(len(g) for g in want) == 6


def test_near_dedup_hub(spark):
    """Some hundred edited copies of one original that are alike only through
    it, and copies of copies that only one of these joins."""
    rng = random.Random(11)

    def edited(text):
        w = text.split()
        for at in range(6):
            w[at * 50 + rng.randrange(40) + 5] = words(rng, 1, 4) + str(rng.randrange(10**9))
        return " ".join(w)

    rows = [(1000, words(rng, 300))]
    rows += [(i, edited(rows[0][1])) for i in range(300)]
    rows += [(2000 + i, edited(rows[1 + 9 * i][1])) for i in range(30)]

    def grams(text):
        w = text.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    alike = 0
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
                alike += 1
    assert alike < 400  # of 54,615 pairs
    want = defaultdict(set)
    for i, r in enumerate(rows):
        want[root(i)].add(r[0])
    found = defaultdict(set)
    for r in near_dedup(frame(spark, rows)).collect():
        found[r["class_id"]].add(r["doc_id"])
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
    assert max(map(len, want.values())) > 300


def test_near_dedup_empty(empty):
    assert near_dedup(empty).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    """Chains, stars, rings and random links against a plain union-find."""
    from newsts.llm.near_dedup import components
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300 + i, 300 + (i + 1) % 7) for i in range(7)]
    links += [(500 + rng.randrange(60), 500 + rng.randrange(60)) for _ in range(40)]
    names = {n: rng.randrange(10**9) for x in links for n in x}
    links = [(names[a], names[b]) for a, b in links if a != b]
    parent = {n: n for x in links for n in x}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(parent)
    pairs = {(r["label"], root(r["node"])) for r in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len({root(n) for n in parent})
    assert all(root(a) == b for a, b in pairs)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain(spark, monkeypatch):
    """Rising numbers along a chain need no more rounds than any others."""
    from newsts.llm import near_dedup as n
    rounds, kept = [], n.store
    monkeypatch.setattr(n, "store", lambda df, what: rounds.append(what) or kept(df, what))
    got = n.components(spark.range(9_999).selectExpr("id AS a", "id + 1 AS b"))
    assert got.count() == 10_000 and got.select("label").distinct().count() == 1
    assert rounds.count("parents") <= 20


def test_near_dedup_finds_all_links(spark):
    """Recall against all pairs that share a shingle, on a given table."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    found = {r["doc_id"]: r["class_id"] for r in near_dedup(docs).collect()}
    h, sets, holders = WordHashes(), {}, defaultdict(set)
    for r in docs.collect():
        _, value, weight = weighted([h(r["text"])])
        order = np.argsort(value)
        sets[r["doc_id"]] = value[order], weight[order]
        for v in set(value.tolist()):
            holders[v].add(r["doc_id"])
    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if probability_jaccard(sets[a], sets[b]) >= 0.8]
    assert len(links) > 90 and all(found[a] == found[b] for a, b in links)


def test_prob_min_hash_estimates_similarity():
    rng = random.Random(5)
    base = [words(rng, 1) + str(i % 60) for i in range(120)]
    other = base[:90] + [w + "q" for w in base[90:]]
    texts = [" ".join(base * 2 + base[:30]), " ".join(other * 2)]
    h = WordHashes()
    doc, value, weight = weighted([h(t) for t in texts])
    sig = prob_min_hash(doc, value, weight, 2, 4096)
    order = np.lexsort((value, doc))
    doc, value, weight = doc[order], value[order], weight[order]
    exact = probability_jaccard((value[doc == 0], weight[doc == 0]), (value[doc == 1], weight[doc == 1]))
    assert abs(exact - slow_similarity(*texts)) < 1e-9
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.035


# ---- 1

def test_toxicity_held_out(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = words(rng, 60).split()
        for _ in range(4 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(["idiot", "trash", "krummig" + rng.choice(["er", "es", "heit"])])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = frame(spark, rows)
    known = spark.createDataFrame([x for x in labels if x[0] < 300] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in T.toxicity(docs, docs, known).collect()}
    held = [(t, got[i]["rejected"]) for i, t in labels if i >= 300]
    assert len(got) == 600
    assert sum(t == r for t, r in held) >= 0.97 * len(held)
    assert not any(r for t, r in held if not t)
    assert {r["doc_id"] for r in T.reject_toxic(docs, docs, known).collect()} == {i for i, r in got.items() if not r["rejected"]}


def test_toxicity_awkward(spark, df, empty, corpus):
    known = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.toxicity(df, df, known).collect()
    assert len(got) == len(corpus) and not any(r["rejected"] for r in got)
    assert T.toxicity(empty, df, known).count() == 0
    clean = T.reject_toxic(df, df, known)
    assert clean.columns == df.columns and clean.count() == len(corpus)


def test_chain_feeds_earlier_categories():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 6)) < 0.3).astype(float)
    first = (x[:, 0] + x[:, 1] > 0).astype(float)
    models = T.fit_chain(x, np.stack([first, first], axis=1), np.arange(400) % T.FOLDS)
    assert [len(w) for w in models] == [7, 8]
    p = T.Chain([str(i) for i in range(6)], models).probabilities(x)
    assert p.shape == (400, 2) and ((p[:, 1] > 0.5) == (first > 0)).mean() > 0.99
    assert T.predict(x, T.fit_logistic(x, np.zeros(400))).max() < 0.01


# ---- 5

def test_site_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r["quality"] for r in labels.collect()}
    known = labels.filter("doc_id % 2 = 0").select("doc_id", "quality")
    got = {r["doc_id"]: r for r in site_quality(docs, docs, known).collect()}
    held = [(q, got[i]["kept"]) for i, q in rows.items() if i % 2]
    assert len(got) == docs.count()
    assert sum((q > 0) == k for q, k in held) >= 0.95 * len(held)


def test_site_posteriors_shrink(spark):
    """A sparse site stays near the prior, a large one follows its documents."""
    good, bad = "the end of the day and it was in a house for us to see", "### $$$ %%% *** !!! ### $$$ %%% *** !!!"
    rows = [(i, good if i % 10 else bad, "big", "en") for i in range(200)]
    rows += [(200 + i, bad, "junk", None) for i in range(100)] + [(400, bad, None, "en"), (401, good, "tiny", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(rows[i][1] == good)) for i in range(220)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in site_quality(docs, docs, labels).collect()}
    assert len(got) == len(rows)
    prior = np.mean([r["p_doc"] for r in got.values()])
    assert got[200]["p_host"] < 0.15 < 0.8 < got[1]["p_host"]
    assert abs(got[400]["p_host"] - prior) < abs(got[200]["p_host"] - prior)
    assert got[401]["kept"] and got[1]["kept"] and not got[10]["kept"]


def test_site_quality_awkward(spark, df, empty, corpus):
    from pyspark.sql import functions as F
    known = spark.createDataFrame([], "doc_id long, quality int")
    with_site = df.withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit("en"))
    assert site_quality(with_site, with_site, known).count() == len(corpus)
    none = empty.withColumn("source", F.lit("s")).withColumn("lang", F.lit("en"))
    assert site_quality(none, none, known).count() == 0


# ---- 3

def pages(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumn("rid", F.lit(1)).withColumn("text", F.lit("x")).withColumn("host", F.lit("y"))


def test_html_of_given_pages(spark):
    df = spark.read.parquet(f"{SF001}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_main_text(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        inner = re.sub(r"<(/?)(\w+)[^>]*>", lambda m: "" if m[2] == "b" else " ", inner)
        assert got[r["page_id"]] == " ".join(html.unescape(inner).split())


def test_html_template_and_slots(spark):
    """Boilerplate without telling names goes because it repeats on every page."""
    def page(i):
        return (f"<html><head><title>t{i}</title></head><body><div id=x><p>Our shop is open all day</p></div>"
                f"<div class='side-bar sidebar'>see {i}</div><div><h2>Head {i}</h2><p>Body{i}&nbsp;of\n page <b>n{i}</b>o{i} &amp; more<!-- c --></p></div>"
                f"<section class=comments>I like {i}</section><form>mail {i}<input></form><footer>end {i}</footer>"
                f"<script>if (a < b) '</p>'</script></body></html>")
    rows = [(i, f"https://a.org/{i}", page(i)) for i in range(8)]
    rows += [(20, "https://b.org/", page(1)), (21, None, None), (22, "x", ""), (None, "https://c.org/1", "<p>un<i>clos</i>ed<p>two"),
             (23, "https://d.org", "<main><p>in</p><nav>menu</nav><aside>no</aside></main><p>out</p>"), (0, "https://a.org/0", page(0))]
    got = extract_main_text(pages(spark, rows)).collect()
    by_id = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    assert [by_id[i] for i in range(8)] == [f"Head {i} Body{i} of page n{i}o{i} & more" for i in range(8)]
    assert by_id[20].startswith("Our shop is open all day Head 1")  # one page shows no template
    assert by_id[21] == "" and by_id[22] == "" and by_id[None] == "unclosed two" and by_id[23] == "in"


def test_html_copies_and_shared_passages(spark):
    """A host of copies only, a host half of which are copies, and a passage
    that every article of a small host holds keep their main text."""
    def page(body, article="article"):
        return f"<html><body><div><p>Open all day</p></div><{article}><p>Notes on this work</p><p>{body}</p></{article}></body></html>"
    rows = [(i, f"https://copies.org/{i}", page("Same body")) for i in range(5)]
    rows += [(10 + i, f"https://half.org/{i}", page("Same <em>body</em>", "div")) for i in range(5)]
    rows += [(20 + i, f"https://half.org/b{i}", page(f"Body {i}", "div")) for i in range(4)]
    rows += [(30 + i, f"https://small.org/{i}", page(f"Body {i}")) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages(spark, rows)).collect()}
    assert [got[i] for i in range(5)] == ["Notes on this work Same body"] * 5
    # without an article what all distinct pages share is template; a copy's own body is not
    assert [got[10 + i] for i in range(5)] == ["Same body"] * 5
    assert [got[20 + i] for i in range(4)] == [f"Body {i}" for i in range(4)]
    assert [got[30 + i] for i in range(4)] == [f"Notes on this work Body {i}" for i in range(4)]


def test_html_without_telling_names(spark):
    """Hosts without article elements and without names that tell: the right
    text is known, the rest is menus, teasers and notes of three layouts."""
    rng = random.Random(9)
    layouts = [
        lambda h, b, x: f"<div class=a1><ul><li><a href=/>Home</a><li><a href=/x>{x}</a></ul></div><div class=b7><h1>{h}</h1>{b}</div>"
                        f"<div class=c3><p>Today: {x}</p><p>All rights</p></div>",
        lambda h, b, x: f"<table><tr><td class=l><a href=/1>One</a><br><a href=/2>{x}</a></td><td class=m><h2>{h}</h2>{b}</td></tr></table><p class=z>{x}</p>",
        lambda h, b, x: f"<section class=q><section class=r><div class=s>{x} 12 degrees</div><div class=t><h1>{h}</h1><div class=u>{b}</div></div></section>"
                        f"<div class=v><a href=/9>{words(rng, 9)}</a></div></section>"]
    rows, want = [], {}
    for h, layout in enumerate(layouts):
        for i in range(7):
            head, paras = words(rng, 4), [words(rng, 20 + rng.randrange(60)) for _ in range(2 + rng.randrange(4))]
            page = f"<html><head><title>{head}</title></head><body><div class=top>Our paper since 1900</div>"
            page += layout(head, "".join(f"<p>{p}</p>" for p in paras), words(rng, 2)) + "<div class=end>Made here</div></body></html>"
            rows.append((10 * h + i, f"https://h{h}.org/{i}", page))
            want[10 * h + i] = " ".join([head, *paras])
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("hosts", [1, 5])  # one host of all, or hosts of one page without a template
def test_html_names_alone_drop_nothing(spark, hosts):
    body = "<h1>Head {0}</h1><p>The text of article {0} goes on</p><p>and <math><mi>x{0}</mi></math> <svg><text>s{0}</text></svg> on</p>"
    shells = ['<article class="post overflow-hidden">{}</article>', '<article aria-hidden="false">{}</article>',
              '<article class="search-result">{}</article>', '<main id="related-work">{}</main>',
              '<div class="has-sidebar"><article>{}</article></div>', '<div class="ad-free layout"><main>{}</main></div>',
              '<form class="page">{}</form>', '<div class="widget"><div class="share">{}</div></div>']
    rows = [(10 * k + i, f"https://n{k if hosts == 1 else 10 * k + i}.org/{i}", "<html><body><nav><a href=/>Home</a></nav>"
             + shell.format(body.format(i)) + f"<div class=ad>Buy {i}</div><footer>End {i}</footer></body></html>")
            for k, shell in enumerate(shells) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages(spark, rows)).collect()}
    assert got == {10 * k + i: f"Head {i} The text of article {i} goes on and x{i} s{i} on" for k in range(len(shells)) for i in range(4)}


def test_html_parts_inside_an_article_go(spark):
    page = ("<article class=post><header><h1>Head</h1></header><p>One</p><div class='share-buttons'>Share it</div><aside>Aside</aside>"
            "<form>Mail<input></form><p hidden>no</p><p>Two<noscript>n</noscript></p><section id=comments><article>I agree</article></section></article>")
    assert extract_main_text(pages(spark, [(1, "https://x.org/1", page)])).first()["text"] == "Head One Two"


def test_html_order_makes_a_class_valid(spark):
    """Tokens with one occurrence vector in changing order are no template."""
    from newsts.llm.html_text import candidates, distinct_pages, occurrence_vectors, parsed, templates
    def page(i):
        a, b = ("<p class=x>A text</p>", "<p class=y>B text</p>")
        return f"<html><body><div class=k>{a + b if i % 2 else b + a}</div><div class=n><h1>Fixed</h1>{i}</div></body></html>"
    from pyspark.sql import functions as F
    from newsts.llm.common import store
    rows = pages(spark, [(i, "https://o.org", page(i)) for i in range(6)]).drop("rid").withColumn("rid", F.col("page_id")).withColumn("host", F.lit("o"))
    read = store(parsed(rows), "parsed")
    listed = store(candidates(occurrence_vectors(distinct_pages(read))), "candidates")
    assert len(listed.first()["classes"]) == 11  # 8 tags, 3 texts, one vector with the page itself
    assert templates(read, listed).count() == 0
    same = rows.withColumn("html", F.regexp_replace("html", "<p class=y>B text</p><p class=x>A text</p>", "<p class=x>A text</p><p class=y>B text</p>"))
    read = store(parsed(same), "parsed")
    listed = store(candidates(occurrence_vectors(distinct_pages(read))), "candidates")
    assert [(c["parent"], len(c["texts"])) for c in templates(read, listed).first()["template"]] == [(None, 3)]


def test_html_deep_pages():
    """Time and memory in proportion to the page, whatever is left open."""
    import time

    from newsts.llm.html_text import Slots, parse
    for tag in ("div", "b", "x-y"):
        start = time.process_time()
        *found, texts = parse(f"<{tag}>" * 100_000 + "deep" + "</i></p></b>" * 50_000 + "<p>end")
        page = Slots(*found, [len(t) for t in texts], None, set())
        assert page.text(texts, page.search(page.doubted()), set()).startswith("deep")
        assert time.process_time() - start < 20


def test_html_empty(spark):
    assert extract_main_text(pages(spark, [])).count() == 0


# ---- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    sizes, table = [], docs
    for name, stage in P.STAGES[:-1]:
        table = P.store(stage(spark, table, SF001), name)
        assert table.dtypes == docs.dtypes
        sizes.append(table.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[2] == sizes[3] < docs.count()
    texts = [re.sub(r"\s", "", r["text"]) for r in table.collect() if r["text"]]
    assert len(texts) == len(set(texts))
    # no 100-byte string of the result of the suffix stage was removed twice: every id is in one piece
    pieces = P.STAGES[-1][1](spark, table, SF001).collect()
    per_doc = defaultdict(int)
    for r in pieces:
        per_doc[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert len(per_doc) == sizes[3] and all(n == total for (_, n), total in per_doc.items())
    assert Counter(map(tuple, P.run(spark, SF001).select("doc_id", "start", "length", "ids_crc32").collect())) \
        == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in pieces)


def test_pipeline_awkward_rows(spark, df):
    """Nulls, copies and repeated ids: every stage keeps what it should."""
    import corpus_pipeline as P
    from newsts.llm.exact_dedup import exact_dedup
    table = P.store(P.exact_dedup_stage(spark, df, SF001), "t")
    assert table.count() == exact_dedup(df).filter("kept").count() and table.columns == df.columns
    near = P.store(P.near_dedup_stage(spark, table, SF001), "t")
    cut = P.suffix_dedup_stage(spark, near, SF001)
    assert cut.columns == df.columns and cut.count() == near.count()


@pytest.mark.parametrize("n", range(1, 11))
def test_queries_registered(n):
    from newsts.llm.queries import QUERIES
    assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1


def test_every_stage_takes_awkward_and_empty_tables(spark, df, empty, tmp_path):
    """Nulls, repeated ids and rows, clashing columns; no rows at all."""
    import corpus_pipeline as P
    from pyspark.sql import functions as F
    spark.createDataFrame([(0, 0), (None, 1), (1, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    none = P.store(empty, "t")
    for name, stage in P.STAGES:
        got = stage(spark, none, str(tmp_path))
        assert got.count() == 0 and (name == "packing" or got.columns == empty.columns)
    table = P.store(df, "t")
    assert P.toxicity_stage(spark, table, str(tmp_path)).count() == df.count()
    pieces = P.packing_stage(spark, table, str(tmp_path))
    assert pieces.filter("start = 0").count() == df.count()
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.filter("n <> end OR n > 1024").count() == 0
