"""Main text of web pages by equivalence-class template deduction (operator 3).

1. Every page is parsed once into tokens.  The token of a tag is the path of
   its element (names and classes), a chained digest; the token of a text is
   its path with the text.
2. The occurrence vector of a token counts it on each page of a host, copies
   of a page being one page.  It is kept as the exclusive or of a number for
   each (page, count), so vectors of any host, however large, are built by
   grouped aggregation, and equal vectors have equal numbers.
3. Tokens of a host with equal vectors are an equivalence class.  A class that
   occurs on at least half of the host's pages, three at least, and holds a tag
   is valid if its tokens keep their order on all pages and stand in the same
   class on all of them.  The class that a class stands in is its parent: the
   valid classes nest into the template.
4. What is left are the slots of the template: the texts that are in no valid
   class, below the elements of the classes.  On each page the slot that holds
   most text is searched from the root down, and the pages of a host agree on
   one by the text they hold.  Pages of hosts without a template search alone.
5. Names of elements, classes, ids and roles are evidence.  Named menus,
   headers, footers, sidebars, notices, adverts, forms and comments are left
   out of the slot; but a class, id, role, form or header that holds the bulk
   of the text, where next to none is outside such elements, counts as what it
   holds.  An article or main element weighs more in the search, and inside
   one texts of the template are kept.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns, passing, spread_join, store
from .shingles import mix

# documented parameters: pages that a valid class occurs on, at least; weight
# of text in an article or main element, and of a link's text, in the search;
# share of an element's text that a slot in it must hold for the search to go
# on there; share of text outside named elements below which names are doubted
LEAST_PAGES, MAIN_WEIGHT, LINK_WEIGHT, DESCEND, DOUBT = 3, 4.0, 0.25, 0.5, 0.1

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|select)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDING = re.compile(r"display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

# fixed values: elements of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big canvas cite code data del dfn em font i img ins kbd label mark math object q s samp small "
             "span strike strong sub sup svg time tt u var wbr".split())
CLOSED_BY = {  # an open element that a start tag ends
    "p": set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
             "li main menu nav ol p pre section table ul".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option"}, "head": {"body"},
}
# fixed values: elements and words of class, id or role that mark what is not
# main text; the latter, and the elements that may wrap a page, can be doubted
OUTSIDE = set("head title nav footer aside menu button dialog".split())
DOUBTED = {"form", "header"}
OUTSIDE_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising banner "
    "sponsor sponsored promo promotion cookie cookies consent notice notices gdpr popup modal newsletter subscribe subscription "
    "signup login comment comments disqus reply replies respond share sharing social related recommended search pagination pager "
    "toolbar widget copyright contentinfo complementary".split())
MAIN = {"article", "main"}
CONTAINERS = set("html body div section article main center table tbody tr td".split())
HEADINGS = {"h1", "h2", "h3"}

TEXT, BLOCK, NEVER, NAMED, SEMANTIC, CONTAINER, LINK, HEADING = (1 << k for k in range(8))


def _digest(path: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), path & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


class Open:
    """The open elements, with the place of the last of each name, so that no
    tag looks through a deep page."""

    def __init__(self):
        self.names: list[str] = []
        self.event: list[int] = []
        self.path: list[int] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []  # places of elements that are not inline

    def inline(self, name: str) -> bool:
        """Formulas and drawings stand in a line, and so does all in them."""
        return name in INLINE or bool(self.places.get("math") or self.places.get("svg"))

    def push(self, name: str, event: int, path: int) -> None:
        at = len(self.names)
        self.places[name].append(at)
        if name not in INLINE:
            self.blocks.append(at)
        self.names.append(name)
        self.event.append(event)
        self.path.append(path)

    def cut(self, at: int) -> None:
        """Close the element at this place and all in it."""
        while len(self.names) > at:
            name = self.names.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            self.event.pop()
            self.path.pop()

    def close(self, name: str) -> None:
        at = self.places[name][-1] if self.places.get(name) else -1
        if at >= 0 and not (name in INLINE and any(self.places.get(m) and self.places[m][-1] > at for m in MAIN)):
            self.cut(at)

    def start(self, name: str) -> None:
        """Close what this start tag ends."""
        while self.blocks and name in CLOSED_BY.get(self.names[self.blocks[-1]], ()):
            self.cut(self.blocks[-1])


def parse(page: str | None) -> tuple[list[int], list[int], list[int], list[str]]:
    """(token, parent, kind, text) of every tag and text in order: the parent
    is the number of the element that it stands in, or -1; a tag has no text."""
    tokens, parents, kinds, texts = [], [], [], []
    stack, new_block = Open(), True
    for m in _TOKEN.finditer(page or ""):
        name = m["name"]
        if m["text"] is not None:
            path = stack.path[-1] if stack.path else 0
            text = html.unescape(m["text"])
            tokens.append(_digest(path, "\n" + text.strip()))
            parents.append(stack.event[-1] if stack.event else -1)
            kinds.append(TEXT | (BLOCK if new_block else 0) | (LINK if stack.places.get("a") else 0))
            texts.append(text)
            new_block = False
        elif name is None:
            new_block = new_block or m["raw"] is not None
        elif m["close"]:
            name = name.lower()
            new_block = new_block or not stack.inline(name)
            stack.close(name)
        else:
            name, rest = name.lower(), m["rest"]
            new_block = new_block or not stack.inline(name)
            stack.start(name)
            given = {k.lower(): (a or b or c or "").lower() for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest and rest != "/" else {}
            words = {w for k in ("class", "id", "role") if k in given for w in _SPLIT.split(given[k])}
            inside = any(stack.places.get(x) for x in MAIN)
            named = (bool(words & OUTSIDE_WORDS) and name not in ("html", "body") or name == "form" or name == "header" and not inside
                     or "hidden" in given or bool(_HIDING.search(given.get("style", ""))))
            path = _digest(stack.path[-1] if stack.path else 0, ".".join([name, *sorted(set(given.get("class", "").split()))]))
            parent = stack.event[-1] if stack.event else -1
            if name not in VOID and not rest.endswith("/"):
                stack.push(name, len(tokens), path)
            tokens.append(path)
            parents.append(parent)
            kinds.append((NEVER if name in OUTSIDE else 0) | (NAMED if named else 0) | (SEMANTIC if name in MAIN else 0)
                         | (CONTAINER if name in CONTAINERS or "-" in name else 0) | (HEADING if name in HEADINGS else 0))
            texts.append("")
    return tokens, parents, kinds, texts


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for v in values for x in v], kind))


def parsed(pages: DataFrame) -> DataFrame:
    """rid, page_id, url, host, copy (digest of the page) and the tokens,
    parents, kinds, sizes (characters but white space) and texts of each page."""
    names = ["rid", "page_id", "url", "host", "copy", "tokens", "parents", "kinds", "sizes", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "html", 2 << 20):
            found = [parse(p) for p in batch.column("html").to_pylist()]
            clean = [[t.encode("utf-8", "replace").decode() for t in f[3]] for f in found]
            lists = [_lists([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int16()))]
            sizes = [[len("".join(x.split())) for x in t] for t in clean]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:5]], *lists, _lists(sizes, pa.int32()), _lists(clean, pa.string())],
                                             names=names)

    return (pages.withColumn("copy", F.unhex(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)))
            .select("rid", "page_id", "url", "host", "copy", "html")
            .mapInArrow(run, "rid long, page_id long, url string, host string, copy binary, tokens array<long>, "
                             "parents array<int>, kinds array<short>, sizes array<int>, texts array<string>"))


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """host, token, tag (whether it is a tag), vector, pages: one row for each
    token of a host.  Token 0 stands for the page itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "tokens", 2 << 20):
            seen: dict[tuple, list] = {}
            for host, rid, tokens, kinds in zip(*(batch.column(c).to_pylist() for c in ("host", "rid", "tokens", "kinds")), strict=True):
                counts: dict[tuple, int] = {(0, True): 1}
                for token, kind in zip(tokens, kinds, strict=True):
                    key = token, not kind & TEXT
                    counts[key] = counts.get(key, 0) + 1
                spread = mix(np.array(list(counts.values()), np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([rid], np.uint64) + np.uint64(1)))
                for key, n in zip(counts, spread.view(np.int64).tolist(), strict=True):
                    row = seen.setdefault((host, *key), [0, 0])
                    row[0] ^= n
                    row[1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64()),
                 pa.array([k[2] for k in seen], pa.bool_()), pa.array([v[0] for v in seen.values()], pa.int64()),
                 pa.array([v[1] for v in seen.values()], pa.int64())], names=["host", "token", "tag", "vector", "pages"])

    part = pages.select("host", "rid", "tokens", "kinds").mapInArrow(run, "host string, token long, tag boolean, vector long, pages long")
    return part.groupBy("host", "token", "tag").agg(F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """host, rid, tokens and kinds without the later copies of a page on the same host."""
    first = pages.groupBy("host", "copy").agg(F.min("rid").alias("rid")).select("rid")
    return pages.select("host", "rid", "tokens", "kinds").join(first, "rid", "left_semi")


def candidates(vectors: DataFrame) -> DataFrame:
    """host, classes (token, tag, vector): the frequent classes that hold a
    tag.  A token occurs on half of the pages at least, so a list is no longer
    than twice the tokens of an average page."""
    size = vectors.filter("token = 0 AND tag").select("host", F.col("pages").alias("all"))
    frequent = (vectors.join(size, "host").filter((F.col("pages") >= LEAST_PAGES) & (2 * F.col("pages") >= F.col("all"))))
    listed = frequent.groupBy("host", "vector").agg(F.max("tag").alias("structural"), F.collect_list(F.struct("token", "tag", "vector")).alias("own"))
    return listed.filter("structural").groupBy("host").agg(F.flatten(F.collect_list("own")).alias("classes"))


def templates(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """host, template (vector, parent, tags, texts): the valid classes of each
    host, each with the class that it stands in (null for the root)."""
    looked = spread_join(pages.select("host", "rid", "tokens", "parents", "kinds"), listed, "host", "rid").filter("classes IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "tokens", 2 << 20):
            rows: dict[tuple, list] = {}
            known: dict[str, dict] = {}
            for host, tokens, parents, kinds, classes in zip(*(batch.column(c) for c in ("host", "tokens", "parents", "kinds", "classes")), strict=True):
                host = host.as_py()
                if host not in known:
                    known[host] = {(c["token"], c["tag"]): c["vector"] for c in classes.as_py()}
                order: dict[int, list] = {}
                within: list[int | None] = []  # the class of the nearest element in one
                for token, parent, kind in zip(tokens.as_py(), parents.as_py(), kinds.as_py(), strict=True):
                    own = known[host].get((token, not kind & TEXT))
                    above = within[parent] if parent >= 0 else None
                    if own is not None:
                        seen = order.setdefault(own, [above if above != own else None, set(), 0])
                        if token not in seen[1]:
                            seen[1].add(token)
                            seen[2] = _digest(seen[2], str(token))
                    within.append(own if own is not None and not kind & TEXT else above)
                for vector, (above, _, digest) in order.items():
                    row = rows.setdefault((host, vector), [digest, digest, above, above])
                    row[0], row[1] = min(row[0], digest), max(row[1], digest)
                    if above != row[2]:
                        row[1] = row[0] + 1 if row[1] == row[0] else row[1]  # not in one class: invalid
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.int64()),
                 *[pa.array([v[i] for v in rows.values()], pa.int64()) for i in (0, 1, 2)]], names=["host", "vector", "lo", "hi", "above"])

    checked = (looked.select("host", "tokens", "parents", "kinds", "classes")
               .mapInArrow(run, "host string, vector long, lo long, hi long, above long")
               .groupBy("host", "vector").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("above").alias("parent"),
                                              F.max("above").alias("other"), F.count("above").alias("n"), F.count("*").alias("parts")))
    valid = checked.filter("lo = hi AND parent <=> other AND (n = 0 OR n = parts)").select("host", "vector", "parent")
    own = listed.select("host", F.explode("classes").alias("c")).select("host", "c.vector", "c.token", "c.tag")
    each = own.groupBy("host", "vector").agg(F.collect_list(F.when(F.col("tag"), F.col("token"))).alias("tags"),
                                             F.collect_list(F.when(~F.col("tag"), F.col("token"))).alias("texts"))
    return (each.join(valid, ["host", "vector"]).groupBy("host")
            .agg(F.collect_list(F.struct("vector", "parent", "tags", "texts")).alias("template")))


class Slots:
    """The slots of one page: elements, the text below each, and the search."""

    def __init__(self, tokens: list[int], parents: list[int], kinds: list[int], sizes: list[int], tags: set | None, template: set):
        self.tokens, self.parents, self.kinds = tokens, parents, kinds
        once: dict[int, int] = {}
        for token, kind in zip(tokens, kinds, strict=True):
            if kind & CONTAINER:
                once[token] = once.get(token, 0) + 1
        # elements that the search may enter: of the template, where there is one
        self.enter = [bool(k & CONTAINER) and once[t] == 1 and (tags is None or t in tags) or bool(k & SEMANTIC)
                      for t, k in zip(tokens, kinds, strict=True)]
        self.varying = [bool(k & TEXT) and t not in template for t, k in zip(tokens, kinds, strict=True)]
        self.mass = [n * (LINK_WEIGHT if k & LINK else 1.0) if v else 0.0 for n, k, v in zip(sizes, kinds, self.varying, strict=True)]
        self.total = sum(self.mass)

    def outside(self, trusted: set[int]) -> list[bool]:
        """For each event whether it stands in an element that names leave out;
        ``trusted`` paths count as what they hold."""
        out: list[bool] = []
        for token, parent, kind in zip(self.tokens, self.parents, self.kinds, strict=True):
            out.append(parent >= 0 and out[parent] or bool(kind & NEVER) or bool(kind & NAMED) and token not in trusted)
        return out

    def below(self, own: list[float]) -> list[float]:
        """Sums of ``own`` over each event and all below it."""
        total = list(own)
        for e in range(len(total) - 1, -1, -1):
            if self.parents[e] >= 0:
                total[self.parents[e]] += total[e]
        return total

    def doubted(self) -> set[int]:
        """Paths of named elements that hold the bulk of the page's text, where
        hardly any is outside named elements and no article is."""
        trusted: set[int] = set()
        below = self.below(self.mass)
        while True:
            out = self.outside(trusted)
            left = [(m, k) for m, k, o in zip(self.mass, self.kinds, out, strict=True) if not o]
            if sum(m for m, _ in left) > DOUBT * self.total or not self.total:
                return trusted
            if any(below[e] and k & SEMANTIC and not o for e, (k, o) in enumerate(zip(self.kinds, out, strict=True))):
                return trusted
            outer = [e for e, (k, p) in enumerate(zip(self.kinds, self.parents, strict=True))
                     if k & NAMED and not k & NEVER and out[e] and not (p >= 0 and out[p])]
            best = max(outer, key=lambda e: below[e], default=None)
            if best is None or below[best] < DESCEND * self.total:
                return trusted
            trusted.add(self.tokens[best])

    def search(self, trusted: set[int]) -> int:
        """The element that holds the main text; -1 for the whole page."""
        out = self.outside(trusted)
        above: list[int] = []  # the nearest element to enter
        for e, parent in enumerate(self.parents):
            above.append(-1 if parent < 0 else parent if self.enter[parent] and not out[parent] else above[parent])
        inside = [False] * len(out)  # in an article
        for e, parent in enumerate(self.parents):
            inside[e] = bool(self.kinds[e] & SEMANTIC) or parent >= 0 and inside[parent]
        own = [0.0 if o else m * (MAIN_WEIGHT if i else 1.0) for m, o, i in zip(self.mass, out, inside, strict=True)]
        below = self.below(own)
        inner: dict[int, list[int]] = defaultdict(list)
        for e, ok in enumerate(self.enter):
            if ok and not out[e] and below[e]:
                inner[above[e]].append(e)
        at, mass = -1, sum(own)
        while inner[at]:
            best = max(inner[at], key=lambda e: (below[e], -e))
            if below[best] < DESCEND * mass:
                break
            at, mass = best, below[best]
        # an article stands for all in it; a heading beside the text belongs to it
        up = at
        while up >= 0:
            if self.kinds[up] & SEMANTIC:
                return up
            up = self.parents[up]
        headed = self.below([float(bool(k & HEADING) and not o) for k, o in zip(self.kinds, out, strict=True)])
        if at >= 0 and not headed[at]:
            up = above[at]
            if (up >= 0 and headed[up] and below[up] <= 1.3 * below[at]):
                at = up
        return at

    def text(self, texts: list[str], at: int, trusted: set[int]) -> str:
        """The blocks of the slot, joined by one space.  A block goes with the
        template if all of its texts are in it."""
        out = self.outside(trusted)
        under = [at < 0] * len(out)
        semantic = [False] * len(out)
        blocks: list[str] = []
        part: list[str] = []
        own = False  # whether a text of the block is no template
        for e, (parent, kind) in enumerate(zip(self.parents, self.kinds, strict=True)):
            under[e] = under[e] or e == at or parent >= 0 and under[parent]
            semantic[e] = bool(kind & SEMANTIC) or parent >= 0 and semantic[parent]
            if kind & TEXT:
                if kind & BLOCK:
                    blocks.append("".join(part) if own else "")
                    part, own = [], False
                if under[e] and not out[e]:
                    part.append(texts[e])
                    own = own or self.varying[e] or semantic[e]
        blocks.append("".join(part) if own else "")
        return " ".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def _host_sets(batch: pa.RecordBatch, known: dict) -> Iterator[tuple]:
    """(tags, texts) of each row's host; None and nothing without a template."""
    for host, template in zip(batch.column("host").to_pylist(), batch.column("template"), strict=True):
        if host not in known:
            classes = template.as_py()
            known[host] = ((None, set()) if classes is None else
                           ({t for c in classes for t in c["tags"]}, {t for c in classes for t in c["texts"]}))
        yield host, *known[host]


_EVENTS = ("tokens", "parents", "kinds", "sizes")


def votes(pages: DataFrame) -> DataFrame:
    """host, main (the path of the slot that most text of the host is in) and
    trusted (paths of named elements that hold half of it), where the host has
    a template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "tokens", 2 << 20):
            total: dict[tuple, float] = {}
            known: dict = {}
            sets = _host_sets(batch, known)
            for (host, tags, texts), *events in zip(sets, *(batch.column(c).to_pylist() for c in _EVENTS), strict=True):
                page = Slots(*events, tags, texts)
                trusted = page.doubted()
                at = page.search(trusted)
                for kind, token in [("all", 0), *([("main", page.tokens[at])] if at >= 0 else []), *[("trusted", t) for t in trusted]]:
                    total[host, kind, token] = total.get((host, kind, token), 0.0) + page.total
            yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in total], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                                              pa.array(list(total.values()), pa.float64())], names=["host", "kind", "token", "mass"])

    each = store(pages.filter("template IS NOT NULL").select("host", "template", *_EVENTS)
                 .mapInArrow(run, "host string, kind string, token long, mass double")
                 .groupBy("host", "kind", "token").agg(F.sum("mass").alias("mass")), "votes")
    size = each.filter("kind = 'all'").select("host", F.col("mass").alias("all"))
    main = F.max(F.when(F.col("kind") == "main", F.struct("mass", "token")))["token"]
    # at most two paths of nested elements hold more than half: few in all
    trusted = F.collect_list(F.when((F.col("kind") == "trusted") & (2 * F.col("mass") >= F.col("all")), F.col("token")))
    return each.join(size, "host").groupBy("host").agg(main.alias("main"), trusted.alias("trusted"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """rid, page_id, url, host, text: the main text of every page, empty if
    there is none.

    A null page counts as empty.  Pages without a host are a host of their
    own.  Copies of a page get its text, but show no template; null ids are pages
    like any other.
    """
    narrow = (columns(pages, page_id=(id_col, "long"), url=(url_col, "string"), html=(html_col, "string"))
              .withColumn("rid", F.monotonically_increasing_id())
              .withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))))
    read = store(parsed(narrow), "parsed")  # numbers and tokens are made once
    with passing(pages.sparkSession) as keep:
        listed = store(candidates(store(occurrence_vectors(distinct_pages(read)), "vectors")), "candidates")
        found = store(templates(read, listed), "templates")
        with_template = spread_join(read.select("rid", "host", *_EVENTS), found, "host", "rid")
        agreed = keep(found.join(votes(with_template), "host", "left"), "agreed")
    joined = spread_join(read, agreed, "host", "rid")
    names = ["rid", "page_id", "url", "host", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "texts", 2 << 20):
            out, known = [], {}
            rows = zip(_host_sets(batch, known), batch.column("main").to_pylist(), batch.column("trusted").to_pylist(),
                       batch.column("texts").to_pylist(), *(batch.column(c).to_pylist() for c in _EVENTS), strict=True)
            for (_, tags, constant), main, trusted, texts, *events in rows:
                page = Slots(*events, tags, constant)
                trusted = page.doubted() if tags is None else set(trusted or ())
                at = next((e for e, t in enumerate(page.tokens) if t == main and not page.kinds[e] & TEXT), None) if main is not None else None
                if at is None or page.outside(trusted)[at]:
                    at = page.search(trusted)
                out.append(page.text(texts, at, trusted))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:4]], pa.array(out, pa.string())], names=names)

    return joined.select(*names[:4], "template", "main", "trusted", "texts", *_EVENTS).mapInArrow(
        run, "rid long, page_id long, url string, host string, text string")
