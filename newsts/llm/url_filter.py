"""URL filters by a trie over host labels and path segments (operator 12).

A rule is a host, a path and an action.  It fits the urls of its host and of
all subdomains whose path starts with its own; of the fitting rules the one
with the longest host wins, then the one with the longest path.  An allow and
a block rule with the same host and path count as block.

The rules are a trie over the labels of the host from the last to the first;
below a host hangs a trie over the segments of the path.  Only the last
segment of a rule's path may match the start of a segment.  The trie is
broadcast.  It holds at most a documented number of bytes of rules; larger
rule sets are dealt into as many tries, which pass over the urls one after the
other, each against the longest match found so far.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns, store

RULE_BYTES = 16 << 20  # documented parameter: bytes of the rules in one broadcast trie
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # host, path, action


def split_url(url):
    """(host, path) columns: the host stands after the first ``://`` up to
    ``/``, ``?``, ``#`` or the end, A-Z in lower case; the path goes on to
    ``?``, ``#`` or the end.  Both are empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


class PathNode:
    """Rules below one host: ``starts`` maps the start of the next segment to
    its rule, ``lengths`` are the lengths of those starts, longest first."""

    __slots__ = ("below", "lengths", "starts")

    def __init__(self):
        self.below: dict[str, PathNode] = {}
        self.starts: dict[str, Rule] = {}
        self.lengths: list[int] = []


class HostNode:
    __slots__ = ("below", "paths")

    def __init__(self):
        self.below: dict[str, HostNode] = {}
        self.paths: PathNode | None = None


class RuleTrie:
    def __init__(self, rules: Iterable[Rule]):
        self.rules = list(rules)
        self.root = HostNode()
        for host, path, action in self.rules:
            self.add(host, path, action)

    def __reduce__(self):
        return RuleTrie, (self.rules,)  # nested nodes would be pickled by recursion

    def add(self, host: str, path: str, action: str) -> None:
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.below.setdefault(label, HostNode())
        node.paths = at = node.paths or PathNode()
        *whole, last = path.split("/")
        for segment in whole:
            at = at.below.setdefault(segment, PathNode())
        known = at.starts.get(last)
        if known is None:
            at.lengths = sorted({*at.lengths, len(last)}, reverse=True)
        if known is None or action == "block":
            at.starts[last] = (host, path, action)

    @staticmethod
    def _longest(node: PathNode, segments: list[str]) -> Rule | None:
        found = None
        for segment in segments:
            for n in node.lengths:
                rule = node.starts.get(segment[:n]) if n <= len(segment) else None
                if rule:
                    found = rule
                    break
            node = node.below.get(segment)
            if node is None:
                break
        return found

    def match(self, host: str, path: str) -> Rule | None:
        """The rule with the longest host, then the longest path, that fits."""
        hosts = [self.root] if self.root.paths else []
        node = self.root
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            if node.paths:
                hosts.append(node)
        if hosts:
            segments = path.split("/")
            for at in reversed(hosts):
                if rule := self._longest(at.paths, segments):
                    return rule
        return None


def _rank(rule: Rule | None) -> tuple:
    return (rule is not None, *((rule[0].count(".") + bool(rule[0]), len(rule[1]), rule[2] == "block") if rule else ()))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url",
               rule_bytes: int = RULE_BYTES) -> DataFrame:
    """page_id, url, host, path, rule, verdict: one row per input row.

    ``rules`` has host, path and action (allow or block); hosts are compared
    with A-Z in lower case, a null path is ``/``, a rule with a null host or
    another action is an error.  An empty host fits every url.  ``rule`` is
    the host and path of the winner, null if none fits, and the verdict is
    then ``default``.  A null url and one without ``://`` have an empty host
    and path.  Repeated rows and null ids keep their rows; without rules every
    url gets the default.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    urls = (columns(pages, page_id=(id_col, "long"), url=(url_col, "string"))
            .select("page_id", "url", host.alias("host"), path.alias("path"),
                    F.lit(None).cast("string").alias("rule_host"), F.lit(None).cast("string").alias("rule_path"),
                    F.lit(default).alias("verdict")))
    listed = store(columns(rules, host=("host", "string"), path=("path", "string"), action=("action", "string"))
                   .select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "action")
                   .distinct(), "rules")
    if not listed.filter("host IS NULL OR action IS NULL OR action NOT IN ('allow', 'block')").isEmpty():
        raise ValueError("a rule needs a host and the action allow or block")
    size = listed.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 8)).first()[0] or 0
    parts = -(-int(size) // rule_bytes)
    names = urls.columns

    def passed(urls: DataFrame, trie) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = trie.value.match
            for batch in bounded_batches(batches, "url"):
                seen = [batch.column(c).to_pylist() for c in ("host", "path", "rule_host", "rule_path", "verdict")]
                out = []
                for host, path, rule_host, rule_path, verdict in zip(*seen, strict=True):
                    before = (rule_host, rule_path, verdict) if rule_host is not None else None
                    found = match(host, path)
                    best = before if _rank(before) >= _rank(found) else found
                    out.append(best or (None, None, verdict))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:4]],
                                                  *[pa.array([r[k] for r in out], pa.string()) for k in range(3)]], names=names)

        return urls.mapInArrow(run, "page_id long, url string, host string, path string, rule_host string, rule_path string, verdict string")

    for k in range(parts):
        part = listed.filter(F.pmod(F.xxhash64("host", "path"), F.lit(parts)) == k)
        trie = spark.sparkContext.broadcast(RuleTrie((r["host"], r["path"], r["action"]) for r in part.collect()))
        urls = passed(urls, trie)
        if k + 1 < parts:
            urls = store(urls, "urls")
    return urls.select("page_id", "url", "host", "path", F.concat("rule_host", "rule_path").alias("rule"), "verdict")
