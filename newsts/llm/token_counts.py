"""Token counts through a digest cache (operator 7).

A count is stored under the digest of the normalised content and the digest
of the tokenizer file.  The distinct digests of the documents are joined to
the stored counts; only texts of distinct misses are encoded, and their counts
are appended to the cache.  The documents then take their counts from it.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import BoundedMemo
from .common import bounded_batches, columns, spread_join, store, tokenizer_path

CACHE_SCHEMA = "tokenizer binary, digest binary, n_tokens long"

def drops_white_space(path: str) -> bool:
    """Whether a file's normaliser turns white-space runs into one blank and
    its pre-tokeniser keeps only pieces without white space."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (any(s.get("type") == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)
            and any(s.get("type") == "Split" and s["behavior"] == "Removed" and s["invert"] for s in splits))


class Counter:
    """Token counts of whole texts, as the file's library gives them."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._count = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
        self.by_chunk = drops_white_space(path)
        self.known = BoundedMemo()

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_chunk:
            return self._count(texts)
        out = []
        for text in texts:
            chunks = text.split(" ")
            try:
                out.append(sum(map(self.known.__getitem__, chunks)))
            except KeyError:
                found = {c: self.known.get(c) for c in chunks}
                new = [c for c, n in found.items() if n is None]
                for c, n in zip(new, self._count(new), strict=True):
                    found[c] = n
                    self.known.remember(c, n)
                out.append(sum(map(found.__getitem__, chunks)))
        return out


@lru_cache(maxsize=2)
def _counter(name: str) -> Counter:
    return Counter(tokenizer_path(name))


def _version(name: str) -> bytes:
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).digest()


def _normalised(text: Column, name: str) -> Column:
    """Content that decides the count: white-space runs count as one blank
    for a tokenizer that drops white space, else the text itself."""
    if drops_white_space(tokenizer_path(name)):
        return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return text


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty cache is made where there is none."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def stored_counts(cache: DataFrame, version: bytes) -> DataFrame:
    """digest, n_tokens: one row per digest, also where two writers appended the same one."""
    return cache.filter(F.col("tokenizer") == F.lit(version)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache_path: str, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cached: one row per input row.

    A null text counts as empty (0 tokens).  Repeated texts are encoded once;
    repeated rows and null ids keep their rows.  ``cached`` tells that the
    count was stored before this call.
    """
    spark = docs.sparkSession
    version = _version(tokenizer)
    narrow = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    text = F.coalesce("text", F.lit(""))
    keyed = (narrow.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                           _normalised(text, tokenizer).alias("content"))
             .withColumn("digest", F.unhex(F.sha2("content", 256))))
    before = stored_counts(open_cache(spark, cache_path), version)
    # the digests of the rows, read by each of the joins below
    rows = store(keyed.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_bytes", "digest"), "rows")
    misses = store(rows.select("digest").distinct().join(before.select("digest"), "digest", "left_anti"), "misses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in bounded_batches(batches, "content"):
            n = counter.count(batch.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    # copies are reduced in each map task; the rest moves once
    texts = keyed.groupBy("digest").agg(F.first("content").alias("content")).join(misses, "digest", "left_semi")
    (texts.mapInArrow(run, "digest binary, n_tokens long")
     .select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
     .write.mode("append").parquet(cache_path))
    after = stored_counts(spark.read.schema(CACHE_SCHEMA).parquet(cache_path), version)
    new = misses.withColumn("new", F.lit(True))
    counts = store(after.join(rows.select("digest").distinct(), "digest", "left_semi").join(new, "digest", "left"), "counts")
    return (spread_join(rows, counts, "digest", "rid")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
                    F.col("new").isNull().alias("cached")))
