"""Training-data pipeline over ``documents``: toxic documents go, then exact
copies, then near copies, then repeated passages; the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``.  All
but the last return the columns of ``docs``.  Rows are told apart by their
place in the files of ``docs``, so repeated, equal or null ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsts.llm import packing
from newsts.llm.common import documents, placed, store
from newsts.llm.exact_dedup import exact_dedup
from newsts.llm.near_dedup import near_dedup
from newsts.llm.queries import BYTE_BPE
from newsts.llm.suffix_dedup import suffix_dedup
from newsts.llm.toxicity import reject_toxic

ROW = "__row"


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    return rows.join(store(dropped.select(F.col("rid").alias(ROW)), "dropped"), ROW, "left_anti").drop(ROW)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier chain does not reject.  It is fitted on
    the labelled rows of the whole ``documents``; without labels nothing is
    rejected.  Null and empty texts stay; repeated rows share their fate."""
    return reject_toxic(docs, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space: the
    longest, then the smallest doc_id, null ids last.  Null counts as empty, so
    one row of all null and blank texts stays."""
    rows = placed(docs, ROW)
    return _without(rows, exact_dedup(rows, row_col=ROW).filter("NOT kept"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the smallest doc_id, null ids
    last.  Texts without words, null ones too, have no duplicates and stay."""
    rows = placed(docs, ROW)
    return _without(rows, near_dedup(rows, row_col=ROW).filter("NOT kept"))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with texts without repeated passages; ``n_chars`` follows the
    text.  A null text becomes an empty one; the first of repeated rows keeps
    its text."""
    rows = placed(docs, ROW)
    kept = suffix_dedup(rows, as_text=True, row_col=ROW).select(F.col("rid").alias(ROW), F.col("kept").alias("__kept"))
    joined = rows.drop("text").join(kept, ROW)
    new = {"text": F.col("__kept"), "n_chars": F.length("__kept").cast("long")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``op9_packing`` over ``docs``: the pieces of every document
    and their places.  A null or empty text is one piece of its end id alone;
    rows with the same doc_id, or none, are documents of their own."""
    pieces = packing.cut_pieces(docs, BYTE_BPE)
    pieces = store(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.assign(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]

# a classifier and a tokenizer cannot be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
