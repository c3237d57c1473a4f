"""File sources (S1-S5, S13-S15).  Schemas are declared (no inference pass);
text formats are parsed with built-in split / cast expressions."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

def read_table(spark: SparkSession, path: str, schema: str | T.StructType, date_col: str = "Date",
               fmt: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with a header and a declared schema; the date column parsed
    after the scan (malformed values → null, PERMISSIVE)."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.withColumn(date_col, F.to_date(F.col(date_col).cast("string"), fmt))


def read_series(spark: SparkSession, path: str, name: str, ratio: float = 1.0, value_col: str = "Price",
                date_col: str = "Date") -> DataFrame:
    """A named series (date, name) keeping the first floor(n·ratio) rows
    in date order.  n is a scalar subquery; the row numbers come from the
    series' own window (a daily table)."""
    df = read_table(spark, path, f"{date_col} string, {value_col} double", date_col)
    df = df.select(F.col(date_col).alias("date"), F.col(value_col).alias(name))
    if ratio >= 1.0:
        return df
    n = df.select(F.count(F.lit(1))).scalar()
    rn = F.row_number().over(Window.orderBy("date"))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= F.floor(n * F.lit(ratio))).drop("_rn")


def read_csv_after(spark: SparkSession, path: str, header_regex: str, schema: str, sep: str = ",") -> DataFrame:
    """S3: CSVs whose header is preceded by information lines: the lines of
    each file after its first header line, whatever they look like, parsed
    with ``from_csv``; blank lines are dropped, a file without a header has no
    rows.

    Files are read as Spark splits them.  A line's place is its file, the
    start of its split and its number there; the least place of a header line
    of each file is a grouped minimum.  The lines are stored first, since
    another scan may be split otherwise.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                                         F.monotonically_increasing_id().alias("line"))
    lines = cut_lineage(lines.withColumn("value", F.regexp_replace("value", r"\r$", "")))
    head = lines.filter(F.col("value").rlike(header_regex)).groupBy("file").agg(F.min(F.struct("split", "line")).alias("head"))
    data = lines.join(head, "file").filter((F.struct("split", "line") > F.col("head")) & (F.trim("value") != ""))
    return data.select(F.from_csv("value", schema, {"sep": sep}).alias("r")).select("r.*")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Tables with ``array<float>`` cells (parquet keeps them typed)."""
    return spark.read.parquet(path)


def read_contracts(spark: SparkSession, paths: dict[str, str], date_col: str = "Date") -> DataFrame:
    """One file per contract renamed to its name, then an n-way inner
    date join (J6)."""
    dfs = [read_table(spark, p, f"{date_col} string, Price double", date_col).withColumnRenamed("Price", name)
           for name, p in paths.items()]
    return functools.reduce(lambda a, b: a.join(b, on=date_col, how="inner"), dfs)


def read_word_vectors(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """``word v1 … vd`` lines → (word, array<float>); a first line with
    only two numbers (count, dim header) is skipped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("p"))
    parts = parts.filter(F.size("p") > 2)
    if dim:
        parts = parts.filter(F.size("p") == dim + 1)
    return parts.select(F.col("p")[0].alias("word"),
                        F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: x.cast("float")).alias("vector"))


def read_doc_terms(spark: SparkSession, path: str, vocab_path: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """One document per line, ``doc_id id1 id2 …`` (the id is carried
    in the line: file order is never used as a key), and a ``term id``
    vocabulary file."""
    p = spark.read.text(path).select(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("p"))
    docs = p.select(F.col("p")[0].cast("long").alias("doc_id"),
                    F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: x.cast("long")).alias("ids"))
    vocab = None
    if vocab_path:
        v = spark.read.text(vocab_path).select(F.split(F.trim("value"), " ").alias("p"))
        vocab = v.select(F.col("p")[0].alias("term"), F.col("p")[1].cast("long").alias("term_id"))
    return docs, vocab


def read_topic_matrix(spark: SparkSession, path: str, k: int, sep: str = " ") -> DataFrame:
    """A k-column numeric text matrix → columns Topic1..Topick (the
    first field of each line is its row key)."""
    p = spark.read.text(path).select(F.split(F.trim("value"), sep).alias("p"))
    return p.select(F.col("p")[0].cast("long").alias("row"),
                    *[F.col("p")[i + 1].cast("double").alias(f"Topic{i + 1}") for i in range(k)])
