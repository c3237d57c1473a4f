"""Driver tables and the daily series derived from them.

Every derived view is a plain DataFrame plan over the parquet scan, so
column pruning and filters reach the scan.  Timestamps arrive as
``TIMESTAMP_NTZ`` and are cast to ``timestamp`` (session time zone UTC).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# fixed values: the five event types of the driver `events` table, in the
# order used for wide daily tables (the label series `purchase` last)
EVENT_TYPES = ["click", "view", "signup", "error", "purchase"]

# fixed value: first day the news stand-in is dated from
NEWS_EPOCH = "2024-01-01"


# text tables: per-row work (tokenising, regexes, stemming) is heavy, so the
# scan must feed every core
TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")
# session setting: tasks over which a text table's rows are dealt (a round-robin
# shuffle of the text); unset or 0: as the files are split.  For text that is
# stored in fewer row groups than there are cores
TEXT_TASKS = "spark.newsts.text.tasks"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, int(spark.conf.get(TEXT_TASKS, "0"))) if name in TEXT_TABLES else df


def spread(df: DataFrame, tasks: int) -> DataFrame:
    """The rows dealt over ``tasks`` tasks; 0 leaves them as they are."""
    return df.repartition(tasks) if tasks else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with their UTC ``Date``.  ``ts`` keeps its stored type
    (``TIMESTAMP_NTZ``, wall time in UTC) so comparisons on it stay
    cast-free and reach the parquet scan as pushed filters; streams cast
    it to ``timestamp`` where a watermark needs one."""
    df = table(spark, sf_dir, "events")
    return df.withColumn("Date", F.to_date("ts"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events seen as a tagged point store:
    (time, measurement, tags, field, value)."""
    e = events(spark, sf_dir)
    return e.select(
        F.col("ts").alias("time"),
        F.lit("events").alias("measurement"),
        F.create_map(F.lit("type"), F.lit("observed"),
                     F.lit("h"), F.lit("0")).alias("tags"),
        F.col("event_type").alias("field"),
        F.col("value").cast("double").alias("value"),
    )


def orders_daily(spark: SparkSession, sf_dir: str, keys=()) -> DataFrame:
    """One long daily price series: Date, Price = avg(o_totalprice)."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(*keys, F.to_date("o_orderdate").alias("Date"))
             .agg(F.avg("o_totalprice").alias("Price")))


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.to_date("l_shipdate").alias("Date"))
              .agg(F.sum("l_quantity").alias("Qty")))


def events_daily_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean value of each event type as columns (label last)."""
    e = events(spark, sf_dir)
    return (e.groupBy("Date").pivot("event_type", EVENT_TYPES)
             .agg(F.avg("value")))


def events_daily_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.groupBy("event_type", "Date").agg(F.avg("value").alias("value"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the news table: Date, ID, News, section."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.date_add(F.lit(NEWS_EPOCH).cast("date"), (F.col("doc_id") % 30).cast("int")).alias("Date"),
        F.col("doc_id").alias("ID"),
        F.col("text").alias("News"),
        F.col("source").alias("section"),
        F.col("lang"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings dated like news: Date, vec_id, label, embedding."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(
        F.date_add(F.lit(NEWS_EPOCH).cast("date"), (F.col("vec_id") % 30).cast("int")).alias("Date"),
        "vec_id", "label", "embedding")
