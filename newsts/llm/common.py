"""Shared helpers of the training-data operators.

Every operator first narrows its input with :func:`columns`, so extra columns
never clash with the names used inside, and cuts lineage with :func:`store`,
a Parquet table in the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# fixed values: the white space of the contracts, [\x20\x09-\x0D]
WHITE_SPACE = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


def columns(df: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """``columns(df, doc_id=("doc_id", "long"), ...)``: exactly the wanted
    columns, cast to the given types, whatever else the table holds."""
    return df.select(*[F.col(f"`{src}`").cast(kind).alias(name) for name, (src, kind) in wanted.items()])


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stored inside the block are deleted at its end, but for those
    stored by the function it gives.  What leaves the block may read no other."""
    first, kept = len(_stored), []

    def keep(df: DataFrame, what: str) -> DataFrame:
        table = store(df, what)
        kept.append(_stored[-1])
        return table

    yield keep
    for path in _stored[first:]:
        if path not in kept:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _stored[first:] = kept


def numbered(df: DataFrame, row_col: str | None = None, **wanted: tuple[str, str]) -> DataFrame:
    """:func:`columns` with ``rid``, a number of each row's own.

    Numbers made anew by every scan may differ, as the splits of a scan follow
    the cores of the moment; so they are made once and stored.  A caller who
    has numbers that stay (see :func:`placed`) names their column.
    """
    if row_col is not None:
        return columns(df, rid=(row_col, "long"), **wanted)
    made = columns(df, **wanted).withColumn("rid", F.monotonically_increasing_id())
    return store(made.select("rid", *wanted), "numbered")


def placed(docs: DataFrame, name: str) -> DataFrame:
    """``docs``, a table as read from files, with a number for each row that
    follows from its file and its place there, however a scan is split.  A table that
    is not read from files is stored with numbers."""
    try:
        files = docs.select(F.col("_metadata.file_path").alias("__file")).distinct()
    except AnalysisException:
        return store(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    # one row for each file, as the scan itself lists them on the driver
    starts = [(r["__file"], k << 40) for k, r in enumerate(sorted(files.collect()))]
    numbers = docs.sparkSession.createDataFrame(starts, "__file string, __start long")
    at = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    return at.join(F.broadcast(numbers), "__file").withColumn(name, F.col("__start") + F.col("__at")).drop("__file", "__start", "__at")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"


_stored: list[str] = []  # folders of this driver's stored tables, in order


def store(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a cut of lineage
    that survives lost executors and keeps columns prunable."""
    path = work_folder(df.sparkSession, what)
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def strip_white_space(text):
    """Column without any character of ``[\\x20\\x09-\\x0D]``."""
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; looked up where it is used, so that
    executors find their own copy."""
    import public_tokenizers
    return public_tokenizers.path(name)


BATCH_BYTES = 8 << 20  # documented parameter: bytes of one column handled at once in a Python task


def bounded_batches(batches, column: str, most: int = BATCH_BYTES):
    """Arrow batches cut into pieces whose ``column`` holds at most ``most``
    bytes, or one row where a single row is larger."""
    for batch in batches:
        start, n = 0, batch.num_rows
        if batch.column(column).nbytes <= most:
            if n:
                yield batch
            continue
        while start < n:
            k = 1
            while start + 2 * k <= n and batch.slice(start, 2 * k).column(column).nbytes <= most:
                k *= 2
            yield batch.slice(start, k)
            start += k


HOT_SHARE, HOT_LEAST = 1000, 1000  # documented parameters of spread_join


def spread_join(rows: DataFrame, groups: DataFrame, key: str, salt_by: str) -> DataFrame:
    """``rows`` left-joined to ``groups``, which has one row per key at most.

    A key with more than 1/HOT_SHARE of all rows, and HOT_LEAST at least, is
    hot; there are at most HOT_SHARE of them, so their list is broadcast.  The
    rows of a hot key are dealt over salts by ``salt_by``, each of which has its
    own copy of the group's row, so no task gets more rows of one key than
    that share.  Both tables should be stored ones.
    """
    most = max(HOT_LEAST, rows.count() // HOT_SHARE)
    hot = store(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > most)
                .select(key, F.ceil(F.col("__n") / most).cast("long").alias("__salts")), "hot")
    if hot.isEmpty():
        dealt, copies = rows.withColumn("__salts", F.lit(1).cast("long")), groups.withColumn("__salt", F.lit(0).cast("long"))
    else:
        dealt = rows.join(F.broadcast(hot), key, "left")
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__salts", F.lit(1)) - 1))
        # stored, so that its size is known to the planner
        copies = store(groups.join(F.broadcast(hot), key, "left").withColumn("__salt", salts).drop("__salts"), "copies")
    number = F.xxhash64(salt_by)
    # null keys meet no group: they are dealt by a salt of their own
    salt = F.when(F.col(key).isNull(), number).otherwise(F.pmod(number, F.coalesce("__salts", F.lit(1))))
    return dealt.withColumn("__salt", salt).drop("__salts").join(copies, [key, "__salt"], "left").drop("__salt")
