"""Structured Streaming operators.

The reference polls (a daily cron that appends, inserts-if-new and
publishes); here the same work runs as streaming queries over landed files:

R1 ``stream_rows``        incremental file ingest (schema fixed up front)
R2 ``stream_insert_new``  insert-if-new on an id within a watermark
R3 ``stream_daily``       daily tumbling aggregate; late rows beyond the
                          watermark are dropped, open days are held back
R4 ``stream_publish``     idempotent publish per micro-batch (anti-join
                          against what the target already holds)
R5 ``stream_decay``       per-series exponential decay state over closed days

Checkpoints and sink folders live under the shared ``spark.checkpoint.dir``
so a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

_AGG = {"mean": F.avg, "sum": F.sum, "max": F.max}


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def stream_rows(spark: SparkSession, directory: str, schema: T.StructType, file_glob: str = "*.parquet",
                fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Files landing in ``directory`` (matching ``file_glob``) as a stream;
    ``TIMESTAMP_NTZ`` columns become ``timestamp`` (watermarks need it)."""
    r = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", file_glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    df = r.load(directory)
    for f in schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def stream_insert_new(df: DataFrame, id_col: str, delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """R2: keep the first row of each id; the id is remembered until the
    watermark passes its event time (bounded state)."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def stream_daily(df: DataFrame, cols: Sequence[str], how: str = "mean", delay: str = "1 day", ts: str = "ts",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Per-day aggregate in event time (append mode emits a day once
    the watermark has passed its end)."""
    agg = _AGG[how]
    g = df.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"), *keys)
    out = g.agg(*[agg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n"))
    return out.select(F.to_date(F.col("w.start")).alias("Date"), *keys, *cols, "n")


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> str:
    """Drive a stream to completion (``availableNow``) into a parquet folder
    under the shared checkpoint dir; returns that folder."""
    spark = df.sparkSession
    d = work_dir(spark, name)
    q = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", os.path.join(d, "_ck"))
           .option("path", os.path.join(d, "data")).trigger(availableNow=True).start())
    q.awaitTermination()
    return os.path.join(d, "data")


def stream_publish(df: DataFrame, target: str, key: str = "Date", name: str = "publish") -> str:
    """Every micro-batch appends only rows whose key the target does
    not hold yet (K6's anti-join), one row per key, so replays never
    duplicate a point.  Only a missing target counts as empty."""
    spark = df.sparkSession
    d = work_dir(spark, name)

    def publish_batch(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        bounds = batch.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
        if bounds["lo"] is None:
            batch.unpersist()
            return
        new = batch.dropDuplicates([key])
        try:
            there = batch.sparkSession.read.schema(batch.schema).parquet(target)
        except AnalysisException as ex:
            if ex.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            # only the batch's key range of the target is read (pushed filter)
            have = there.filter(F.col(key).between(F.lit(bounds["lo"]), F.lit(bounds["hi"]))).select(key).distinct()
            new = new.join(have, on=key, how="left_anti")
        new.write.mode("append").parquet(target)
        batch.unpersist()

    q = (df.writeStream.foreachBatch(publish_batch).option("checkpointLocation", os.path.join(d, "_ck"))
           .trigger(availableNow=True).start())
    q.awaitTermination()
    return target


DECAY_STATE = T.StructType([T.StructField("last", T.DateType()), T.StructField("s", T.DoubleType())])


def stream_decay(daily: DataFrame, key: str, value: str, scale: float = 7.0, date_col: str = "Date") -> DataFrame:
    """S ← S·e^{−1/scale} + p for each new closed day of a series, kept
    as per-key state (two numbers), fed in day order.  Days that are not
    newer than the state's last day are ignored (already counted)."""
    out_schema = T.StructType([T.StructField(key, daily.schema[key].dataType), T.StructField(date_col, T.DateType()),
                               T.StructField(f"Cum_{value}", T.DoubleType())])
    decay = math.exp(-1.0 / scale)

    def step(k, pdfs, state):
        last, s = (state.get if state.exists else (None, 0.0))
        rows = []
        for pdf in pdfs:
            rows.append(pdf[[date_col, value]])
        if rows:
            allp = pd.concat(rows).sort_values(date_col)
            outs = []
            for d_, p in zip(allp[date_col], allp[value]):
                if last is not None and d_ <= last:
                    continue
                s = s * decay + float(p) if last is not None else float(p)
                last = d_
                outs.append((k[0], d_, s))
            state.update((last, s))
            if outs:
                yield pd.DataFrame(outs, columns=[key, date_col, f"Cum_{value}"])

    return daily.groupBy(key).applyInPandasWithState(step, out_schema, DECAY_STATE, "append", "NoTimeout")
