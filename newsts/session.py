"""Spark session and shared-storage helpers.

The library never creates machine-local scratch paths on a cluster: lineage is
cut with ``DataFrame.checkpoint()`` into the folder named by
``spark.checkpoint.dir`` (set by the cluster).  Only when that setting is
absent (tests, laptops) do we point it at a fresh temporary folder.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.constraintPropagation.enabled": "false",  # see RUNTIME_CONF
    # broadcast only what the planner has measured to be small
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(app: str = "newsts", cpus: int | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = SparkSession.builder.appName(app)
    if not os.environ.get("SPARK_MASTER") and "spark.master" not in (extra or {}):
        b = b.master(f"local[{n}]")
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or n)
    # the test tables hold each text table in one row group, read by one task
    conf["spark.newsts.text.tasks"] = str(n)
    conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``newsts`` importable on the executors (the Python workers of
    pandas UDFs import it): zip the package once per application and add
    it with ``addPyFile`` (Spark distributes it to every executor)."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="newsts-pkg-")
    base = shutil.make_archive(os.path.join(out, "newsts"), "zip", root_dir=os.path.dirname(pkg), base_dir="newsts")
    sc.addPyFile(base)
    _SHIPPED.add(key)


# inferring constraints over wide lag designs (ADF orders, supervised matrices)
# takes minutes of planning and adds no filter that these plans need
RUNTIME_CONF = {"spark.sql.session.timeZone": "UTC", "spark.sql.constraintPropagation.enabled": "false"}


def prepare(spark: SparkSession) -> str:
    """Settings every query relies on, applied to any session (also one
    created by a caller): UTC session time, no inferred constraints, the shared
    checkpoint folder, the package on the executors."""
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Read ``spark.checkpoint.dir``; set a private one only when unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not d:
        if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="newsts-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    ship_package(spark)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives
    executor loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """(the rows, read from a compressed Parquet table in the shared checkpoint
    folder; its path).  A cut of lineage for tables that a pass replaces: see
    :func:`delete_tables`."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete_tables(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more, and have the JVM collect its
    garbage: the shuffle files of finished jobs stay until then."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    spark._jvm.System.gc()
