"""Versioned sets of fitted artefacts.

A version is a folder of small tables and Spark ML models below one base
folder.  Its manifest, a table of the names in it, is written last: a version
without one is half written and never read.  A reader opens the newest complete
version once and takes everything from it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest"


class Version:
    """A version that is being written."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.names = spark, []
        # a name of its own, so two writers never share a folder
        self.made = time.time_ns()
        self.path = f"{base.rstrip('/')}/version-{self.made:020d}-{uuid.uuid4().hex[:8]}"

    def table(self, name: str, df: DataFrame) -> None:
        df.coalesce(1).write.parquet(f"{self.path}/{name}")
        self.names.append(name)

    def model(self, name: str, model) -> None:
        model.write().save(f"{self.path}/{name}")
        self.names.append(name)

    def complete(self) -> str:
        rows = [(self.made, self.path, n) for n in self.names]
        self.spark.createDataFrame(rows, "made long, path string, name string").coalesce(1).write.parquet(f"{self.path}/{MANIFEST}")
        return self.path


class Opened:
    """The newest complete version."""

    def __init__(self, spark: SparkSession, base: str):
        try:
            listed = spark.read.schema("made long, path string, name string").parquet(f"{base.rstrip('/')}/version-*/{MANIFEST}")
            newest = listed.orderBy(F.desc("made"), F.desc("path")).first()
        except AnalysisException:
            newest = None
        if newest is None:
            raise FileNotFoundError(f"no complete version below {base}")
        self.spark, self.path = spark, newest["path"]
        self.names = {r["name"] for r in listed.filter(F.col("path") == self.path).collect()}

    def _place(self, name: str) -> str:
        if name not in self.names:
            raise KeyError(name)
        return f"{self.path}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._place(name))

    def model(self, name: str, kind):
        return kind.load(self._place(name))
