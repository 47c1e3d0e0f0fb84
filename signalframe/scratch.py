"""Tables in the folder that all executors share (``spark.checkpoint.dir``).

They cut lineage: a lost executor costs a reread and no recomputation, and what is written once can't come out in two ways.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of this machine only where Spark runs in one process and none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/signalframe-scratch"
    return root.rstrip("/")


def version(spark: SparkSession, path: str) -> tuple:
    """The files of a table with their sizes and times: another tuple when the table is written anew."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


def version(spark: SparkSession, path: str) -> tuple:
    """The files of a table with their sizes and times: another tuple when the table is written anew."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


class Scratch:
    """A folder of such tables; it goes when the session ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._files("deleteOnExit", self.root)

    def _files(self, method: str, path: str, *more):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return getattr(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), method)(path, *more)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self._files("deleteOnExit", self.root)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._files("delete", f"{self.root}/{name}", True)
