"""Intermediate tables in the cluster's shared folder.

An operator that needs a result twice, or that must see the same rows in two
jobs, writes it as Parquet below ``spark.checkpoint.dir`` and reads it back:
a lost executor then costs a re-read, never a different answer.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a scratch folder
    in pure local mode (tests), and an error on a cluster."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="paylens-llm-")
    return _LOCAL_FALLBACK[app]


class Workspace:
    """One run's tables; every run has a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/paylens-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        _MADE.append(self.path)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a scan of what was written."""
        path = self.folder(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def file(self, name: str, data: bytes) -> str:
        """Write a small file through Spark's file systems; its path."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder(name))
        out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(data)
        out.close()
        return self.folder(name)

    def drop(self, name: str) -> None:
        """Delete one table of this run (its readers must have finished)."""
        _delete(self.spark, self.folder(name))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """A point in time for ``drop_since``."""
    return len(_MADE)


def drop_since(spark: SparkSession, point: int) -> None:
    """Delete the tables of all operators called since ``mark`` returned ``point``; results
    that still read them must have been written before. The package that workers import
    stays."""
    for folder in _MADE[point:]:
        if "/package-" not in folder:
            _delete(spark, folder)
    del _MADE[point:]


def partitions(spark: SparkSession) -> int:
    """Partitions of a full shuffle, as the session sets them for its data size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver found it
    (once per application; executors fetch one small archive)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(Workspace(spark, "package").file("paylens-package.zip", archive.getvalue()))
    _SHIPPED.add(app)
