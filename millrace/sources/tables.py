"""Table scans, and tables written to the cluster's shared folder."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()
_own: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    _shipped.add(application)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "millrace"), "zip", os.path.dirname(package), os.path.basename(package)))


def shipped(operator: Callable) -> Callable:
    """An operator whose first argument is a DataFrame, of any origin: the package is sent before its plan is made."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **options):
        ship_package(df.sparkSession)
        return operator(df, *args, **options)

    return run


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, which then share every folder."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory; the path may be in any store that Spark reads."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one of a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own:  # a running session's setting can't be changed
        _own[application] = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.sparkContext.setCheckpointDir(_own[application])
    return _own[application]


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a path in the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _write(df: DataFrame, label: str, codec: str | None = None, file_rows: int = 0) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    ship_package(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path, compression=codec)
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    return path, spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str, codec: str | None = None, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends at files that no executor owns.

    ``codec`` is the files' compression, the session's where none is given. ``file_rows`` bounds a file's rows, 0 does not: a
    reader's column batch may hold all rows of a file, up to thousands, so large rows need it.
    The files stay until the application ends. A step's own tables belong in a ``Workspace``.
    """
    return _write(df, label, codec, file_rows)[1]


class Workspace:
    """The tables of an operator's steps, written to the shared folder and deleted when the block ends.

    What the block returns must be written before: ``materialize`` gives a table that outlives the block.
    """

    def __init__(self, spark: SparkSession):
        ship_package(spark)  # before any plan with functions of the package is made
        self.spark = spark
        self.paths: list[tuple[str, DataFrame]] = []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*(df for _, df in self.paths))

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it back."""
        self.paths.append(_write(df, label))
        return self.paths[-1][1]

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for path, df in [x for x in self.paths if any(x[1] is t for t in tables)]:
            system, where = _file_system(self.spark, path)
            system.delete(where, True)
            self.paths = [x for x in self.paths if x[1] is not df]
