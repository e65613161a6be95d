"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, where driver and executors are one process, is one made where none is named.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="proseflow-"))
    return sc.getCheckpointDir().rstrip("/")


_FOLDERS: dict[str, SparkSession] = {}
#: Spark's setting that removes the shuffle files of a query when the query ends.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one, removed by ``release`` or when Python ends."""
    path = f"{shared_dir(spark)}/proseflow-{spark.sparkContext.applicationId}"
    if not _FOLDERS:
        atexit.register(release)
    _FOLDERS[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release() -> None:
    """Deletes all intermediate tables.  Results that were not written anywhere cannot be read any more."""
    while _FOLDERS:
        path, spark = _FOLDERS.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: nothing is left that could delete
            pass


def stored(df: DataFrame, compression: str = "zstd", partition_by: str | None = None) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written as a table in the shared folder and read again, and what deletes the table.

    Cuts lineage: a lost executor costs no more than the tasks that ran on it.  Shuffle files
    of the write go when it ends, since the table stands for them.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    given = spark.conf.get(_CLEANED)
    spark.conf.set(_CLEANED, "true")
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANED, given)
    return spark.read.schema(df.schema).parquet(path), functools.partial(_delete, spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    return stored(df)[0]


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is not to be broadcast, since it grows with the documents.

    Spark takes the size of a stored table from its file, and findings of many texts alike take
    few bytes there: 900,000 rows in 1 MB are 70 MB in the driver.  It does not take a broadcast
    back, since the other join has more shuffles.
    """
    return df.hint("merge")
