"""Lineage cuts in storage that every executor shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A session on this machine alone (unit tests, a laptop) that names none gets a
    temporary folder, once; any other session must name a folder that all its
    executors share.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and drop its lineage.

    The copy survives lost executors. Spark removes it with the DataFrame where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, otherwise it
    stays until the folder is emptied.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> None:
    """What lies at ``path`` goes with the driver."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared folder and read again.

    For wide rows, where a checkpoint would take several times the space. The
    table goes with the driver.
    """
    spark = df.sparkSession
    path = new_path(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    until_exit(spark, path)
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
