"""Lineage cuts in storage that every executor shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a session on this machine alone that names none (tests, a laptop) gets a temporary one, once."""
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
    """``df`` materialised in the checkpoint folder, without its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of the checkpoint folder that goes with the driver.

    For rounds that join a table with itself under other names: a checkpoint
    keeps how its rows are dealt out, and what is known of that doubles with every
    join until planning never ends. A table keeps its rows only.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
