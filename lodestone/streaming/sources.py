"""Watch a directory of sources: every new or changed file is scanned as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.project import SCANNED, _scanner


def source_stream(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """(path, text) of files that appear below ``root``."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).schema("value string").load(root)
    return raw.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), F.col("value").alias("text"))


def scan_stream(spark: SparkSession, root: str, marker: str = "lodestone") -> DataFrame:
    """One scanned row for each arriving file; narrow, so any sink and trigger will do."""
    return source_stream(spark, root).mapInPandas(_scanner(root, marker), SCANNED)


def write_scans(spark: SparkSession, root: str, out: str, checkpoint: str, marker: str = "lodestone") -> StreamingQuery:
    """Append scanned files as Parquet and stop when nothing is left to read."""
    return scan_stream(spark, root, marker).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
