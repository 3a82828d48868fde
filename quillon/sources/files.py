"""Files of a folder, and which of them a load history has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import tables

HISTORY = "path string, modified timestamp, size long, loaded timestamp"


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, modified, size of every file under a folder that has bytes; what is in them is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def unloaded(spark: SparkSession, folder: str, history: str, glob: str = "*") -> DataFrame:
    """Files that the history (a stored table of HISTORY) has not, or has as they were before they changed."""
    known = tables.read(spark, history, HISTORY).select("path", "modified", "size").distinct()
    return listing(spark, folder, glob).join(known, ["path", "modified", "size"], "left_anti")


def record(files: DataFrame, history: str) -> None:
    """Add files (path, modified, size) to the history as loaded now."""
    tables.insert(files.select("path", "modified", "size", F.current_timestamp().alias("loaded")), history)
