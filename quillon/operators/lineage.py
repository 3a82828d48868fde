"""Cutting lineage in loops, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written once as a table in spark.checkpoint.dir and read back; where that is unset and all is one process, in a folder of its own."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillon-tables-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/quillon/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
