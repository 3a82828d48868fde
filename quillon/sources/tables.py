"""Stored tables that grow: append, append what is absent, replace or delete a part by its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def insert(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Append rows; ``by``: partition columns."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def insert_if_absent(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the table does not have (nulls are equal), one row for each key; how many were new.

    One writer at a time: what another appends meanwhile is not seen.
    """
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    if exists(spark, path):
        held = spark.read.parquet(path).select(*[F.col(k).alias(f"_h{n}") for n, k in enumerate(keys)]).distinct()
        new = new.join(held, [F.col(k).eqNullSafe(F.col(f"_h{n}")) for n, k in enumerate(keys)], "left_anti")
    seen = Observation()
    insert(new.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return seen.get["n"]


def replace_part(df: DataFrame, path: str, column: str, value: str) -> None:
    """All rows of a partition (column = value) become those of df, in one commit where there are any."""
    own = df.where(F.col(column) == value) if column in df.columns else df.withColumn(column, F.lit(value))
    if own.isEmpty():
        delete_part(df.sparkSession, path, column, value)
    else:
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def delete_part(spark: SparkSession, path: str, column: str, value: str) -> None:
    """Delete the rows of a partition; nothing else is read or written."""
    fs, at = _fs(spark, f"{path}/{column}={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)}")
    fs.delete(at, True)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, empty where nothing was written yet or all was deleted."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
