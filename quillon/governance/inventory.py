"""Inventories: what is unused or uncovered, what strays from its mean, and types that an exchange format can hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import SemanticError

#: A day is out of line where it strays from the mean by more than this share.
STRAY = 0.10
#: Days that a refresh may look back, and that load history is kept.
REFRESH_DAYS, HISTORY_DAYS = 7, 14


def unused(objects: DataFrame, accesses: DataFrame, name: str = "name", used: str = "used") -> DataFrame:
    """Objects (name) that no access lists in its array of names."""
    seen = accesses.select(F.explode(used).alias(name)).distinct()
    return objects.join(seen, name, "left_anti")


def coverage(parts: dict[str, DataFrame], covered: Column) -> DataFrame:
    """kind, n, covered, share over inventories of several kinds, each with its own columns but the condition's."""
    rows = None
    for kind, df in parts.items():
        one = df.select(F.lit(kind).alias("kind"), F.coalesce(covered, F.lit(False)).alias("ok"))
        rows = one if rows is None else rows.unionByName(one)
    out = rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("covered"))
    return out.withColumn("share", F.round(F.col("covered") / F.col("n") * 100, 2))


def anomalies(daily: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """days, strays of each group: days whose value strays from the group's mean by more than STRAY."""
    mean = daily.groupBy(*by).agg(F.avg(value).alias("_mean"))
    met = daily.join(mean, list(by)) if by else daily.crossJoin(F.broadcast(mean))  # one row
    return met.groupBy(*by).agg(F.count("*").alias("days"), F.count_if(F.abs(F.col(value) - F.col("_mean")) > STRAY * F.abs(F.col("_mean"))).alias("strays"))


def refreshable(history: DataFrame, now: Column, at: str = "loaded_at") -> DataFrame:
    """history within HISTORY_DAYS, with whether a refresh may still load it."""
    age = F.datediff(now, F.col(at))
    return history.where(age <= HISTORY_DAYS).withColumn("refreshable", age <= REFRESH_DAYS)


def stream_activity(progress: DataFrame) -> DataFrame:
    """name, batches, rows, empty, seconds of streams from their progress rows (name, batch_id, rows, seconds)."""
    return progress.groupBy("name").agg(F.count("*").alias("batches"), F.sum("rows").alias("rows"), F.count_if(F.col("rows") == 0).alias("empty"), F.round(F.sum("seconds"), 3).alias("seconds"))


# The exchange format's name of each type.
EXCHANGE = {
    T.StringType: "String",
    T.BooleanType: "Boolean",
    T.ByteType: "Integer",
    T.ShortType: "Integer",
    T.IntegerType: "Integer",
    T.LongType: "Integer64",
    T.FloatType: "Double",
    T.DoubleType: "Double",
    T.DateType: "Date",
    T.TimestampType: "Timestamp",
    T.TimestampNTZType: "Timestamp",
}


def exchange_types(schema: T.StructType) -> list[dict]:
    """{name, type, nullable, ...} of each column; binary, nested and unknown types are refused, all at once."""
    out, refused = [], []
    for f in schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            out.append({"name": f.name, "type": "Decimal", "precision": f.dataType.precision, "scale": f.dataType.scale, "nullable": f.nullable})
        elif type(f.dataType) in EXCHANGE:
            out.append({"name": f.name, "type": EXCHANGE[type(f.dataType)], "nullable": f.nullable})
        else:
            refused.append(f"{f.name} ({f.dataType.simpleString()})")
    if refused:
        raise SemanticError(f"no exchange type for {', '.join(refused)}")
    return out
