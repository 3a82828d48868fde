"""Numbering and running sums over a whole table, without one task that sees it all.

The order is dealt into ranges; a range's count or sum is one row, and what
lies before it is added to each row's own place in its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.lineage import cut


def _before(sums: DataFrame) -> DataFrame:
    """part, made -> part, before: the sum of all lower parts. As many rows as there are ranges, so one array holds them."""
    kind = "decimal(38,6)"
    lower = lambda p, x: F.aggregate(F.filter(p, lambda y: y["part"] < x["part"]), F.lit(0).cast(kind), lambda s, y: (s + y["made"]).cast(kind))
    every = sums.agg(F.collect_list(F.struct("part", "made")).alias("p"))
    return every.select(F.explode(F.transform("p", lambda x: F.struct(x["part"].alias("part"), lower(F.col("p"), x).alias("before")))).alias("x")).select("x.*")


def running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with ``name``: the sum of value over all rows up to and with this one, in an order that should be total.

    As SUM(value) OVER (ORDER BY ... ROWS UNBOUNDED PRECEDING), in decimals of
    six places; null values count as 0. Ties stand in the order of a hash of their rows.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map" not in t and "variant" not in t])  # else equal keys would be one range
    ranged = df.repartitionByRange(parts, *order, tie).sortWithinPartitions(*order, tie)
    packed = ranged.select(F.struct(*df.columns).alias("own"), F.coalesce(value, F.lit(0)).cast("decimal(38,6)").alias("made"))
    stored = cut(packed.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    before = _before(stored.groupBy("part").agg(F.sum("made").cast("decimal(38,6)").alias("made")))
    upto = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = stored.withColumn("upto", F.sum("made").over(upto)).join(F.broadcast(before), "part")
    return out.select("own.*", (F.col("before") + F.col("upto")).cast("decimal(38,6)").alias(name))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with ``name``: ROW_NUMBER() OVER (ORDER BY ...), as a long."""
    out = running(df, order, F.lit(1), name)
    return out.withColumn(name, F.col(name).cast("long"))
