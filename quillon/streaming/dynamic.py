"""Dynamic tables: a stored rollup that follows a folder of files within a target lag."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.lineage import cut

#: How stored values are folded with new ones.
FOLDS = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
FIRST = {**FOLDS, "count": F.count}


class DynamicTable:
    """Sums by key over all files that a folder ever had, each file once.

    ``metrics`` names (fold, column) of each: sum, count, min or max. A refresh
    streams what is new, folds each batch by key and rewrites only the buckets
    (of a hash of the keys) that it meets. Every row holds the batch that wrote
    its bucket, so a batch that comes again after a failure is folded into no
    bucket twice. ``lag`` is the target in seconds.
    """

    def __init__(self, spark: SparkSession, source: str, schema: str, keys: list[str], metrics: dict[str, tuple[str, str]], path: str, lag: float, fmt: str = "parquet", glob: str = "*", buckets: int = 64, clock: Callable[[], float] = time.time):
        self.spark, self.source, self.schema, self.keys, self.metrics = spark, source, schema, keys, metrics
        self.path, self.lag, self.fmt, self.glob, self.buckets, self.clock = path.rstrip("/"), lag, fmt, glob, buckets, clock
        self.refreshed: float | None = None

    def _stored(self) -> DataFrame | None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(f"{self.path}/rows")

    def read(self) -> DataFrame | None:
        """keys and metrics as of the last refresh; None before the first row."""
        df = self._stored()
        return None if df is None else df.select(*self.keys, *self.metrics)

    def behind(self) -> float:
        """Seconds since the last refresh; infinite before the first."""
        return float("inf") if self.refreshed is None else self.clock() - self.refreshed

    def follow(self) -> bool:
        """Refresh where the table is behind its target lag; whether it did."""
        if self.behind() <= self.lag:
            return False
        self.refresh()
        return True

    def refresh(self) -> None:
        """Take in what is new."""
        new = self.spark.readStream.schema(self.schema).format(self.fmt).option("pathGlobFilter", self.glob).load(self.source)
        new.writeStream.foreachBatch(self.fold).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        self.refreshed = self.clock()

    def fold(self, batch: DataFrame, number: int) -> None:
        """One batch into the stored rows."""
        made = batch.groupBy(*self.keys).agg(*[FIRST[f](c).alias(m) for m, (f, c) in self.metrics.items()])
        made = made.withColumns({"bucket": F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"), "batch": F.lit(number).cast("long")})
        made = cut(made)
        stored = self._stored()
        if stored is not None:
            met = F.broadcast(made.select("bucket").distinct())  # at most ``buckets`` rows
            old = stored.join(met, "bucket", "left_semi").select(made.columns)
            done = old.groupBy("bucket").agg(F.max("batch").alias("done")).where(F.col("done") >= number).select("bucket")
            both = old.unionByName(made).join(F.broadcast(done), "bucket", "left_anti")
            folded = both.groupBy("bucket", *self.keys).agg(*[FOLDS[f](m).alias(m) for m, (f, _) in self.metrics.items()])
            made = cut(folded.withColumn("batch", F.lit(number).cast("long")))  # read before its buckets are written
        made.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
