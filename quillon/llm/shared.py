"""What the training-data operators share: scratch tables and ordered buckets."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that a Python worker of the pipeline gets at once, and the setting that holds for it.
BATCH, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_scopes: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; one process alone may make its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillon-scratch-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths that stash writes meanwhile; those left in the list in the end are the enclosing scope's too."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        left = _scopes.pop()
        if _scopes:
            _scopes[-1].extend(left)


def tidy(made: list[str], *results: DataFrame) -> None:
    """Remove the stashed tables of ``made`` that none of the results reads, and take them off the list."""
    read = [x for df in results for x in df.inputFiles()]
    gone = [p for p in made if not any(f"/{p.rsplit('/', 1)[1]}/" in x for x in read)]
    if gone:
        drop_tables(results[0].sparkSession, gone)
    made[:] = [p for p in made if p not in gone]


def tidied(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, which removes what it stored once its result is made, but for what the result still reads."""

    @functools.wraps(f)
    def run(*args, **more) -> DataFrame:
        with scope() as made:
            out = f(*args, **more)
            tidy(made, out)
        return out

    return run


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers of the session get BATCH bytes or a row at once: executor and worker both hold a batch whole. What the session has set itself stays."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH))


def carried(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The caller's columns as one struct, "own": no name of theirs can clash with what is made beside it."""
    return F.struct(*[F.col(f"`{c}`") for c in (df.columns if columns is None else columns)]).alias("own")


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove stashed tables."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stash_small(df: DataFrame, name: str) -> DataFrame:
    """``stash`` for a few bytes for each node or document: an eighth of the tasks will do, and so an eighth of the files."""
    return stash(df.coalesce(max(4, partitions(df.sparkSession) // 8)), name)


def bucket_bounds(df: DataFrame, key: str, buckets: int) -> list:
    """Ascending cut points that split df into about equal ranges of key; at most buckets - 1 values reach the driver."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = df.select(F.percentile_approx(key, shares, max(10_000, 20 * buckets)).alias("b")).first()["b"]
    return sorted({b for b in found or [] if b is not None})


def bucket_of(key: Column, bounds: list) -> Column:
    """Number of bounds below key: 0 for nulls and the lowest range."""
    if not bounds:
        return F.lit(0)
    # Binary search as nested comparisons keeps the expression's depth at log2 of its size.
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key > F.lit(bounds[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(bounds))
