"""Operations: ingest dedup, clean-room measures, audits, assessment runs."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import SemanticError
from quillon.operators.lineage import cut

#: Pipe health: pending files, share of errors, minutes behind.
PENDING, ERRORS, LAG = 1000, 0.05, 30
NAME = re.compile(r"[A-Za-z0-9_]{1,20}")


def dedup_loads(loads: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Exactly once by content: the first load (ascending) of each content of the key columns; null and empty are two contents."""
    content = F.sha2(F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{n}") for n, k in enumerate(keys)]), {"ignoreNullFields": "false"}), 256)
    # A minimum combines before the shuffle, so a very common record is no task of its own.
    first = loads.groupBy(content.alias("_hash")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in loads.columns]), F.struct(*order)).alias("_first"))
    return first.select("_first.*")


def not_loaded(listing: DataFrame, history: DataFrame) -> DataFrame:
    """Files of a listing (path) that the load history does not have."""
    return listing.join(history.select("path").distinct(), "path", "left_anti")


def pipe_health(status: DataFrame) -> DataFrame:
    """status (pipe, pending, files, errors, lag_minutes) with healthy."""
    rate = F.coalesce(F.col("errors") / F.nullif(F.col("files"), F.lit(0)), F.lit(0.0))
    return status.withColumn("healthy", (F.col("pending") <= PENDING) & (rate <= ERRORS) & (F.col("lag_minutes") <= LAG))


def overlap(a: DataFrame, b: DataFrame, key: str, by: list[str], least: int) -> DataFrame:
    """Shared keys for each group of a's columns; groups under ``least`` are withheld."""
    met = a.join(b.select(key).distinct(), key)
    return met.groupBy(*by).agg(F.countDistinct(key).alias("overlap")).where(F.col("overlap") >= least)


def reach(audience: DataFrame, seen: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Share of each group's keys that were seen."""
    hit = seen.select(key).distinct().withColumn("_hit", F.lit(True))
    met = audience.join(hit, key, "left").groupBy(*by)
    out = met.agg(F.countDistinct(key).alias("audience"), F.countDistinct(F.when(F.col("_hit"), F.col(key))).alias("reached"))
    return out.withColumn("rate", F.round(F.col("reached") / F.nullif(F.col("audience"), F.lit(0)), 6))


class CleanRoom:
    """Template-only access: parameters are names of known datasets or bound literals, versions never change."""

    def __init__(self, spark: SparkSession, datasets: dict[str, str]):
        self.spark, self.datasets, self.templates = spark, datasets, {}
        for d in datasets:
            if len(d.split(".")) != 3:
                raise SemanticError(f"dataset '{d}' needs three parts")

    def register(self, name: str, version: str, sql: str) -> None:
        if not NAME.fullmatch(version):
            raise SemanticError(f"version '{version}' is not a name of up to 20 letters")
        if (name, version) in self.templates:
            raise SemanticError(f"template '{name}' has a version '{version}' already")
        self.templates[name, version] = sql

    def run(self, name: str, version: str, sources: list[str], **params: object) -> DataFrame:
        sql = self.templates[name, version]
        for d in sources:
            if d not in self.datasets:
                raise SemanticError(f"unknown dataset '{d}'")
        sql = re.sub(r"IDENTIFIER\(\s*\{\{\s*source_table\[(\d+)\]\s*\}\}\s*\)", lambda m: self.datasets[sources[int(m[1])]], sql)
        sql = re.sub(r"\{\{\s*(\w+)\s*\}\}", r":\1", sql)
        return self.spark.sql(sql, args=params)


def effective_roles(grants: DataFrame, levels: int = 20) -> DataFrame:
    """role, held: each role and all that it inherits by grants (role, granted_role)."""
    own = grants.select(F.col("role").alias("role"), F.col("role").alias("held")).union(grants.select("granted_role", "granted_role")).distinct()
    out = front = own
    links = grants.select(F.col("role").alias("at"), "granted_role").distinct()
    for _ in range(levels):
        front = front.join(links, F.col("held") == F.col("at")).select("role", F.col("granted_role").alias("held")).distinct().join(out, ["role", "held"], "left_anti")
        front = cut(front)
        if front.isEmpty():
            break
        out = out.union(front)
    return out


def grant_gaps(needed: DataFrame, privileges: DataFrame, grants: DataFrame) -> DataFrame:
    """role, object that a role needs and neither has nor inherits."""
    has = effective_roles(grants).join(privileges.select(F.col("role").alias("held"), "object"), "held").select("role", "object")
    direct = privileges.select("role", "object")
    return needed.select("role", "object").join(has.union(direct).distinct(), ["role", "object"], "left_anti")


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for dotted versions, number by number; missing numbers are 0."""
    n = F.greatest(F.size(F.split(a, r"\.")), F.size(F.split(b, r"\.")))
    parts = lambda c: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(F.split(c, r"\."), i).cast("int"), F.lit(0)))
    return F.when(parts(a) < parts(b), -1).when(parts(a) > parts(b), 1).otherwise(0)


def slope(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"))


GRADES = ("on_track", "needs_attention", "at_risk", "skipped")


def grade(value: float | None, good: Callable[[float], bool], watch: Callable[[float], bool]) -> str:
    if value is None:
        return "skipped"
    return "on_track" if good(value) else "needs_attention" if watch(value) else "at_risk"


def assess(spark: SparkSession, checks: list[dict], workers: int = 4) -> tuple[DataFrame, float]:
    """Run checks {id, control, sql, good, watch, depends_on}; (a row each, share of controls on track).

    A check whose predecessor is not on track is skipped. A control is as good
    as its worst check. Independent checks run side by side.
    """
    done: dict[str, dict] = {}
    left = list(checks)
    while left:
        ready = [c for c in left if not c.get("depends_on") or c["depends_on"] in done]
        if not ready:
            raise SemanticError("checks depend on each other in a circle")

        def run(c: dict) -> dict:
            before = done.get(c.get("depends_on") or "")
            if before and before["grade"] != "on_track":
                return {"id": c["id"], "control": c["control"], "value": None, "grade": "skipped"}
            value = spark.sql(c["sql"]).first()
            value = None if value is None or value[0] is None else float(value[0])
            return {"id": c["id"], "control": c["control"], "value": value, "grade": grade(value, c["good"], c["watch"])}

        with ThreadPoolExecutor(workers) as pool:
            done |= {r["id"]: r for r in pool.map(run, ready)}
        left = [c for c in left if c["id"] not in done]
    worst: dict[str, str] = {}
    for r in done.values():
        if r["grade"] != "skipped":
            worst[r["control"]] = max(worst.get(r["control"], "on_track"), r["grade"], key=GRADES.index)
    rows = [(r["id"], r["control"], r["value"], r["grade"]) for r in done.values()]
    score = sum(g == "on_track" for g in worst.values()) / len(worst) if worst else 0.0
    return spark.createDataFrame(rows, "id string, control string, value double, grade string"), score
