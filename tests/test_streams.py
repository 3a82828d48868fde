"""Streams go on where they stopped, in bounded state; rollups keep the files of what is frozen."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quillon.engine import Engine
from quillon.operators.ordered import numbered, running
from quillon.streaming.dynamic import DynamicTable
from quillon.streaming.ingest import auto_ingest

SCHEMA = "k string, v long, at timestamp"


def put(spark, folder, rows):
    spark.createDataFrame([(k, v, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for k, v, h in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_forgets_old_keys(spark, tmp_path):
    source, target, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    put(spark, source, [(f"a{k}", k, 0) for k in range(20)] + [("a0", 99, 0)])
    first = auto_ingest(spark, source, SCHEMA, target, mark, ["k"], event_time="at")
    assert spark.read.parquet(target).count() == 20 and max(p["state"] for p in first) == 20
    put(spark, source, [("b", 1, 5), ("b", 2, 5)])
    auto_ingest(spark, source, SCHEMA, target, mark, ["k"], event_time="at")
    put(spark, source, [("a1", 7, 6), ("b", 3, 5), ("late", 1, 0)])
    last = auto_ingest(spark, source, SCHEMA, target, mark, ["k"], event_time="at")
    got = spark.read.parquet(target)
    # An old key is free again, a key within the delay is not, and what is later than the watermark is dropped.
    assert got.where("k = 'a1'").count() == 2 and got.where("k = 'b'").count() == 1 and got.where("k = 'late'").count() == 0
    assert last[-1]["state"] < 20


def test_dynamic_table_restarts_and_replays(spark, tmp_path):
    now = [0.0]
    source, path = f"{tmp_path}/in", f"{tmp_path}/table"
    made = lambda: DynamicTable(spark, source, SCHEMA, ["k"], {"n": ("count", "v"), "total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")}, path, 60, buckets=4, clock=lambda: now[0])
    rows = [(f"k{k % 5}", k, 0) for k in range(30)]
    want = lambda rows: sorted((k, len(v), sum(v), min(v), max(v)) for k in {r[0] for r in rows} for v in [[r[1] for r in rows if r[0] == k]])
    put(spark, source, rows)
    table = made()
    assert table.read() is None and table.behind() == float("inf")
    assert table.follow() and not table.follow()
    assert sorted(map(tuple, table.read().collect())) == want(rows)
    more = [("k1", 1000, 1), ("new", -5, 1)]
    put(spark, source, more)
    again = made()  # as after a restart
    assert again.follow()
    assert sorted(map(tuple, again.read().collect())) == want(rows + more)
    files = {f for _, _, x in os.walk(f"{path}/rows") for f in x if f.endswith(".parquet")}
    batch = spark.read.parquet(source).where("at > '2024-01-01 00:30:00'")
    again.fold(batch, 1)  # the batch comes again after a failure
    assert sorted(map(tuple, again.read().collect())) == want(rows + more)
    put(spark, source, [("k1", 1, 2)])
    now[0] = 61.0
    assert again.follow() and again.behind() == 0
    left = {f for _, _, x in os.walk(f"{path}/rows") for f in x if f.endswith(".parquet")}
    assert files & left, "only the buckets of new keys are written"


def test_frozen_files_stay(spark, tmp_path):
    spark.createDataFrame([(k, 2020 + k % 4, 10 * k) for k in range(40)], "k int, y int, v int").createOrReplaceTempView("froz")
    e = Engine(spark, store=str(tmp_path))
    e.deploy("CREATE SEMANTIC VIEW fz TABLES (t AS froz PRIMARY KEY (k)) DIMENSIONS (t.y AS y) METRICS (t.s AS SUM(v))")
    e.set_max_staleness("fz", 300)
    m = e.add_materialization("fz", "r", ["y"], ["s"], immutable_where="y < 2022")
    frozen = {f for f in os.listdir(f"{m.path}/frozen-0") if f.endswith(".parquet")}
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW froz AS SELECT id AS k, 2020 + id % 4 AS y, 1 AS v FROM range(40)")
    e.refresh("fz", "r")
    assert {f for f in os.listdir(f"{m.path}/frozen-0") if f.endswith(".parquet")} == frozen
    assert {r.y: r.s for r in e.query("fz", ["y"], ["s"]).collect()} == {2020: 1800, 2021: 1900, 2022: 10, 2023: 10}
    m.immutable_where = "y < 2023"  # a moving predicate: what is frozen since is kept as it was
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW froz AS SELECT id AS k, 2020 + id % 4 AS y, 7 AS v FROM range(40)")
    e.refresh("fz", "r")
    assert {r.y: r.s for r in e.query("fz", ["y"], ["s"]).collect()} == {2020: 1800, 2021: 1900, 2022: 10, 2023: 70}
    assert [h for _, h in m.history] == ["full", "incremental", "incremental"] and m.frozen == ["frozen-0", "frozen-2"]


@pytest.mark.parametrize("ties", [False, True])
def test_order_over_a_whole_table(spark, ties):
    df = spark.range(500).select("id", F.when(F.lit(ties), F.lit(1)).otherwise((F.col("id") * 7919) % 1009).alias("x"), F.when(F.col("id") % 9 > 0, F.col("id")).alias("v"))
    got = running(numbered(df, [F.desc("x"), F.asc("id")], "place"), [F.asc("place")], F.col("v"), "total")
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    # What one task sees is sums of ranges.
    assert all("partial_collect_list(struct(part" in below for line, below in zip(lines, lines[1:]) if "SinglePartition" in line)
    rows = sorted(df.collect(), key=lambda r: (-r.x, r.id))
    total, want = 0, []
    for k, r in enumerate(rows, 1):
        total += r.v or 0
        want.append((r.id, k, total))
    assert sorted((r.id, r.place, int(r.total)) for r in got.collect()) == sorted(want)
    assert numbered(df.limit(0), [F.asc("id")], "n").count() == 0
