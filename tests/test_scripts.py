"""Statements that read earlier results, and files against a load history."""

import pytest

from quillon.engine import Engine
from quillon.errors import AccessError, QueryError
from quillon.governance.policies import Policies, SecurityContext
from quillon.sources import files


def test_results_of_earlier_statements(spark):
    spark.createDataFrame([("FAILOVER", "true"), ("FAILOVER", "false"), ("REPLICATION", "true")], "type string, is_primary string").createOrReplaceTempView("s_groups")
    e = Engine(spark)
    got = e.run("""SELECT * FROM s_groups; SELECT COUNT(*) AS total_fg, COUNT_IF("type" = 'FAILOVER' AND "is_primary" = 'true') AS primary_fg,
      CASE WHEN COUNT_IF("type" = 'FAILOVER' AND "is_primary" = 'false') >= 1 THEN 'ON TRACK' ELSE 'NEEDS ATTENTION' END AS rag_status FROM TABLE(RESULT_SCAN(LAST_QUERY_ID()));""")
    assert tuple(got.first()) == (3, 1, "ON TRACK")
    assert e.run("SHOW VIEWS; SELECT 1 AS one; SELECT COUNT(*) AS n FROM TABLE(RESULT_SCAN(LAST_QUERY_ID(-2))) WHERE \"viewName\" = 's_groups'").first().n == 1
    e.deploy("CREATE SEMANTIC VIEW scripted TABLES (g AS s_groups) DIMENSIONS (g.kind AS type) METRICS (g.n AS COUNT(*))")
    assert e.run("SHOW SEMANTIC VIEWS LIKE 'script%'; SELECT COUNT(*) AS n FROM TABLE(RESULT_SCAN(LAST_QUERY_ID()))").first().n == 1
    with pytest.raises(QueryError):
        e.run("SELECT * FROM TABLE(RESULT_SCAN(LAST_QUERY_ID()))")


def test_results_are_secured(spark):
    e = Engine(spark, Policies(row={"s_groups": "type = 'FAILOVER'"}))
    who = SecurityContext(primary="A")
    assert e.run("SELECT type FROM s_groups; SELECT COUNT(*) AS n FROM TABLE(RESULT_SCAN(LAST_QUERY_ID()))", who).first().n == 2
    with pytest.raises(AccessError):
        Engine(spark, Policies(grants={"s_groups": frozenset()})).run("SHOW TABLES", who)


def test_files_against_a_history(spark, tmp_path):
    for k in range(3):
        (tmp_path / "in" / str(k)).mkdir(parents=True)
        (tmp_path / "in" / str(k) / f"f{k}.csv").write_text("a" * (k + 1))
    (tmp_path / "in" / "other.txt").write_text("x")
    source, history = f"file://{tmp_path}/in", f"file://{tmp_path}/history"
    new = lambda: sorted(r.path.split("/")[-1] for r in files.unloaded(spark, source, history, "*.csv").collect())
    assert new() == ["f0.csv", "f1.csv", "f2.csv"]
    files.record(files.listing(spark, source, "f[01].csv"), history)
    assert new() == ["f2.csv"]
    (tmp_path / "in" / "0" / "f0.csv").write_text("changed")
    assert new() == ["f0.csv", "f2.csv"]
