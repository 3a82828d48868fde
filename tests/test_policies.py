"""Policies hold however a governed table is named: every statement is judged on Spark's own plan of it."""

import pytest

from quillon.engine import Engine
from quillon.errors import AccessError, QueryError, SemanticError
from quillon.governance.policies import Policies, SecurityContext

WHO = SecurityContext(primary="ANALYST")
VIEW = "CREATE SEMANTIC VIEW pv TABLES (o AS p_o PRIMARY KEY (k)) FACTS (o.x AS n) DIMENSIONS (o.k AS k, o.g AS g) METRICS (o.total AS SUM(n), o.c AS COUNT(k))"


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("governed"))
    spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "b", 30)], "k int, g string, v int").write.mode("overwrite").parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("b")
    spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (9, 7, "b")], "k int, n int, g string").createOrReplaceTempView("p_o")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW b_view AS SELECT k, v AS w FROM b")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW b_names(x, y) AS SELECT k, v FROM b")
    spark.table("b").where("k > 0").createOrReplaceTempView("b_frame")
    return path


@pytest.fixture
def held(spark, path):
    e = Engine(spark, Policies(row={"b": "g = 'b'"}, mask={("b", "v"): "-1"}))
    e.deploy(VIEW)
    return e


SEEN = [(2, "b", -1), (3, "b", -1)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT * FROM b", SEEN),
        ("WITH b AS (SELECT * FROM b) SELECT * FROM b", SEEN),
        ("WITH c AS (SELECT * FROM b), b AS (SELECT 1 AS one) SELECT c.* FROM c, b", SEEN),
        ("WITH b AS (SELECT 7 AS k) SELECT * FROM b", [(7,)]),
        ("SELECT * FROM (WITH b AS (SELECT 7 AS k) SELECT k FROM b) UNION ALL SELECT k FROM b", [(2,), (3,), (7,)]),
        ("SELECT k, SUM(v) OVER b AS s FROM b WINDOW b AS (PARTITION BY g)", [(2, -2), (3, -2)]),
        ("SELECT * FROM (b)", SEEN),
        ("SELECT * FROM (TABLE b)", SEEN),
        ("TABLE b", SEEN),
        ("SELECT x.v, y.k FROM b AS x JOIN `b` y ON x.k = y.k", [(-1, 2), (-1, 3)]),
        ("SELECT (SELECT MAX(v) FROM b) AS m, EXISTS (SELECT 1 FROM b WHERE g = 'a') AS e", [(-1, False)]),
        ("SELECT * FROM b_view", [(2, -1), (3, -1)]),
        ("SELECT * FROM b_names", [(2, -1), (3, -1)]),
        ("SELECT n FROM p_o WHERE k IN (SELECT k FROM b WHERE v = 10)", []),
        ("SELECT total FROM SEMANTIC_VIEW(pv METRICS total WHERE k IN (SELECT b.k FROM b))", [(6,)]),
        ("SELECT q.k, b.v FROM SEMANTIC_VIEW(pv METRICS total DIMENSIONS k) AS q JOIN b ON b.k = q.k", [(2, -1)]),
        ("SELECT k FROM b x, LATERAL (SELECT 1 AS one FROM b WHERE b.k = x.k + 1)", [(2,)]),
    ],
)
def test_rows_and_masks_hold(held, text, want):
    assert sorted(map(tuple, held.sql(text, WHO).collect())) == want


@pytest.mark.parametrize("text", ["SELECT * FROM parquet.`{path}`", "SELECT * FROM IDENTIFIER('b')", "SELECT * FROM b_frame", "CREATE TEMPORARY VIEW leak AS SELECT * FROM b", "SELECT * FROM (SELECT * FROM parquet.`{path}` WHERE k > 1)"])
def test_ways_round_are_refused(held, path, text):
    with pytest.raises(AccessError):
        held.sql(text.format(path=path), WHO).collect()


def test_filters_of_views_are_held(held):
    assert held.query("pv", [], ["c"], where="o.k IN (SELECT k FROM b WHERE v = 10)", context=WHO).first().c == 0
    assert held.query("pv", [], ["c"], where="o.k IN (SELECT k FROM b WHERE v = -1)", context=WHO).first().c == 1
    assert held.query("pv", [], ["c"], where="o.k IN (SELECT k FROM b WHERE v = 10)").first().c == 1


def test_a_mark_seen_before_opens_nothing(held):
    text = held.translate("SELECT * FROM b", WHO)
    mark = text.split(" AS __own_")[1].split(")")[0].split()[0]
    with pytest.raises(SemanticError):
        held.sql(f"SELECT * FROM (SELECT * FROM parquet.`{held.spark.table('b').inputFiles()[0]}`) AS __own_{mark}", WHO)


def test_owner_and_qualified_names(spark, held):
    assert held.sql("SELECT * FROM b").count() == 3
    spark.sql("CREATE DATABASE IF NOT EXISTS p_other")
    spark.sql("CREATE TABLE p_other.b USING parquet AS SELECT 1 AS k, 'z' AS g, 4 AS v")
    assert held.sql("SELECT v FROM p_other.b", WHO).first().v == 4
    q = Engine(spark, Policies(row={"p_other.b": "false"}))
    assert q.sql("SELECT * FROM p_other.b", WHO).count() == 0 and q.sql("SELECT * FROM b", WHO).count() == 3


@pytest.mark.parametrize(
    "text, refused",
    [
        ("SELECT k FROM b", False),
        ("SELECT k FROM b WHERE v > 10 ORDER BY k", False),
        ("SELECT g, COUNT(*) AS c FROM b GROUP BY g", False),
        ("SELECT v FROM b", True),
        ("SELECT * FROM b", True),
        ("SELECT v + 1 AS w FROM b", True),
        ("SELECT w FROM b_view", True),
        ("SELECT MAX(v) AS m FROM b", True),
        ("WITH c AS (SELECT k, v AS z FROM b) SELECT z FROM c", True),
        ("SELECT 1 AS one UNION ALL SELECT v FROM b", True),
        ("SELECT (SELECT MAX(v) FROM b) AS m", True),
        ("SELECT e FROM b LATERAL VIEW explode(array(v)) t AS e", True),
        ("SELECT SUM(v) OVER (ORDER BY k) AS s FROM b", True),
        ("SELECT named_struct('a', v) AS s FROM b", True),
    ],
)
def test_projection_in_plain_sql(spark, path, text, refused):
    e = Engine(spark, Policies(projection={("b", "v"): frozenset({"ADMIN"})}))
    if refused:
        with pytest.raises(AccessError):
            e.sql(text, WHO)
    else:
        e.sql(text, WHO).collect()
    e.sql(text, SecurityContext(primary="ADMIN")).collect()


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT g, COUNT(*) AS c FROM b GROUP BY g", [("b", 2)]),
        ("SELECT g, SUM(v) AS s FROM b x WHERE k > 0 GROUP BY g HAVING SUM(v) > 1 OR g = 'a' ORDER BY g", [("b", 50)]),
        ("SELECT COUNT(*) AS c FROM b", [(3,)]),
        ("SELECT COUNT(*) AS c FROM b WHERE k = 1", []),
        ("SELECT SUM(c) AS c FROM (SELECT g, COUNT(*) AS c FROM b GROUP BY g)", [(2,)]),
        ("SELECT g FROM b GROUP BY g UNION ALL SELECT 'x'", [("b",), ("x",)]),
        ("SELECT * FROM b", None),
        ("SELECT g FROM b LIMIT 1", None),
        ("SELECT COUNT(*) AS c FROM b JOIN p_o ON p_o.k = b.k", None),
        ("SELECT k FROM p_o WHERE k IN (SELECT k FROM b)", None),
        ("SELECT g, v, COUNT(*) OVER () AS c FROM b", None),
    ],
)
def test_aggregation_in_plain_sql(spark, path, text, want):
    e = Engine(spark, Policies(aggregation={"b": (2, frozenset({"ADMIN"}))}))
    if want is None:
        with pytest.raises((QueryError, AccessError)):
            e.sql(text, WHO)
    else:
        assert sorted(map(tuple, e.sql(text, WHO).collect())) == want
    e.sql(text, SecurityContext(primary="ADMIN")).collect()


def test_a_filter_may_not_read_what_may_only_be_counted(spark, path):
    for p in (Policies(aggregation={"b": (2, frozenset())}), Policies(projection={("b", "v"): frozenset()})):
        e = Engine(spark, p)
        e.deploy(VIEW)
        with pytest.raises(AccessError):
            e.query("pv", [], ["c"], where="o.k IN (SELECT k FROM b WHERE v = 10)", context=WHO)


def test_grants_in_plain_sql(spark, path):
    e = Engine(spark, Policies(grants={"p_o": frozenset({"ANALYST"}), "pv": frozenset({"ANALYST"}), "b": frozenset({"ADMIN"})}))
    e.deploy(VIEW)
    assert e.sql("SELECT total FROM SEMANTIC_VIEW(pv METRICS total)", WHO).first().total == 18
    assert e.sql("SELECT COUNT(*) AS c FROM p_o", WHO).first().c == 3
    for text in ("SELECT v FROM b", "SELECT k FROM p_o WHERE EXISTS (SELECT 1 FROM b)", "SELECT x.k FROM p_o x JOIN b_view y ON x.k = y.k"):
        with pytest.raises(AccessError):
            e.sql(text, WHO)
    with pytest.raises(AccessError):
        e.query("pv", [], ["c"], where="o.k IN (SELECT k FROM b)", context=WHO)
