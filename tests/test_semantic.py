"""Goldens and refusals of the semantic layer on small transcribed rows."""

import datetime as dt
from decimal import Decimal

import pytest

from quillon.engine import Engine
from quillon.errors import AccessError, DeployError, QueryError
from quillon.functions.dialect import to_spark
from quillon.governance.policies import Policies, SecurityContext
from quillon.model import ddl


@pytest.fixture(scope="module")
def e(spark):
    d = dt.date
    spark.createDataFrame([("C1", "Gold", d(2024, 1, 1), d(2024, 3, 1)), ("C1", "Plat", d(2024, 3, 1), d(9999, 12, 31)), ("C2", "Free", d(2024, 1, 1), d(9999, 12, 31))], "cid string, seg string, vf date, vt date").createOrReplaceTempView("g_seg")
    spark.createDataFrame([(1, "C1", d(2024, 2, 29), Decimal(100)), (2, "C1", d(2024, 3, 1), Decimal(50)), (3, "C2", d(2023, 1, 1), Decimal(7))], "oid int, cid string, od date, amt decimal(10,2)").createOrReplaceTempView("g_ord")
    spark.createDataFrame([(1, "A", "B"), (2, "A", "C"), (3, "B", "A")], "fid int, dep string, arr string").createOrReplaceTempView("g_fl")
    spark.createDataFrame([("A", "sun"), ("B", "rain"), ("C", "sun")], "city string, sky string").createOrReplaceTempView("g_we")
    return Engine(spark)


BASE = "CREATE SEMANTIC VIEW v TABLES (o AS g_ord PRIMARY KEY (oid), s AS g_seg UNIQUE (cid, vf, vt)) "
RANGE = BASE + "RELATIONSHIPS (o(cid, od) REFERENCES s(cid, BETWEEN vf AND vt EXCLUSIVE)) FACTS (o.a AS amt, PRIVATE o.half AS amt / 2) DIMENSIONS (s.seg AS seg, o.cid AS cid) METRICS (o.total AS SUM(a), o.n AS COUNT(oid), mean AS total / n)"
FLIGHTS = "CREATE SEMANTIC VIEW f TABLES (g_fl PRIMARY KEY (fid), g_we PRIMARY KEY (city)) RELATIONSHIPS (d AS g_fl(dep) REFERENCES g_we, a AS g_fl(arr) REFERENCES g_we) DIMENSIONS (g_we.sky AS sky) METRICS (g_fl.n AS COUNT(fid), g_fl.nd USING (d) AS COUNT(fid), g_fl.na USING (a) AS COUNT(fid))"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_range_join_is_half_open_and_left(e):
    e.deploy(RANGE)
    assert rows(e.query("v", ["seg"], ["total", "n"])) == sorted([("Gold", Decimal("100.00"), 1), ("Plat", Decimal("50.00"), 1), (None, Decimal("7.00"), 1)], key=str)
    assert rows(e.query("v", [], ["mean"]))[0][0] == pytest.approx(Decimal("52.333333"), abs=Decimal("0.0001"))
    assert "LEFT JOIN" in e.explain("v", ["seg"], ["total"]) and "g_seg" not in e.explain("v", ["o.cid"], ["total"])


def test_using_picks_a_path_and_both_meet(e):
    e.deploy(FLIGHTS)
    assert rows(e.query("f", ["sky"], ["nd", "na"])) == [("rain", 1, 1), ("sun", 2, 2)]
    with pytest.raises(QueryError, match="Multi-path relationship"):
        e.query("f", ["sky"], ["n"])


@pytest.mark.parametrize(
    "text, match",
    [
        (BASE + "RELATIONSHIPS (o(cid) REFERENCES s(cid))", "must be the primary or unique key"),
        (BASE + "METRICS (o.x AS SUM(amt), o.x AS COUNT(oid))", "invalid identifier"),
        (BASE + "METRICS (o.x AS SUM(amt), o.y AS AVG(x))", "nested metric"),
        (BASE + "METRICS (o.x AS SUM(amt) USING (d))", "syntax error"),
        (BASE + "DIMENSIONS (o.c AS cid) METRICS (o.x AS SUM(amt), o.w AS SUM(x) OVER (ORDER BY c))", "PARTITION BY"),
    ],
)
def test_refused_at_deployment(e, text, match):
    with pytest.raises(DeployError, match=match):
        e.deploy(text)


def test_refused_at_query(e):
    e.deploy(RANGE)
    for ask, match in [(dict(dimensions=["half"], metrics=["n"]), "no dimension named"), (dict(dimensions=["a"], metrics=["n"]), "no dimension named"), (dict(metrics=["n"], facts=["o.a"]), "Cannot specify FACTS and METRICS"), (dict(metrics=["n"], variables={"k": 1}), "unknown variable")]:
        with pytest.raises(QueryError, match=match):
            e.query("v", **ask)
    e.deploy(BASE.replace(" v ", " w ") + "DIMENSIONS (s.seg AS seg) METRICS (o.n AS COUNT(oid))")
    with pytest.raises(QueryError, match="equal or lower level of granularity"):
        e.query("w", ["seg"], ["n"])


def test_ddl_round_trip_and_dry_run(e):
    view = e.deploy(RANGE.replace(" v ", " dry "), dry_run=True)
    assert "dry" not in e.views
    again = ddl.parse(ddl.to_ddl(view))
    assert ddl.to_ddl(again) == ddl.to_ddl(view)


def test_policies_and_rights(e, spark):
    who = SecurityContext(primary="A")
    p = Engine(spark, Policies(row={"g_ord": "IS_ROLE_IN_SESSION('B') OR cid = 'C1'"}, grants={"v": frozenset({"A"}), "g_ord": frozenset({"A"})}))
    p.deploy(RANGE)
    with pytest.raises(AccessError):
        p.query("v", [], ["total"], context=who)
    p.policies.owner_rights = True
    assert rows(p.query("v", [], ["total"], context=who)) == [(Decimal("150.00"),)]
    assert rows(p.query("v", [], ["total"])) == [(Decimal("157.00"),)]


def test_rollup_is_used_while_fresh(spark, tmp_path):
    now = [1000.0]
    m = Engine(spark, store=str(tmp_path), clock=lambda: now[0])
    m.deploy(RANGE)
    with pytest.raises(DeployError):
        m.add_materialization("v", "r", ["cid"], ["total"])
    with pytest.raises(DeployError):
        m.set_max_staleness("v", 60)
    m.set_max_staleness("v", 300)
    m.add_materialization("v", "r", ["cid"], ["total", "n"])
    assert "parquet." in m.explain("v", ["cid"], ["n"]) and "parquet." not in m.explain("v", ["cid"], ["mean"])
    assert rows(m.query("v", ["cid"], ["total", "n"])) == [("C1", Decimal("150.00"), 2), ("C2", Decimal("7.00"), 1)]
    now[0] += 301
    assert "parquet." not in m.explain("v", ["cid"], ["n"])


@pytest.mark.parametrize(
    "text, want",
    [
        ("a * b / c + 1", "try_divide(a * b, c) + 1"),
        ("x::VARCHAR || 'a/b'", "CAST(x AS STRING) || 'a/b'"),
        ("DATEADD('year', 1, m)", "add_months(m, 12 * (1))"),
        ("IFF(a, b, c)", "if(a, b, c)"),
        ("ARRAY_CONTAINS(x, arr)", "array_contains(arr, x)"),
    ],
)
def test_dialect(text, want):
    assert to_spark(text) == want


def test_entry_points():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_number_variable_rounds_no_column(e):
    e.spark.createDataFrame([(k, Decimal(x)) for k, x in enumerate(["99.99", "100.00", "100.01", "100.49", "-0.30", "1e15"])], "k int, x decimal(18,2)").createOrReplaceTempView("g_cents")
    e.deploy("CREATE SEMANTIC VIEW c TABLES (o AS g_cents PRIMARY KEY (k)) FACTS (o.amount AS x) METRICS (o.n AS COUNT(*)) VARIABLES (least NUMBER DEFAULT 100, most NUMBER(38,1) DEFAULT NULL)")
    ask = lambda where="amount > least", **v: rows(e.query("c", [], ["n"], where=where, variables=v))[0][0]
    assert [ask(), ask(least=100), ask(least=100.4), ask(least="100"), ask(least=-0.0), ask(least=-1), ask(least=10**15 - 1), ask(least=10**30), ask(least=-(10**30)), ask(least=None)] == [3, 3, 3, 3, 5, 6, 1, 0, 6, 0]
    assert [ask("amount > least * 2 - 100"), ask("amount > coalesce(most, 100)"), ask("amount < most", most=100), ask("amount IN (least, 7)")] == [3, 3, 2, 1]


def test_variable_override_is_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from quillon import catalogue

    (d := tmp_path / "odd").mkdir()
    for t in catalogue.TABLES:
        if t != "orders":
            (d / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    con = duckdb.connect()
    odd = "(1, 250000.0), (2, 250000.01), (3, 250000.49), (4, 250000.004), (NULL, 300000), (5, 'NaN'), (6, 'Infinity'), (7, '-Infinity'), (8, 1e20), (9, NULL)"
    con.execute(f"COPY (FROM '/root/testdata/sf0.001/orders.parquet' UNION ALL SELECT k, 1, 'O', CAST(p AS DOUBLE), TIMESTAMP '1996-01-01', CASE WHEN k > 3 THEN 'odd' END FROM (VALUES {odd}) v(k, p)) TO '{d}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS FROM '{d}/orders.parquet'")
    got = catalogue.QUERIES["variable_override"](spark, str(d))
    assert got.columns == ["priority", "orders_n"]
    assert rows(got) == sorted(con.execute(catalogue.ORACLES["variable_override"]).fetchall(), key=str)
