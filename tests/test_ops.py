"""Operations, introspection, graph analytics and ingest on small tables."""

import pytest

from quillon.engine import Engine
from quillon.errors import QueryError, SemanticError
from quillon.governance import ops
from quillon.model import introspect
from quillon.operators import centrality, graph
from quillon.streaming.ingest import auto_ingest

VIEW = "CREATE SEMANTIC VIEW ops_v TABLES (t AS ops_t PRIMARY KEY (k)) FACTS (PRIVATE t.f AS x) DIMENSIONS (t.g AS g WITH SYNONYMS ('group', 'kind')) METRICS (t.s AS SUM(f) WITH SYNONYMS ('kind'), t.n AS COUNT(k) WITH TAG (pii = 'no'), r AS s / n) AI_VERIFIED_QUERIES (q AS (QUESTION 'How many?' SQL 'SELECT * FROM SEMANTIC_VIEW(ops_v METRICS n)'))"


@pytest.fixture(scope="module")
def e(spark):
    spark.createDataFrame([(1, "a", 2), (2, "a", 3), (3, "b", 5)], "k int, g string, x int").createOrReplaceTempView("ops_t")
    e = Engine(spark)
    e.deploy(VIEW)
    return e


def test_introspection(e):
    assert introspect.show_views(e, "ops%").count() == 1
    assert {r.name for r in introspect.dimensions_for_metric(e, "ops_v", "r").collect()} == {"g"}
    assert introspect.tag_references(e, "ops_v").collect()[0].value == "no"
    assert introspect.verified_answer(e, "ops_v", "how MANY").first()[0] == 3
    assert {r.distance for r in introspect.lineage(e, "ops_v", "r").collect()} == {1, 2, 3}
    assert introspect.by_synonym(e, "ops_v", "group") == "t.g"
    with pytest.raises(QueryError, match="ambiguous"):
        introspect.by_synonym(e, "ops_v", "kind")
    assert e.check_keys("ops_v").count() == 0 and introspect.describe(e, "ops_v").count() > 5


def test_clean_room_and_assessment(spark, e):
    room = ops.CleanRoom(spark, {"db.s.t": "ops_t"})
    room.register("count", "v1", "SELECT count(*) AS n FROM IDENTIFIER({{source_table[0]}}) WHERE x >= {{least}}")
    assert room.run("count", "v1", ["db.s.t"], least=3).first().n == 2
    with pytest.raises(SemanticError):
        room.register("count", "v1", "SELECT 1")
    check = lambda i, sql, **k: {"id": i, "control": i[0], "sql": sql, "good": lambda v: v > 2, "watch": lambda v: v > 1, **k}
    df, score = ops.assess(spark, [check("a1", "SELECT 3"), check("b1", "SELECT 2"), check("b2", "SELECT 3", depends_on="b1"), check("c1", "SELECT 0")])
    assert {r.id: r.grade for r in df.collect()} == {"a1": "on_track", "b1": "needs_attention", "b2": "skipped", "c1": "at_risk"}
    assert score == pytest.approx(1 / 3)
    grants = spark.createDataFrame([("top", "mid"), ("mid", "low")], "role string, granted_role string")
    has = spark.createDataFrame([("low", "x")], "role string, object string")
    need = spark.createDataFrame([("top", "x"), ("other", "x")], "role string, object string")
    assert [r.role for r in ops.grant_gaps(need, has, grants).collect()] == ["other"]


def test_graph_analytics(spark):
    nodes = spark.createDataFrame([(x, "n", x.upper(), "{}") for x in "abcdez"], "node_id string, node_type string, name string, props string")
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("a", "q")]
    edges = spark.createDataFrame([(s, d, "t", None) for s, d in pairs], "src_id string, dst_id string, edge_type string, effective_end date")
    assert [r.node_id for r in graph.shortest_path(nodes, edges, "a", "e").orderBy("step").collect()] == ["a", "c", "d", "e"]
    assert graph.shortest_path(nodes, edges, "a", "z").count() == 0
    assert centrality.betweenness(nodes, edges, 2).orderBy("score", ascending=False).first().node_id in "cd"
    assert sum(r.size for r in centrality.communities(nodes, edges).collect()) == 6
    assert centrality.pagerank(nodes, edges, 6).count() == 6
    assert graph.ancestors(nodes, edges, "a", "t").count() == 5
    made, report = graph.run_rules(edges.selectExpr("*", "1.0D as weight", "cast(null as date) effective_start"), [{"kind": "TRANSITIVE", "edge_type": "t", "rule_id": "r"}, {"kind": "PROPERTY_CHAIN", "edge_type": "t", "rule_id": "p"}])
    assert made.count() > 0 and [r["status"][:5] for r in report] == ["OK", "ERROR"]


def test_auto_ingest_goes_on(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for k in range(2):
        spark.createDataFrame([(k, "x")], "k int, v string").write.mode("append").parquet(src)
        auto_ingest(spark, src, "k int, v string", out, ck)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [0, 1]


def test_pagerank_converges(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("c", "e"), ("e", "f"), ("e", "g"), ("e", "h")]
    ids = "abcdefghz"
    nodes = spark.createDataFrame([(x, "n", x.upper(), "{}") for x in ids], "node_id string, node_type string, name string, props string")
    edges = spark.createDataFrame([(s, d, "t", None) for s, d in pairs], "src_id string, dst_id string, edge_type string, effective_end date")
    next_to = {x: [b for a, b in pairs if a == x] + [a for a, b in pairs if b == x] for x in ids}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(500):
        idle = sum(rank[x] for x in ids if not next_to[x])
        rank = {x: 0.15 / len(ids) + 0.85 * (idle / len(ids) + sum(rank[y] / len(next_to[y]) for y in next_to[x])) for x in ids}
    assert {r.node_id: r.score for r in centrality.pagerank(nodes, edges, 9).collect()} == pytest.approx(rank, abs=6e-5)
    with pytest.raises(ValueError, match="converge"):
        centrality.pagerank(nodes, edges, 9, steps=2)


def test_checks_see_every_order(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    from quillon import catalogue

    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    last = con.execute("SELECT max(o_orderkey) FROM orders").fetchone()[0]
    for name in ("cardinality_violations_all", "referential_violations_all"):
        got = sorted(tuple(r) for r in catalogue.QUERIES[name](spark, sf).collect())
        assert got == sorted(con.execute(catalogue.ORACLES[name]).fetchall())
    assert last > 2000 and any(r[2] == f"order:{last}" for r in got)
