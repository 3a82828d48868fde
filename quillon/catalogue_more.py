"""More queries over the driver's tables: policies in plain SQL, semi-structured columns, statements of the warehouse dialect."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalogue import ANALYST, TOTAL, _kg, _read, engine, guarded, op
from quillon.engine import Engine
from quillon.errors import SemanticError
from quillon.model.generated import Ontology, deploy_models
from quillon.model.introspect import verified_answer
from quillon.operators.ordered import numbered, running
from quillon.streaming.dynamic import DynamicTable

# Policies hold however a statement names a governed table ----------------------------------

_ASIA = {"row": lambda p: {f"{p}region": "r_name IN ('ASIA', 'EUROPE')"}}


def governed(name: str, text: str, oracle: str, **held) -> None:
    """Register a statement as an analyst asks it; {p} stands before its tables' names."""
    op(name, lambda s, d: (e := guarded(s, d, **held)).sql(text.format(p=e.prefix), ANALYST), oracle)


governed("policy_shadowing_with", "WITH {p}region AS (SELECT * FROM {p}region) SELECT r_name AS region, COUNT(*) AS nations FROM {p}region JOIN {p}nation ON n_regionkey = r_regionkey GROUP BY ALL", "SELECT r_name AS region, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1", **_ASIA)
governed("policy_window_name", "SELECT r_regionkey, COUNT(*) OVER {p}region AS n FROM {p}region WINDOW {p}region AS (PARTITION BY r_regionkey)", "SELECT r_regionkey, 1 AS n FROM region WHERE r_name IN ('ASIA', 'EUROPE')", **_ASIA)
governed("policy_parentheses", "SELECT n_name, r_name FROM ({p}nation) JOIN (TABLE {p}region) ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')", **_ASIA)
governed("policy_scalar_subquery", "SELECT n_name, (SELECT MAX(r_name) FROM {p}region WHERE r_regionkey = n_regionkey) AS region FROM {p}nation", "SELECT n_name, (SELECT max(r_name) FROM region WHERE r_regionkey = n_regionkey AND r_name IN ('ASIA', 'EUROPE')) AS region FROM nation", **_ASIA)
governed("policy_aggregation_plain_sql", "SELECT c_nationkey, COUNT(*) AS customers, MAX(c_acctbal) AS most FROM {p}customer WHERE c_acctbal > 0 GROUP BY c_nationkey HAVING MAX(c_acctbal) > 100", "SELECT c_nationkey, count(*) AS customers, max(c_acctbal) AS most FROM customer WHERE c_acctbal > 0 GROUP BY 1 HAVING max(c_acctbal) > 100 AND count(*) >= 55", aggregation=lambda p: {f"{p}customer": (55, frozenset({"ADMIN"}))})
governed("policy_projection_plain_sql", "SELECT c_nationkey, COUNT(*) AS customers FROM {p}customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey", "SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1", projection=lambda p: {(f"{p}customer", "c_mktsegment"): frozenset({"ADMIN"})})
governed("policy_grants_plain_sql", "SELECT c_mktsegment AS segment, COUNT(*) AS customers FROM {p}customer GROUP BY 1", "SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY 1", grants=lambda p: {f"{p}customer": frozenset({"ANALYST"})})


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    e = guarded(spark, d, row=lambda p: {f"{p}customer": "c_mktsegment = 'BUILDING'"}, mask=lambda p: {(f"{p}customer", "c_acctbal"): "0"})
    return e.query("guarded", ["status"], ["n"], where=f"o.c IN (SELECT c_custkey FROM {e.prefix}customer WHERE c_acctbal = 0)", context=ANALYST)


op("policy_filter_subquery", _filtered, "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")

WAYS = {
    "file": ("SELECT * FROM parquet.`{d}/customer.parquet`", True),
    "column": ("SELECT c_mktsegment FROM {p}customer", True),
    "expression": ("SELECT CONCAT(c_mktsegment, '!') AS x FROM {p}customer", True),
    "with": ("WITH c AS (SELECT c_mktsegment AS x FROM {p}customer) SELECT x FROM c", True),
    "union": ("SELECT 'a' AS x UNION ALL SELECT c_mktsegment FROM {p}customer", True),
    "view": ("SELECT c_mktsegment FROM {p}customer_view", True),
    "ungranted": ("SELECT o_orderkey FROM {p}orders", True),
    "command": ("CREATE TEMPORARY VIEW x AS SELECT * FROM {p}customer", True),
    "count": ("SELECT COUNT(*) AS n FROM {p}customer WHERE c_mktsegment = 'BUILDING'", False),
}


def _ways(spark: SparkSession, d: str) -> DataFrame:
    """Each way that an analyst may try, and its rows: null where it is refused."""
    e = guarded(spark, d, projection=lambda p: {(f"{p}customer", "c_mktsegment"): frozenset({"ADMIN"})}, grants=lambda p: {f"{p}customer": frozenset({"ANALYST"}), f"{p}customer_view": frozenset({"ANALYST"}), "customer.parquet": frozenset({"ANALYST"})})
    out = None
    for way, (text, _) in WAYS.items():
        try:
            asked = e.sql(text.format(p=e.prefix, d=d), ANALYST).selectExpr(f"'{way}' AS way", "n")
        except SemanticError:
            asked = spark.sql(f"SELECT '{way}' AS way, CAST(NULL AS BIGINT) AS n")
        out = asked if out is None else out.unionByName(asked)
    return out


op("policy_ways_plain_sql", _ways, "SELECT * FROM (VALUES " + ", ".join(f"('{w}')" for w, (_, refused) in WAYS.items() if refused) + ") t(way) CROSS JOIN (SELECT CAST(NULL AS BIGINT) AS n) UNION ALL SELECT 'count', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'")


# Semi-structured columns and statements as they are written for the warehouse ------------------


def on_views(name: str, text: str, oracle: str, **views: str) -> None:
    """Register a statement over temporary views made first; {p} stands before every table's name."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = engine(spark, d)
        for view, sql in views.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {e.prefix}{view} AS {sql.format(p=e.prefix)}")
        return e.sql(text.replace("{p}", e.prefix))

    op(name, run, oracle)


#: One row for each order: what it read, as an array of objects.
ACCESS = """SELECT o_orderkey AS query_id, any_value(o_orderdate) AS query_start_time,
parse_json(to_json(collect_list(named_struct('objectName', concat('"part.', l_partkey, '"'), 'lines', l_quantity)))) AS base_objects_accessed
FROM {p}orders JOIN {p}lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
NODES = "SELECT concat('part:', p_partkey) AS node_id, 'part' AS node_type, p_name AS name, to_json(struct(p_brand, p_size, p_retailprice, array(p_type, p_brand) AS marks, struct(p_type AS kind) AS more)) AS props FROM {p}part"

on_views(
    "unused_storage_share",
    """WITH read_tables AS (
        SELECT DISTINCT UPPER(REGEXP_REPLACE(VALUE:objectName::STRING, '"', '')) AS full_name
        FROM {p}access_history, LATERAL FLATTEN(INPUT => BASE_OBJECTS_ACCESSED)
        WHERE QUERY_START_TIME > DATEADD('day', -90, DATE '1998-08-02')
    ),
    totals AS (SELECT SUM(ACTIVE_BYTES) AS total FROM {p}storage WHERE ACTIVE_BYTES > 0),
    unused AS (
        SELECT SUM(ts.ACTIVE_BYTES) AS unread FROM {p}storage ts
        LEFT JOIN read_tables rt ON UPPER(ts.TABLE_SCHEMA || '.' || ts.TABLE_NAME) = rt.full_name
        WHERE rt.full_name IS NULL AND ts.ACTIVE_BYTES > 0
    )
    SELECT ROUND(na.unread / NULLIF(t.total, 0) * 100, 1) AS unused_pct FROM unused na, totals t""",
    "SELECT round(sum(p_retailprice) FILTER (p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > DATE '1998-08-02' - INTERVAL 90 DAY)) / sum(p_retailprice) * 100, 1) AS unused_pct FROM part",
    access_history=ACCESS,
    storage="SELECT 'part' AS table_schema, CAST(p_partkey AS STRING) AS table_name, CAST(p_retailprice AS DOUBLE) AS active_bytes FROM {p}part",
)
on_views("props_paths", "SELECT NODE_ID AS node_id, PROPS:p_brand::VARCHAR AS brand, PROPS:p_size::INT AS size, PROPS:marks[0]::STRING AS first_mark, PROPS:more.kind::STRING AS kind, PROPS:absent::STRING AS absent FROM {p}kg_part WHERE NODE_TYPE = 'part' AND PROPS:p_size::INT > 10", "SELECT 'part:' || p_partkey AS node_id, p_brand AS brand, p_size AS size, p_type AS first_mark, p_type AS kind, CAST(NULL AS VARCHAR) AS absent FROM part WHERE p_size > 10", kg_part=NODES)
on_views("flatten_objects", "SELECT f.KEY AS key, f.INDEX IS NULL AS no_index, COUNT(*) AS n FROM {p}kg_part, TABLE(FLATTEN(INPUT => PARSE_JSON(PROPS))) f GROUP BY ALL", "SELECT k AS key, true AS no_index, count(*) AS n FROM part, (VALUES ('p_brand'), ('p_size'), ('p_retailprice'), ('marks'), ('more')) t(k) GROUP BY 1", kg_part=NODES)
on_views("flatten_arrays", "SELECT k.NODE_ID AS node_id, m.INDEX AS place, m.PATH AS path, m.VALUE::STRING AS mark FROM {p}kg_part k, LATERAL FLATTEN(INPUT => k.PROPS, PATH => 'marks') m", "SELECT 'part:' || p_partkey AS node_id, i AS place, 'marks[' || i || ']' AS path, CASE i WHEN 0 THEN p_type ELSE p_brand END AS mark FROM part, (VALUES (0), (1)) t(i)", kg_part=NODES)
on_views("flatten_outer", "SELECT k.NODE_ID AS node_id, f.VALUE::STRING AS mark FROM {p}kg_part k, LATERAL FLATTEN(INPUT => IFF(k.PROPS:p_size::INT > 25, k.PROPS:marks, NULL), OUTER => TRUE) f", "SELECT 'part:' || p_partkey AS node_id, m AS mark FROM part, LATERAL (SELECT p_type AS m WHERE p_size > 25 UNION ALL SELECT p_brand WHERE p_size > 25 UNION ALL SELECT NULL WHERE NOT coalesce(p_size > 25, false))", kg_part=NODES)
on_views("listagg_within_group", "SELECT r_name, LISTAGG(n_name, ', ') WITHIN GROUP (ORDER BY n_nationkey DESC) AS nations, LISTAGG(DISTINCT SUBSTR(n_name, 1, 1)) AS letters, (SELECT LISTAGG(n_name, ',') FROM {p}nation WHERE n_nationkey < 0) AS none FROM {p}region LEFT JOIN {p}nation ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, coalesce(string_agg(n_name, ', ' ORDER BY n_nationkey DESC), '') AS nations, coalesce(string_agg(DISTINCT substr(n_name, 1, 1), '' ORDER BY substr(n_name, 1, 1)), '') AS letters, '' AS none FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
on_views("qualify_hidden_order", 'SELECT region, nation FROM shop QUALIFY ROW_NUMBER() OVER (PARTITION BY region ORDER BY orders_n DESC, nation) = 1 ORDER BY orders_n DESC, "region" LIMIT 3', "SELECT region, nation FROM (SELECT r_name AS region, n_name AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, nation) = 1 ORDER BY n DESC, region LIMIT 3")
on_views("qualify_over_table", "SELECT o_custkey AS cust, o_orderkey FROM {p}orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20", "SELECT cust, o_orderkey FROM (SELECT o_custkey AS cust, o_orderkey, o_totalprice AS t FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 ORDER BY t DESC NULLS LAST, o_orderkey LIMIT 20)")

# Logical tables: a union of distinct values, and a subquery named like its source.
CHANNELS = """CREATE SEMANTIC VIEW channels TABLES (
  days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM {p}orders UNION SELECT DISTINCT CAST(ts AS DATE) AS day FROM {p}events) UNIQUE (day),
  {p}customer AS (SELECT * FROM {p}customer WHERE c_acctbal > 5000) UNIQUE (c_custkey),
  o AS {p}orders, e AS {p}events)
RELATIONSHIPS (order_day AS o(on_day) REFERENCES days(day), event_day AS e(at_day) REFERENCES days(day), o(o_custkey) REFERENCES {p}customer)
FACTS (o.on_day AS CAST(o_orderdate AS DATE), e.at_day AS CAST(ts AS DATE))
DIMENSIONS (days.month AS DATE_TRUNC('month', day), {p}customer.segment AS c_mktsegment)
METRICS (o.order_total AS SUM(CAST(o_totalprice AS DECIMAL(18,2))), o.orders_n AS COUNT(*), e.event_total AS SUM(CAST(value AS DECIMAL(18,2))), all_money AS order_total + event_total)"""


def channels(dims: list[str], metrics: list[str]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = engine(spark, d)
        return e.query(e.prepare(CHANNELS.format(p=e.prefix)), dims, metrics)

    return run


_MONTH = "CAST(CAST(date_trunc('month', {}) AS DATE) AS VARCHAR)"
op("union_of_distinct_days", channels(["days.month"], ["order_total", "event_total", "all_money"]), f"SELECT month, CAST(a AS DOUBLE) AS order_total, CAST(b AS DOUBLE) AS event_total, CAST(a + b AS DOUBLE) AS all_money FROM (SELECT {_MONTH.format('o_orderdate')} AS month, {TOTAL} AS a FROM orders GROUP BY 1) FULL JOIN (SELECT {_MONTH.format('ts')} AS month, sum(CAST(value AS DECIMAL(18,2))) AS b FROM events GROUP BY 1) USING (month)")
op("subquery_named_as_source", channels(["segment"], ["orders_n"]), "SELECT c_mktsegment AS segment, count(*) AS orders_n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey GROUP BY 1")


# Order over whole tables, stored rollups, tables that follow a folder ----------------------------

op("row_number_global", lambda s, d: numbered(_read(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], "place").drop("o_totalprice"), "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
op("running_total_global", lambda s, d: running(_read(s, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), [F.asc("o_orderdate"), F.asc("o_orderkey")], F.col("o_totalprice").cast("decimal(18,2)"), "total").select("o_orderkey", "total"), "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total FROM orders")

YEARS = "CREATE SEMANTIC VIEW years TABLES (o AS {p}orders_now PRIMARY KEY (o_orderkey)) FACTS (o.amount AS CAST(o_totalprice AS DECIMAL(18,2))) DIMENSIONS (o.order_year AS YEAR(o_orderdate), o.status AS o_orderstatus) METRICS (o.total AS SUM(amount), o.n AS COUNT(o_orderkey))"


def rolled(spark: SparkSession, d: str, then: Callable[[Engine], None], dims: list[str], metrics: list[str], where: str | None = None) -> DataFrame:
    """A rollup by year of all orders, frozen before 1996; afterwards every price is doubled, then ``then`` happens and a query is asked."""
    now, p = [0.0], engine(spark, d).prefix
    e = Engine(spark, store=spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir"), clock=lambda: now[0])
    e.now = now
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {p}orders_now AS SELECT * FROM {p}orders")
    e.deploy(YEARS.format(p=p))
    e.set_max_staleness("years", 600)
    e.add_materialization("years", "by_year", ["order_year", "status"], ["total", "n"], immutable_where="order_year < 1996")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {p}orders_now AS SELECT * EXCEPT (o_totalprice), 2 * o_totalprice AS o_totalprice FROM {p}orders")
    then(e)
    return e.query("years", dims, metrics, where=where)


def _late(e: Engine) -> None:
    e.now[0] = 601.0


_BY_YEAR = "SELECT year(o_orderdate) AS order_year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) * {} AS total FROM orders GROUP BY 1"
op("rollup_refresh_incremental", lambda s, d: rolled(s, d, lambda e: e.refresh("years", "by_year"), ["order_year"], ["total"]), _BY_YEAR.format("CASE WHEN year(o_orderdate) < 1996 THEN 1 ELSE 2 END"))
op("rollup_fresh", lambda s, d: rolled(s, d, lambda e: None, ["order_year"], ["total"]), _BY_YEAR.format("1"))
op("rollup_stale", lambda s, d: rolled(s, d, _late, ["order_year"], ["total"]), _BY_YEAR.format("2"))
op("rollup_dropped", lambda s, d: rolled(s, d, lambda e: e.drop_materialization("years", "by_year"), ["order_year"], ["total"]), _BY_YEAR.format("2"))
op("rollup_count_of_none", lambda s, d: rolled(s, d, lambda e: None, [], ["n", "total"], "status = 'none'"), "SELECT count(*) AS n, CAST(sum(o_totalprice) AS DOUBLE) AS total FROM orders WHERE o_orderstatus = 'none'")


def _dynamic(spark: SparkSession, d: str) -> DataFrame:
    """Orders by customer as a dynamic table over the folder, refreshed twice: the second finds nothing new."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    schema = _read(spark, d, "orders").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    metrics = {"n": ("count", "o_orderkey"), "least": ("min", "o_totalprice"), "most": ("max", "o_totalprice")}
    table = DynamicTable(spark, d, schema, ["o_custkey"], metrics, f"{where}/quillon/dynamic-{uuid.uuid4().hex}", 60, glob="orders.parquet*")
    table.follow()
    table.refresh()
    return table.read()


op("dynamic_table", _dynamic, "SELECT o_custkey, count(o_orderkey) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")


# Models generated from an ontology over the graph of nations and customers ----------------------

GRAPH = Ontology("geo", {"Region": ("region", {"r_regionkey": "int"}), "Nation": ("nation", {"n_nationkey": "int"}), "Customer": ("customer", {"c_mktsegment": "string", "c_acctbal": "double"})}, {"subClassOf": ("Customer", "Nation")}, {"Region": "Place", "Nation": "Place"})


def generated(name: str, model: str, question: str, oracle: str) -> None:
    """Register a generated model's verified query, asked in its own words."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = Engine(spark)
        nodes, edges = _kg(spark, d)
        deploy_models(e, GRAPH, nodes, edges.where("src_id LIKE 'customer:%'"))
        return verified_answer(e, model, question)

    op(name, run, oracle)


generated("generated_entity_counts", "geo_ontology_model", "How many entities of each type exist?", "SELECT 'Region' AS entity_type, count(*) AS entity_count FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer")
generated("generated_links_by_target", "geo_kg_model", "Which Nation has the most Customer by subClassOf?", "SELECT n_name AS nation_name, count(*) AS subclassof_links FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
generated("generated_cross_type", "geo_ontology_model", "What relationships connect different entity types?", "SELECT 'customer' AS src_type, 'subClassOf' AS rel_name, 'nation' AS dst_type, count(*) AS link_count FROM customer JOIN nation ON c_nationkey = n_nationkey")
