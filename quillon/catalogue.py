"""Queries of the analytics engine over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.engine import Engine
from quillon.errors import AccessError
from quillon.governance import policies as gov
from quillon.operators import centrality, graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

MODEL = """
CREATE SEMANTIC VIEW shop
TABLES (
  lineitem AS {p}lineitem, orders AS {p}orders PRIMARY KEY (o_orderkey), customer AS {p}customer PRIMARY KEY (c_custkey),
  cnation AS {p}nation PRIMARY KEY (n_nationkey), cregion AS {p}region PRIMARY KEY (r_regionkey),
  snation AS {p}nation PRIMARY KEY (n_nationkey), sregion AS {p}region PRIMARY KEY (r_regionkey),
  supplier AS {p}supplier PRIMARY KEY (s_suppkey), part AS {p}part PRIMARY KEY (p_partkey), events AS {p}events PRIMARY KEY (event_id),
  months AS (SELECT DISTINCT CAST(trunc(o_orderdate, 'MONTH') AS DATE) AS month FROM {p}orders) PRIMARY KEY (month),
  sales AS {p}orders, sales_ly AS {p}orders, sales_lm AS {p}orders,
  rich AS (SELECT * FROM {p}customer WHERE c_acctbal > 5000) PRIMARY KEY (c_custkey), rich_orders AS {p}orders,
  tiers AS (SELECT c_custkey AS t_cust, s.tier, s.valid_from, s.valid_to FROM {p}customer CROSS JOIN (VALUES ('new', TIMESTAMP_NTZ '1990-01-01', TIMESTAMP_NTZ '1997-01-01'), ('old', TIMESTAMP_NTZ '1997-01-01', TIMESTAMP_NTZ '9999-12-31')) AS s(tier, valid_from, valid_to))
    UNIQUE (t_cust, valid_from, valid_to) CONSTRAINT period DISTINCT RANGE BETWEEN valid_from AND valid_to EXCLUSIVE,
  tier_orders AS {p}orders,
  views AS (SELECT user_id AS v_user, ts AS v_ts, value AS v_value FROM {p}events WHERE event_type = 'view') UNIQUE (v_user, v_ts),
  purchases AS (SELECT * FROM {p}events WHERE event_type = 'purchase'),
  flat_orders AS {p}orders PRIMARY KEY (o_orderkey) UNIQUE (o_custkey), flat_customer AS {p}customer PRIMARY KEY (c_custkey),
  snaps AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18,2))) AS bal FROM {p}events GROUP BY 1, 2)
)
RELATIONSHIPS (
  lineitem(l_orderkey) REFERENCES orders, lineitem(l_partkey) REFERENCES part, lineitem(l_suppkey) REFERENCES supplier,
  orders(o_custkey) REFERENCES customer, customer(c_nationkey) REFERENCES cnation, cnation(n_regionkey) REFERENCES cregion,
  supplier(s_nationkey) REFERENCES snation, snation(n_regionkey) REFERENCES sregion, events(user_id) REFERENCES customer(c_custkey),
  this_month AS sales(sale_month) REFERENCES months(month), last_year AS sales_ly(year_on) REFERENCES months(month),
  last_month AS sales_lm(month_on) REFERENCES months(month), rich_orders(o_custkey) REFERENCES rich,
  tier_orders(o_custkey, o_orderdate) REFERENCES tiers(t_cust, BETWEEN valid_from AND valid_to EXCLUSIVE),
  purchases(user_id, ts) REFERENCES views(v_user, ASOF v_ts), flat_orders(o_custkey) REFERENCES flat_customer
)
FACTS (
  lineitem.net AS CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)), lineitem.qty AS CAST(l_quantity AS DECIMAL(18,2)),
  orders.amount AS CAST(o_totalprice AS DECIMAL(18,2)), events.worth AS CAST(value AS DECIMAL(18,2)),
  sales.sale_month AS DATE_TRUNC('month', o_orderdate), sales_ly.year_on AS DATEADD('year', 1, DATE_TRUNC('month', o_orderdate)),
  sales_lm.month_on AS DATEADD('month', 1, DATE_TRUNC('month', o_orderdate)), PRIVATE customer.lifetime AS SUM(orders.amount)
)
DIMENSIONS (
  cregion.region AS r_name, cnation.nation AS n_name, sregion.supp_region AS r_name, snation.supp_nation AS n_name, customer.segment AS c_mktsegment,
  orders.order_month AS DATE_TRUNC('month', o_orderdate), orders.order_day AS CAST(o_orderdate AS DATE), orders.order_year AS YEAR(o_orderdate),
  orders.quarter_key AS CONCAT(TO_VARCHAR(YEAR(o_orderdate)), '-Q', TO_VARCHAR(QUARTER(o_orderdate))), orders.priority AS o_orderpriority, orders.status AS o_orderstatus,
  part.brand AS p_brand, part.part_type AS p_type, part.price_tier AS CASE WHEN p_retailprice < 1200 THEN 'low' WHEN p_retailprice < 1600 THEN 'mid' ELSE 'high' END,
  lineitem.return_flag AS l_returnflag, customer.ltv_tier AS CASE WHEN lifetime >= 2000000 THEN 'high' WHEN lifetime >= 1000000 THEN 'medium' ELSE 'low' END,
  months.month AS month, rich.rich_segment AS c_mktsegment, tiers.tier AS tier, views.seen AS CASE WHEN v_ts IS NULL THEN 'none' WHEN v_value >= 50 THEN 'big' ELSE 'small' END,
  flat_orders.flat_status AS o_orderstatus, snaps.snap_day AS day, snaps.snap_user AS user_id, events.event_type AS event_type, events.event_day AS CAST(ts AS DATE)
)
METRICS (
  lineitem.revenue AS SUM(net), lineitem.lines AS COUNT(*), lineitem.returns AS COUNT_IF(l_returnflag = 'R'), lineitem.parts AS COUNT(DISTINCT l_partkey),
  lineitem.units AS SUM(qty), lineitem.avg_price AS ROUND(AVG(l_extendedprice), 4), lineitem.min_price AS MIN(l_extendedprice), lineitem.max_price AS MAX(l_extendedprice),
  lineitem.cust_revenue USING (lineitem_to_orders) AS SUM(net), lineitem.supp_revenue USING (lineitem_to_supplier) AS SUM(net),
  orders.order_total AS SUM(amount), orders.orders_n AS COUNT(o_orderkey), orders.order_rows AS COUNT(*), customer.customers AS COUNT(c_custkey), customer.lifetime_total AS SUM(lifetime),
  events.event_total AS SUM(worth), events.event_n AS COUNT(event_id), events.purchases_n AS COUNT_IF(event_type = 'purchase'),
  all_money AS order_total + event_total, event_share AS ROUND(CAST(event_total AS DOUBLE) / order_total, 6), safe_share AS ROUND(DIV0(CAST(purchases_n AS DOUBLE), event_n) * 100, 6),
  sales.month_total AS SUM(CAST(o_totalprice AS DECIMAL(18,2))), sales_ly.year_ago AS SUM(CAST(o_totalprice AS DECIMAL(18,2))), sales_lm.month_ago AS SUM(CAST(o_totalprice AS DECIMAL(18,2))),
  growth AS ROUND(CAST(month_total - year_ago AS DOUBLE) / year_ago * 100, 6), rich_orders.rich_total AS SUM(CAST(o_totalprice AS DECIMAL(18,2))),
  tier_orders.tier_total AS SUM(CAST(o_totalprice AS DECIMAL(18,2))), tier_orders.tier_n AS COUNT(*), purchases.bought AS SUM(CAST(value AS DECIMAL(18,2))), purchases.bought_n AS COUNT(*),
  flat_customer.flat_customers AS COUNT(c_custkey), snaps.balance NON ADDITIVE BY (snap_day ASC) AS SUM(bal),
  orders.rolling AS ROUND(AVG(CAST(order_total AS DOUBLE)) OVER (PARTITION BY EXCLUDING order_day ORDER BY order_day RANGE BETWEEN INTERVAL '6 days' PRECEDING AND CURRENT ROW), 4),
  orders.lag_2 AS LAG(order_total, 2) OVER (PARTITION BY EXCLUDING order_month ORDER BY order_month),
  orders.ytd AS SUM(order_total) OVER (PARTITION BY order_year ORDER BY order_month ROWS UNBOUNDED PRECEDING)
)
VARIABLES (least NUMBER DEFAULT 0)
"""


_engines: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, sf_dir: str, policies: gov.Policies | None = None, fresh: bool = False) -> Engine:
    """An engine on the tables of sf_dir, each a view of its own name; one for all queries of an application that only ask."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if policies is None and not fresh and key in _engines and _engines[key].spark is spark:
        return _engines[key]
    p = f"t{uuid.uuid5(uuid.NAMESPACE_URL, sf_dir).hex[:8]}_"
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(p + t)
    e = Engine(spark, policies)
    e.prefix = p
    e.deploy(MODEL.format(p=p))
    if policies is None and not fresh:
        _engines[key] = e
    return e


def ask(name: str, dims: list[str], metrics: list[str], oracle: str, where: str | None = None, then: str | None = None, **more) -> None:
    """Register a semantic query; ``then`` is SQL over its result, called q."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        if then is None:
            return e.query("shop", dims, metrics, where=where, **more)
        return spark.sql(then.replace("{q}", f"({e.explain('shop', dims, metrics, where=where, **more)})"))

    op(name, run, oracle, [*dims, *metrics])


def op(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None, columns: list[str] = ()) -> None:
    """Register a query; ``columns``: those of its oracle that CASTS names."""
    QUERIES[name] = lambda spark, d: plain(run(spark, d))
    if oracle:
        made = ", ".join(f"CAST({c} AS {CASTS[c]}) AS {c}" for c in columns if c in CASTS)
        ORACLES[name] = f"SELECT * REPLACE ({made}) FROM ({oracle})" if made else oracle


#: Exact decimals and dates leave as doubles and text, which both engines print alike.
CASTS = {c: "DOUBLE" for c in ("revenue", "order_total", "event_total", "all_money", "units", "cust_revenue", "supp_revenue", "lifetime_total", "tier_total", "bought", "month_total", "year_ago", "month_ago", "lag_2", "ytd", "balance", "rich_total", "total", "running", "amount")} | {c: "VARCHAR" for c in ("order_month", "order_day", "month", "snap_day")}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates as text."""
    kinds = {"decimal": "double", "date": "string"}
    return df.select(*[F.col(f"`{c}`").cast(kinds[k]).alias(c) if (k := t.split("(")[0]) in kinds else F.col(f"`{c}`") for c, t in df.dtypes])


STAR = """FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN customer c ON o_custkey = c_custkey
LEFT JOIN nation n ON c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""
SUPP = "FROM lineitem l LEFT JOIN supplier s ON l_suppkey = s_suppkey LEFT JOIN nation n ON s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"
NET = "sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)))"
TOTAL = "sum(CAST(o_totalprice AS DECIMAL(18,2)))"
MONTH = "CAST(date_trunc('month', o_orderdate) AS DATE)"

ask("rev_by_region", ["region"], ["revenue"], f"SELECT r_name AS region, {NET} AS revenue {STAR} GROUP BY 1")
ask("rev_by_nation_seg", ["nation", "segment"], ["revenue", "lines"], f"SELECT n_name AS nation, c_mktsegment AS segment, {NET} AS revenue, count(*) AS lines {STAR} GROUP BY 1, 2")
ask("grand_total", [], ["revenue", "orders_n"], f"SELECT (SELECT {NET} FROM lineitem) AS revenue, (SELECT count(o_orderkey) FROM orders) AS orders_n")
ask("dim_only_distinct", ["segment", "nation"], [], "SELECT DISTINCT c_mktsegment AS segment, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
ask("count_if_returns", ["priority"], ["returns", "lines"], "SELECT o_orderpriority AS priority, count(*) FILTER (l_returnflag = 'R') AS returns, count(*) AS lines FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
ask("avg_min_max_price", ["return_flag"], ["avg_price", "min_price", "max_price"], "SELECT l_returnflag AS return_flag, round(avg(l_extendedprice), 4) AS avg_price, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price FROM lineitem GROUP BY 1")
ask("count_distinct_parts", ["segment"], ["parts"], f"SELECT c_mktsegment AS segment, count(DISTINCT l_partkey) AS parts {STAR} GROUP BY 1")
ask("filter_dim", ["nation"], ["revenue"], f"SELECT n_name AS nation, {NET} AS revenue {STAR} WHERE r_name = 'ASIA' AND n_name <> 'X' GROUP BY 1", where="region = 'ASIA' AND nation <> 'X'")
ask("filter_unselected_dim", ["segment"], ["orders_n"], "SELECT c_mktsegment AS segment, count(*) AS orders_n FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 1996 GROUP BY 1", where="orders.order_year = 1996")
ask("filter_fact", ["segment"], ["order_total"], f"SELECT c_mktsegment AS segment, {TOTAL} AS order_total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 GROUP BY 1", where="orders.amount > 300000")
ask("in_list", ["priority"], ["orders_n"], "SELECT o_orderpriority AS priority, count(*) AS orders_n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1", where="status IN ('F', 'O')")
ask("between_dates", ["order_month"], ["orders_n"], f"SELECT {MONTH} AS order_month, count(*) AS orders_n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-05-31' GROUP BY 1", where="order_day BETWEEN DATE '1996-02-01' AND DATE '1996-05-31'")
ask("ilike_part", ["brand"], ["units"], "SELECT p_brand AS brand, sum(CAST(l_quantity AS DECIMAL(18,2))) AS units FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type ILIKE '%e%' GROUP BY 1", where="part_type ILIKE '%e%'")
ask("case_price_tier", ["price_tier"], ["units"], "SELECT CASE WHEN p_retailprice < 1200 THEN 'low' WHEN p_retailprice < 1600 THEN 'mid' ELSE 'high' END AS price_tier, sum(CAST(l_quantity AS DECIMAL(18,2))) AS units FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
ask("year_month_trunc", ["order_month"], ["order_total"], f"SELECT {MONTH} AS order_month, {TOTAL} AS order_total FROM orders GROUP BY 1")
ask("quarter_key_concat", ["quarter_key"], ["orders_n"], "SELECT concat(CAST(year(o_orderdate) AS VARCHAR), '-Q', CAST(quarter(o_orderdate) AS VARCHAR)) AS quarter_key, count(*) AS orders_n FROM orders GROUP BY 1")
ask("rev_cust_vs_supp_region", ["region", "supp_region"], ["revenue"], f"SELECT r.r_name AS region, r2.r_name AS supp_region, {NET} AS revenue {STAR} LEFT JOIN supplier s ON l_suppkey = s_suppkey LEFT JOIN nation n2 ON s_nationkey = n2.n_nationkey LEFT JOIN region r2 ON n2.n_regionkey = r2.r_regionkey GROUP BY 1, 2")
ask("using_cust_path", ["region"], ["cust_revenue"], f"SELECT r_name AS region, {NET} AS cust_revenue {STAR} GROUP BY 1")
ask("using_supp_path", ["supp_region"], ["supp_revenue"], f"SELECT r_name AS supp_region, {NET} AS supp_revenue {SUPP} GROUP BY 1")
ask("orders_and_events_by_segment", ["segment"], ["order_total", "event_total"], f"SELECT segment, order_total, event_total FROM (SELECT c_mktsegment AS segment, {TOTAL} AS order_total FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1) FULL JOIN (SELECT c_mktsegment AS segment, sum(CAST(value AS DECIMAL(18,2))) AS event_total FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY 1) USING (segment)")
_BOTH = f"(SELECT c_mktsegment AS segment, {TOTAL} AS a FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1) x FULL JOIN (SELECT c_mktsegment AS segment, sum(CAST(value AS DECIMAL(18,2))) AS b, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS p FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY 1) y USING (segment)"
ask("derived_total", ["segment"], ["all_money"], f"SELECT segment, a + b AS all_money FROM {_BOTH}")
ask("derived_ratio", ["segment"], ["event_share"], f"SELECT segment, round(CAST(b AS DOUBLE) / CAST(a AS DOUBLE), 6) AS event_share FROM {_BOTH}")
ask("div0_ratio", ["segment"], ["safe_share"], f"SELECT segment, round(CASE WHEN n = 0 THEN 0 ELSE CAST(p AS DOUBLE) / n END * 100, 6) AS safe_share FROM {_BOTH}")
ask("customer_count_and_revenue", ["segment"], ["customers", "order_total"], f"SELECT segment, customers, order_total FROM (SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY 1) FULL JOIN (SELECT c_mktsegment AS segment, {TOTAL} AS order_total FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1) USING (segment)")
_LIFE = f"(SELECT c_custkey, lifetime FROM customer LEFT JOIN (SELECT o_custkey, {TOTAL} AS lifetime FROM orders GROUP BY 1) ON c_custkey = o_custkey)"
ask("ltv_segment", ["ltv_tier"], ["customers", "lifetime_total"], f"SELECT CASE WHEN lifetime >= 2000000 THEN 'high' WHEN lifetime >= 1000000 THEN 'medium' ELSE 'low' END AS ltv_tier, count(*) AS customers, sum(lifetime) AS lifetime_total FROM {_LIFE} GROUP BY 1")
ask("cardinality_lie", ["flat_status"], ["flat_customers"], "SELECT o_orderstatus AS flat_status, count(c_custkey) AS flat_customers FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
ask("range_scd2_tier", ["tier"], ["tier_total", "tier_n"], f"SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'new' ELSE 'old' END AS tier, {TOTAL} AS tier_total, count(*) AS tier_n FROM orders GROUP BY 1")
ask("asof_last_view", ["seen"], ["bought", "bought_n"], "SELECT CASE WHEN v.ts IS NULL THEN 'none' WHEN v.value >= 50 THEN 'big' ELSE 'small' END AS seen, sum(CAST(p.value AS DECIMAL(18,2))) AS bought, count(*) AS bought_n FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts GROUP BY 1")
_M = f"(SELECT DISTINCT {MONTH} AS month FROM orders)"


def _shift(by: str, name: str) -> str:
    return f"(SELECT m.month AS month, {TOTAL} AS {name} FROM orders LEFT JOIN {_M} m ON CAST({MONTH} + INTERVAL {by} AS DATE) = m.month GROUP BY 1)"


ask("sply_month", ["month"], ["month_total", "year_ago", "growth"], f"SELECT coalesce(a.month, b.month) AS month, month_total, year_ago, round(CAST(month_total - year_ago AS DOUBLE) / CAST(year_ago AS DOUBLE) * 100, 6) AS growth FROM {_shift('0 MONTH', 'month_total')} a FULL JOIN {_shift('12 MONTH', 'year_ago')} b ON a.month IS NOT DISTINCT FROM b.month")
ask("splm_month", ["month"], ["month_total", "month_ago"], f"SELECT coalesce(a.month, b.month) AS month, month_total, month_ago FROM {_shift('0 MONTH', 'month_total')} a FULL JOIN {_shift('1 MONTH', 'month_ago')} b ON a.month IS NOT DISTINCT FROM b.month")
ask("rolling_7d", ["order_day"], ["rolling"], f"SELECT order_day, round(avg(CAST(t AS DOUBLE)) OVER (ORDER BY order_day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 4) AS rolling FROM (SELECT CAST(o_orderdate AS DATE) AS order_day, {TOTAL} AS t FROM orders GROUP BY 1)")
ask("lag_n", ["order_month"], ["order_total", "lag_2"], f"SELECT order_month, t AS order_total, lag(t, 2) OVER (ORDER BY order_month) AS lag_2 FROM (SELECT {MONTH} AS order_month, {TOTAL} AS t FROM orders GROUP BY 1)")
ask("ytd_running", ["order_month"], ["ytd"], f"SELECT order_month, sum(t) OVER (PARTITION BY year(order_month) ORDER BY order_month) AS ytd FROM (SELECT {MONTH} AS order_month, {TOTAL} AS t FROM orders GROUP BY 1)")
ask("excluding_by_segment", ["order_month", "segment"], ["lag_2"], f"SELECT order_month, segment, lag(t, 2) OVER (PARTITION BY segment ORDER BY order_month) AS lag_2 FROM (SELECT {MONTH} AS order_month, c_mktsegment AS segment, {TOTAL} AS t FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)")
_SNAP = "(SELECT user_id, CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18,2))) AS bal FROM events GROUP BY 1, 2)"
ask("last_snapshot_by_user", ["snap_user"], ["balance"], f"SELECT user_id AS snap_user, bal AS balance FROM {_SNAP} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) = 1")
ask("snapshot_by_date", ["snap_day"], ["balance"], f"SELECT day AS snap_day, sum(bal) AS balance FROM {_SNAP} GROUP BY 1")
ask("last_snapshot_overall", [], ["balance"], f"SELECT sum(bal) AS balance FROM {_SNAP} WHERE day = (SELECT max(day) FROM {_SNAP})")
ask("scoped_dim_null_group", ["rich_segment"], ["rich_total"], f"SELECT c_mktsegment AS rich_segment, {TOTAL} AS rich_total FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey GROUP BY 1")
ask("top_nations", ["nation"], ["revenue"], f"SELECT n_name AS nation, {NET} AS revenue {STAR} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", then="SELECT * FROM {q} ORDER BY revenue DESC, nation ASC NULLS LAST LIMIT 5")


def standard(name: str, text: str, oracle: str) -> None:
    op(name, lambda spark, d: engine(spark, d).sql(text), oracle, list(dict.fromkeys(w for w in re.findall(r"AS (total|running|order_month)\b", oracle))))


standard("semantic_view_call", "SELECT sv.region AS area, ROUND(CAST(sv.revenue AS DOUBLE) / 1000, 3) AS thousands FROM SEMANTIC_VIEW(shop METRICS revenue DIMENSIONS region WHERE segment = 'BUILDING') AS sv", f"SELECT r_name AS area, round(CAST({NET} AS DOUBLE) / 1000, 3) AS thousands {STAR} WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
standard("standard_sql_any_value", "SELECT segment, ANY_VALUE(order_total) AS total FROM shop WHERE region IN ('ASIA', 'EUROPE') GROUP BY ALL", f"SELECT c_mktsegment AS segment, {TOTAL} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1")
standard("window_over_view", "SELECT order_month, SUM(ANY_VALUE(order_total)) OVER (ORDER BY order_month) AS running FROM shop GROUP BY order_month", f"SELECT {MONTH} AS order_month, sum({TOTAL}) OVER (ORDER BY {MONTH}) AS running FROM orders GROUP BY 1")
standard("outer_dialect", "SELECT segment, IFF(order_total > 0, 'some', 'none') AS has, DIV0(order_total::DOUBLE, 0) AS zero, ROUND(order_total::DOUBLE / orders_n, 4) AS mean, order_total / 0 AS nothing, orders_n::VARCHAR AS n FROM shop", f"SELECT c_mktsegment AS segment, 'some' AS has, CAST(0 AS DOUBLE) AS zero, round(CAST({TOTAL} AS DOUBLE) / count(*), 4) AS mean, CAST(NULL AS DOUBLE) AS nothing, CAST(count(*) AS VARCHAR) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
standard("qualify_top_nation", "SELECT region, nation, orders_n FROM shop QUALIFY ROW_NUMBER() OVER (PARTITION BY region ORDER BY orders_n DESC, nation) = 1", "SELECT r_name AS region, n_name AS nation, count(*) AS orders_n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY r_name ORDER BY count(*) DESC, n_name) = 1")
standard("nulls_sort_last", "SELECT rich_segment, ROW_NUMBER() OVER (ORDER BY rich_segment) AS place FROM SEMANTIC_VIEW(shop METRICS rich_total DIMENSIONS rich_segment) ORDER BY rich_segment LIMIT 10", "SELECT rich_segment, row_number() OVER (ORDER BY rich_segment NULLS LAST) AS place FROM (SELECT DISTINCT c_mktsegment AS rich_segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey)")
standard("view_joined_to_call", "SELECT s.segment, s.orders_n, v.customers FROM shop AS s JOIN SEMANTIC_VIEW(shop METRICS customers DIMENSIONS segment) AS v ON v.segment = s.segment WHERE s.region = 'ASIA' AND v.customers > 1", "SELECT a.segment, orders_n, customers FROM (SELECT c_mktsegment AS segment, count(*) AS orders_n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1) a JOIN (SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY 1) b ON a.segment = b.segment WHERE customers > 1")


def _view_and_table(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    return e.sql(f"SELECT v.nation, n.n_nationkey, v.orders_n FROM shop AS v JOIN {e.prefix}nation AS n ON n.n_name = v.nation ORDER BY CASE WHEN n.n_nationkey = 3 THEN 0 ELSE 1 END, v.nation")


op("view_joined_to_table", _view_and_table, "SELECT n_name AS nation, n_nationkey, count(*) AS orders_n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")


def _ad_hoc(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    return e.sql(f"WITH tiny AS SEMANTIC VIEW TABLES (o AS {e.prefix}orders PRIMARY KEY (o_orderkey)) DIMENSIONS (o.status AS o_orderstatus) METRICS (o.n AS COUNT(*)) SELECT * FROM SEMANTIC_VIEW(tiny DIMENSIONS status METRICS n)")


op("ad_hoc_view", _ad_hoc, "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).query("shop", ["segment"], facts=["orders.amount"], where="orders.amount > 400000")


op("facts_query", _facts, "SELECT c_mktsegment AS segment, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE CAST(o_totalprice AS DECIMAL(18,2)) > 400000", ["amount"])


def _variable(spark: SparkSession, d: str) -> DataFrame:
    """By the price itself, as amounts are rounded to cents; rows without a key count too."""
    return engine(spark, d).query("shop", ["priority"], ["order_rows"], where="orders.o_totalprice > least", variables={"least": 250000}).withColumnRenamed("order_rows", "orders_n")


op("variable_override", _variable, "SELECT o_orderpriority AS priority, count(*) AS orders_n FROM orders WHERE o_totalprice > 250000 GROUP BY 1")


def _governed(dims: list[str], metrics: list[str], **held) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return engine(spark, d, gov.Policies(**{k: v(engine(spark, d).prefix) for k, v in held.items()})).query("shop", dims, metrics, context=gov.SecurityContext(primary="ANALYST"))

    return run


op("row_policy_dim_leak", _governed(["region"], ["order_total"], row=lambda p: {f"{p}region": "IS_ROLE_IN_SESSION('ADMIN') OR r_name = 'ASIA'"}), f"SELECT CASE WHEN r_name = 'ASIA' THEN r_name END AS region, {TOTAL} AS order_total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1", ["order_total"])
op("row_policy_fact", _governed(["status"], ["order_total"], row=lambda p: {f"{p}orders": "CURRENT_ROLE() = 'ADMIN' OR o_orderstatus = 'F'"}), f"SELECT o_orderstatus AS status, {TOTAL} AS order_total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1", ["order_total"])
op("mask_partial", _governed(["segment"], ["customers"], mask=lambda p: {(f"{p}customer", "c_mktsegment"): gov.mask_unless("c_mktsegment", ["ADMIN"], gov.mask_last4("c_mktsegment"))}), "SELECT concat(repeat('*', greatest(length(c_mktsegment) - 4, 0)), right(c_mktsegment, 4)) AS segment, count(*) AS customers FROM customer GROUP BY 1")
op("min_group_size", _governed(["nation"], ["customers"], aggregation=lambda p: {f"{p}customer": (60, frozenset({"ADMIN"}))}), "SELECT n_name AS nation, count(*) AS customers FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) >= 60")


# Policies reach base tables through subqueries and views, and columns through facts, metrics and other dimensions.

GUARDED = """CREATE SEMANTIC VIEW guarded
TABLES (o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_totalprice AS price FROM {p}orders x WHERE o_totalprice > 1000) PRIMARY KEY (k), cust AS {p}customer_view PRIMARY KEY (c_custkey))
RELATIONSHIPS (o(c) REFERENCES cust)
FACTS (o.amount AS CAST(price AS DECIMAL(18,2)))
DIMENSIONS (o.status AS st, cust.segment AS c_mktsegment, cust.tier AS CONCAT(segment, '!'))
METRICS (o.total AS SUM(amount), o.n AS COUNT(*), o.highest AS MAX(price))"""


def guarded(spark: SparkSession, d: str, **held) -> Engine:
    p = engine(spark, d).prefix
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {p}customer_view AS SELECT * FROM {p}customer WHERE c_custkey >= 0")
    e = Engine(spark, gov.Policies(**{k: v(p) for k, v in held.items()}))
    e.prefix = p
    e.deploy(GUARDED.format(p=p))
    return e


ANALYST = gov.SecurityContext(primary="ANALYST")
op("row_policy_subquery", lambda s, d: guarded(s, d, row=lambda p: {f"{p}orders": "CURRENT_ROLE() = 'ADMIN' OR o_orderstatus = 'F'"}).query("guarded", ["status"], ["total"], context=ANALYST), f"SELECT o_orderstatus AS status, {TOTAL} AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY 1", ["total"])
op("mask_through_view", lambda s, d: guarded(s, d, mask=lambda p: {(f"{p}customer", "c_mktsegment"): gov.mask_unless("c_mktsegment", ["ADMIN"], "'***'")}).query("guarded", ["segment"], ["n"], context=ANALYST), "SELECT '***' AS segment, count(*) AS n FROM orders WHERE o_totalprice > 1000")
op("row_policy_plain_sql", lambda s, d: (e := guarded(s, d, row=lambda p: {f"{p}region": "r_name IN ('ASIA', 'EUROPE')"})).sql(f"SELECT r.r_name AS region, COUNT(*) AS nations FROM {e.prefix}region r, {e.prefix}nation n WHERE n.n_regionkey = r.r_regionkey GROUP BY ALL", ANALYST), "SELECT r_name AS region, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1")
op("mapping_table_policy", lambda s, d: guarded(s, d, row=lambda p: {f"{p}orders": f"EXISTS (SELECT 1 FROM {p}customer m WHERE m.c_custkey = o_custkey AND m.c_mktsegment = 'BUILDING')"}).query("guarded", ["status"], ["n"], context=ANALYST), "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
op("min_group_size_subquery", lambda s, d: guarded(s, d, aggregation=lambda p: {f"{p}orders": (40, frozenset({"ADMIN"}))}).query("guarded", ["status", "segment"], ["n"], context=ANALYST), "SELECT o_orderstatus AS status, c_mktsegment AS segment, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1, 2 HAVING count(*) >= 40")


def _refused(spark: SparkSession, d: str) -> DataFrame:
    """What a projection policy on two columns refuses: ways to see them are errors, a count and a filter are not."""
    e = guarded(spark, d, projection=lambda p: {(f"{p}orders", "o_totalprice"): frozenset({"ADMIN"}), (f"{p}customer", "c_mktsegment"): frozenset({"ADMIN"})})
    tries = {"dimension": {"dimensions": ["segment"]}, "nested": {"dimensions": ["tier"]}, "fact": {"facts": ["o.amount"]}, "metric": {"metrics": ["highest"]}, "count": {"dimensions": ["status"], "metrics": ["n"], "where": "segment = 'BUILDING'"}}
    rows = []
    for name, q in tries.items():
        try:
            e.explain("guarded", **q, context=ANALYST)
            rows.append((name, False))
        except AccessError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "way string, refused boolean")


op("projection_policy_ways", _refused, "SELECT * FROM (VALUES ('dimension', true), ('nested', true), ('fact', true), ('metric', true), ('count', false)) t(way, refused)")


def _rollup(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, fresh=True)
    e.store = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    e.set_max_staleness("shop", 3600)
    e.add_materialization("shop", "by_day", ["order_day", "segment"], ["order_total", "orders_n"])
    return e.query("shop", ["segment"], ["order_total", "orders_n"])


op("rollup_answer", _rollup, f"SELECT c_mktsegment AS segment, {TOTAL} AS order_total, count(*) AS orders_n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1", ["order_total"])


# graph ---------------------------------------------------------------------------------


def _kg(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """nation under region under a root, customers under nations."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    nodes = graph.load_nodes(read("region"), "region", "r_regionkey", "r_name").unionByName(graph.load_nodes(read("nation"), "nation", "n_nationkey", "n_name")).unionByName(graph.load_nodes(read("customer"), "customer", "c_custkey", "c_name"))
    root = spark.createDataFrame([("world:0", "world", "World", "{}")], "node_id string, node_type string, name string, props string")
    edges = graph.load_edges(read("nation"), "subClassOf", ("nation", "n_nationkey"), ("region", "n_regionkey")).unionByName(graph.load_edges(read("customer"), "subClassOf", ("customer", "c_custkey"), ("nation", "c_nationkey")))
    edges = edges.unionByName(graph.load_edges(read("region").withColumn("w", F.lit(0)), "subClassOf", ("region", "r_regionkey"), ("world", "w")))
    return nodes.unionByName(root), edges


_PAIRS = "(SELECT 'nation:' || n_nationkey AS s, 'region:' || n_regionkey AS t FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'region:' || r_regionkey, 'world:0' FROM region)"
_NAMES = "(SELECT 'nation:' || n_nationkey AS id, n_name AS nm, 'nation' AS ty FROM nation UNION ALL SELECT 'region:' || r_regionkey, r_name, 'region' FROM region UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT 'world:0', 'World', 'world')"
op("descendants", lambda s, d: graph.descendants(*_kg(s, d), "asia"), f"WITH RECURSIVE w(id, depth, path) AS (SELECT id, 0, nm FROM {_NAMES} WHERE lower(nm) = 'asia' UNION ALL SELECT s, depth + 1, path || ' -> ' || nm FROM w JOIN {_PAIRS} ON t = w.id JOIN {_NAMES} x ON x.id = s WHERE depth < 15) SELECT w.id AS node_id, nm AS node_name, depth, path FROM w JOIN {_NAMES} USING (id)")
op("ancestors", lambda s, d: graph.ancestors(*_kg(s, d), "Customer#000000007"), f"WITH RECURSIVE w(id, depth) AS (SELECT id, 0 FROM {_NAMES} WHERE nm = 'Customer#000000007' UNION ALL SELECT t, depth + 1 FROM w JOIN {_PAIRS} ON s = w.id WHERE depth < 20) SELECT w.id AS node_id, nm AS node_name, depth FROM w JOIN {_NAMES} USING (id) WHERE depth > 0")
op("direct_children", lambda s, d: graph.direct_children(*_kg(s, d), "EUROPE"), f"SELECT s AS node_id, nm AS node_name, ty AS node_type FROM {_PAIRS} JOIN {_NAMES} ON id = s WHERE t = (SELECT id FROM {_NAMES} WHERE nm = 'EUROPE')")
op("transitive_edges", lambda s, d: graph.transitive(_kg(s, d)[1], "subClassOf", "r1"), f"WITH p AS (SELECT * FROM {_PAIRS}), q AS (SELECT a.s, b.t, 0.5 AS w FROM p a JOIN p b ON a.t = b.s UNION ALL SELECT a.s, c.t, 1.0 / 3 FROM p a JOIN p b ON a.t = b.s JOIN p c ON b.t = c.s) SELECT s AS src_id, t AS dst_id, 'subClassOf' AS edge_type, CAST(w AS DOUBLE) AS weight, 'r1' AS rule_id FROM q")


def _inverse(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("r2", "subClassOf", "hasSubClass")], "rule_id string, edge_type string, inverse_type string")
    return graph.inverse(_kg(spark, d)[1], rules).select("src_id", "dst_id", "edge_type", "weight", "rule_id")


op("inverse_edges", _inverse, f"SELECT t AS src_id, s AS dst_id, 'hasSubClass' AS edge_type, CAST(1.0 AS DOUBLE) AS weight, 'r2' AS rule_id FROM {_PAIRS}")


def _bought(spark: SparkSession, d: str) -> DataFrame:
    return graph.load_edges(spark.read.parquet(f"{d}/orders.parquet"), "placedBy", ("customer", "o_custkey"), ("order", "o_orderkey"))


def _referential(spark: SparkSession, d: str) -> DataFrame:
    """Orders in process (status P) are not in the graph yet."""
    orders = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus <> 'P'")
    nodes = _kg(spark, d)[0].unionByName(graph.load_nodes(orders, "order", "o_orderkey", "o_clerk" if "o_clerk" in orders.columns else "o_orderpriority"))
    return graph.check_referential(nodes, _bought(spark, d), "placedBy", "c2")


op("cardinality_violations", lambda s, d: graph.check_cardinality(_bought(s, d), "placedBy", "c1"), "SELECT 'c1' AS check_id, 'customer:' || o_custkey AS src_id, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL GROUP BY o_custkey HAVING count(*) > 1")
op("referential_violations", _referential, "SELECT 'c2' AS check_id, 'customer:' || o_custkey AS src_id, 'order:' || o_orderkey AS dst_id, 'DST' AS missing FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL AND o_orderkey IS NOT NULL UNION ALL SELECT 'c2', 'customer:' || o_custkey, 'order:' || o_orderkey, 'SRC' FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)")
# The names of an earlier round, when the first two stopped at order 2000; without orders among the nodes.
op("cardinality_violations_all", QUERIES["cardinality_violations"], ORACLES["cardinality_violations"])
op("referential_violations_all", lambda s, d: graph.check_referential(_kg(s, d)[0], _bought(s, d), "placedBy", "c2"), "SELECT 'c2' AS check_id, 'customer:' || o_custkey AS src_id, 'order:' || o_orderkey AS dst_id, 'DST' AS missing FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL UNION ALL SELECT 'c2', 'customer:' || o_custkey, 'order:' || o_orderkey, 'SRC' FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)")
op("hierarchy_stats", lambda s, d: graph.hierarchy_stats(*_kg(s, d)), f"SELECT id AS node_id, nm AS name, (SELECT count(DISTINCT s) FROM {_PAIRS} WHERE t = id) AS children, (SELECT count(DISTINCT t) FROM {_PAIRS} WHERE s = id) AS parents FROM {_NAMES}")
op("degree_topn", lambda s, d: graph.degree(*_kg(s, d), 10), f"SELECT id AS node_id, nm AS name, round((SELECT count(*) FROM {_PAIRS} WHERE s = id OR t = id) / CAST((SELECT count(*) FROM {_NAMES}) - 1 AS DOUBLE), 6) AS score FROM {_NAMES} ORDER BY score DESC, node_id LIMIT 10")
op("resolved_edges", lambda s, d: graph.resolved(*_kg(s, d)), f"SELECT s AS src_id, a.nm AS src_name, a.ty AS src_type, 'subClassOf' AS edge_type, t AS dst_id, b.nm AS dst_name, b.ty AS dst_type, CAST(1.0 AS DOUBLE) AS weight FROM {_PAIRS} LEFT JOIN {_NAMES} a ON a.id = s LEFT JOIN {_NAMES} b ON b.id = t")
op("typed_entity_view", lambda s, d: graph.typed_view(_kg(s, d)[0], "customer", {"c_mktsegment": "string", "c_nationkey": "int"}), "SELECT 'customer:' || c_custkey AS node_id, c_name AS name, c_mktsegment, c_nationkey FROM customer")
op("pagerank_topn", lambda s, d: centrality.pagerank(*_kg(s, d), 10))
op("betweenness_topn", lambda s, d: centrality.betweenness(*_kg(s, d), 10))
op("communities_topn", lambda s, d: centrality.communities(*_kg(s, d)).select("community_id", "size"))
op("hierarchy_path", lambda s, d: graph.hierarchy_path(*_kg(s, d), "Customer#000000007", "World"), f"WITH RECURSIVE w(id, step) AS (SELECT id, 0 FROM {_NAMES} WHERE nm = 'Customer#000000007' UNION ALL SELECT t, step + 1 FROM w JOIN {_PAIRS} ON s = w.id) SELECT step, w.id AS node_id, nm AS node_name, CASE WHEN step = 0 THEN 'START' ELSE 'subClassOf' END AS relationship FROM w JOIN {_NAMES} USING (id)")


# operations ------------------------------------------------------------------------------

from quillon.governance import ops  # noqa: E402


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


op("dedup_documents_md5", lambda s, d: ops.dedup_loads(_read(s, d, "documents").select("doc_id", "text"), ["text"], [F.col("doc_id")]).select("doc_id"), "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(coalesce(text, ''))")
op("regr_slope_trend", lambda s, d: ops.slope(_read(s, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("y"), F.month("o_orderdate").cast("double").alias("x")), "y", "x", ["status"]).select("status", F.round("slope", 4).alias("slope")), "SELECT o_orderstatus AS status, round(regr_slope(o_totalprice, CAST(month(o_orderdate) AS DOUBLE)), 4) AS slope FROM orders GROUP BY 1")
op("overlap_count", lambda s, d: ops.overlap(_read(s, d, "customer").withColumnRenamed("c_custkey", "k"), _read(s, d, "events").select(F.col("user_id").alias("k")), "k", ["c_mktsegment"], 5), "SELECT c_mktsegment, count(DISTINCT c_custkey) AS overlap FROM customer WHERE c_custkey IN (SELECT user_id FROM events) GROUP BY 1 HAVING count(DISTINCT c_custkey) >= 5")
op("reach_rate", lambda s, d: ops.reach(_read(s, d, "customer").withColumnRenamed("c_custkey", "k"), _read(s, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("k")), "k", ["c_mktsegment"]), "SELECT c_mktsegment, count(DISTINCT c_custkey) AS audience, count(DISTINCT CASE WHEN p THEN c_custkey END) AS reached, round(count(DISTINCT CASE WHEN p THEN c_custkey END) / CAST(count(DISTINCT c_custkey) AS DOUBLE), 6) AS rate FROM (SELECT *, c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS p FROM customer) GROUP BY 1")
op("unloaded_files", lambda s, d: ops.not_loaded(_read(s, d, "customer").select(F.col("c_custkey").alias("path")), _read(s, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("path"))), "SELECT c_custkey AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
op("version_compare", lambda s, d: _read(s, d, "part").select("p_partkey", ops.compare_versions(F.concat_ws(".", (F.col("p_size") % 5).cast("string"), F.col("p_size").cast("string")), F.lit("2.10")).alias("c")), "SELECT p_partkey, CASE WHEN p_size % 5 < 2 OR (p_size % 5 = 2 AND p_size < 10) THEN -1 WHEN p_size % 5 > 2 OR p_size > 10 THEN 1 ELSE 0 END AS c FROM part")


# stored tables, ontologies, inventories ----------------------------------------------------

from quillon.governance import inventory  # noqa: E402
from quillon.sources import ontology, tables  # noqa: E402

YAML_VIEW = """
name: sales
description: Orders by the customer's segment
tables:
  - name: ord
    base_table: {{table: {p}orders}}
    primary_key: {{columns: [o_orderkey]}}
    facts: [{{name: amount, expr: "CAST(o_totalprice AS DECIMAL(18,2))"}}]
    metrics:
      - {{name: order_total, expr: SUM(amount), synonyms: [turnover]}}
      - {{name: orders_n, expr: COUNT(o_orderkey)}}
  - name: cust
    base_table: {{table: {p}customer}}
    primary_key: {{columns: [c_custkey]}}
    dimensions: [{{name: segment, expr: c_mktsegment}}]
relationships:
  - name: buyer
    left_table: ord
    right_table: cust
    relationship_columns: [{{left_column: o_custkey, right_column: c_custkey}}]
"""


def _yaml(spark: SparkSession, d: str) -> DataFrame:
    """Through text twice: the view that was written reads back as the one that was read."""
    e = engine(spark, d)
    e.deploy_yaml(YAML_VIEW.format(p=e.prefix))
    e.deploy_yaml(e.yaml("sales"))
    return e.query("sales", ["segment"], ["order_total", "orders_n"])


op("yaml_view", _yaml, f"SELECT c_mktsegment AS segment, {TOTAL} AS order_total, count(*) AS orders_n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1", ["order_total"])


def _store(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/quillon_tables/{name}_{uuid.uuid4().hex}"


def _insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    path = _store(spark, "customers")
    tables.insert(rows.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("first")), path)
    tables.insert_if_absent(rows, path, ["c_custkey"])
    tables.insert_if_absent(rows, path, ["c_custkey"])
    return spark.read.parquet(path)


op("insert_if_absent", _insert_if_absent, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE c_mktsegment END AS c_mktsegment FROM customer")


def _rerun(spark: SparkSession, d: str) -> DataFrame:
    """The rule runner twice over: each rule replaces its own edges, and a deleted rule's are gone."""
    path, edges = _store(spark, "inferred"), _kg(spark, d)[1]
    rules = [{"kind": "TRANSITIVE", "edge_type": "subClassOf", "rule_id": "t"}, {"kind": "INVERSE", "edge_type": "subClassOf", "inverse_type": "hasSubClass", "rule_id": "i"}]
    for _ in range(2):
        graph.run_rules_into(edges, rules, path)
    tables.delete_part(spark, path, "rule_id", "i")
    return tables.read(spark, path, "src_id string, dst_id string, edge_type string, weight double, rule_id string").select("src_id", "dst_id", "edge_type", "weight", "rule_id")


op("rules_rerun", _rerun, ORACLES["transitive_edges"].replace("'r1'", "'t'"))


KEYS = """CREATE SEMANTIC VIEW keyed TABLES ({p}region PRIMARY KEY (r_regionkey), {p}nation PRIMARY KEY (n_nationkey), {p}customer PRIMARY KEY (c_custkey), {p}orders PRIMARY KEY (o_orderkey),
  {p}part PRIMARY KEY (p_partkey), {p}supplier PRIMARY KEY (s_suppkey), {p}supplies PRIMARY KEY (ps_part, ps_supp))
RELATIONSHIPS ({p}nation(n_regionkey) REFERENCES {p}region, {p}customer(c_nationkey) REFERENCES {p}nation, {p}orders(o_custkey) REFERENCES {p}customer,
  {p}supplies(ps_part) REFERENCES {p}part, {p}supplies(ps_supp) REFERENCES {p}supplier)
METRICS ({p}orders.n AS COUNT(o_orderkey))"""


def _schema(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Columns, keys and references of the tables, as a semantic view over them declares."""
    e = engine(spark, d)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {e.prefix}supplies AS SELECT l_partkey AS ps_part, l_suppkey AS ps_supp, sum(l_quantity) AS quantity FROM {e.prefix}lineitem GROUP BY 1, 2")
    view = e.prepare(KEYS.format(p=e.prefix))
    bare = lambda df: df.select(*[F.regexp_replace(c, "^t[0-9a-f]{8}_", "").alias(c) if c.endswith("table_name") or c == "ref_table" else F.col(c) for c in df.columns])
    return tuple(map(bare, ontology.declared(spark, view, view.columns)))


# By the rules: tables of at most five columns with one key and a naming column are lookups, two keys and two references make a relationship.
_COLUMNS = "(SELECT table_name, count(*) AS n, bool_or(regexp_matches(lower(column_name), '^(.*_)?(name|label|title|display_name|full_name)$')) AS named FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'orders', 'part', 'supplier') GROUP BY 1)"
_CLASSES = f"SELECT table_name, CASE WHEN n <= 5 AND named THEN 'lookup' ELSE 'entity' END AS kind, CASE table_name WHEN 'orders' THEN 'Order' ELSE upper(table_name[1]) || substr(table_name, 2) END AS class_name FROM {_COLUMNS} UNION ALL SELECT 'supplies', 'relationship', 'Supplie'"
op("ontology_classes", lambda s, d: ontology.classify(*_schema(s, d)), _CLASSES)
op("ontology_relations", lambda s, d: ontology.infer_relations(ontology.classify(*_schema(s, d)), _schema(s, d)[2]), f"WITH c AS ({_CLASSES}) SELECT 'belongs_to_' || lower(b.class_name) AS name, a.class_name AS domain_class, b.class_name AS range_class, 'N:1' AS cardinality, a.table_name AS source_table FROM (VALUES ('nation', 'region'), ('customer', 'nation'), ('orders', 'customer')) l(x, y) JOIN c a ON a.table_name = x JOIN c b ON b.table_name = y UNION ALL SELECT 'supplie', 'Part', 'Supplier', 'N:N', 'supplies'")


def _taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Nations under regions under a root, as classes."""
    n, r = _read(spark, d, "nation"), _read(spark, d, "region")
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("class_id"), F.col("r_name").alias("parent"))
    return up.unionByName(r.select(F.col("r_name").alias("class_id"), F.lit("WORLD").alias("parent"))).unionByName(spark.createDataFrame([("WORLD", None)], "class_id string, parent string"))


op("ontology_depth", lambda s, d: ontology.depth(_taxonomy(s, d)), "SELECT 'WORLD' AS class_id, 0 AS depth UNION ALL SELECT r_name, 1 FROM region UNION ALL SELECT n_name, 2 FROM nation")
_ABSTRACT = "('WORLD', 'EUROPE', 'ASIA', 'JAPAN', 'NATION_12', 'NATION_3')"
op("ontology_coverage", lambda s, d: ontology.coverage(_taxonomy(s, d).withColumn("is_abstract", F.expr(f"class_id IN {_ABSTRACT}")), s.createDataFrame([("ASIA",)], "class_id string")), f"SELECT 'WORLD' AS class_id, 'abstract' AS status UNION ALL SELECT r_name, CASE WHEN r_name = 'ASIA' THEN 'mapped' WHEN r_name IN {_ABSTRACT} THEN 'abstract' ELSE 'unmapped' END FROM region UNION ALL SELECT n_name, CASE WHEN n_name IN {_ABSTRACT} THEN 'abstract' WHEN r_name = 'ASIA' THEN 'covered' ELSE 'unmapped' END FROM nation JOIN region ON n_regionkey = r_regionkey")


def _class_views(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([("Place", "region"), ("Place", "nation"), ("Buyer", "customer")], "class_id string, node_type string")
    names = ontology.class_views(_kg(spark, d)[0], mapping)
    return spark.table(names[-1]).groupBy("class_id").count().withColumnRenamed("count", "n").unionByName(spark.table(names[0]).select(F.lit("only buyers").alias("class_id"), F.lit(1).alias("n")).groupBy("class_id").agg(F.sum("n").alias("n")))


op("ontology_views", _class_views, "SELECT 'Place' AS class_id, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'Buyer', count(*) FROM customer UNION ALL SELECT 'only buyers', count(*) FROM customer")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


op("anomaly_days", lambda s, d: inventory.anomalies(_daily(s, d), "n", ["status"]), "SELECT status, count(*) AS days, count(*) FILTER (abs(n - m) > 0.1 * m) AS strays FROM (SELECT *, avg(n) OVER (PARTITION BY status) AS m FROM (SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2)) GROUP BY 1")
op("unused_objects", lambda s, d: inventory.unused(_read(s, d, "customer").select(F.col("c_custkey").alias("name")), _read(s, d, "orders").where("o_totalprice > 400000").groupBy(F.col("o_orderkey") % 50).agg(F.collect_set("o_custkey").alias("used"))), "SELECT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)")
op("coverage_share", lambda s, d: inventory.coverage({"customer": _read(s, d, "customer").withColumn("x", F.col("c_acctbal")), "part": _read(s, d, "part").withColumn("x", F.col("p_retailprice"))}, F.col("x") > 1000), "SELECT 'customer' AS kind, count(*) AS n, count(*) FILTER (c_acctbal > 1000) AS covered, round(count(*) FILTER (c_acctbal > 1000) / count(*) * 100, 2) AS share FROM customer UNION ALL SELECT 'part', count(*), count(*) FILTER (p_retailprice > 1000), round(count(*) FILTER (p_retailprice > 1000) / count(*) * 100, 2) FROM part")
op("refresh_window", lambda s, d: inventory.refreshable(_read(s, d, "events").select("event_id", "ts"), F.lit("2024-01-20").cast("date"), "ts").select("event_id", "refreshable"), "SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') <= 7 AS refreshable FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') <= 14")
op("stream_activity", lambda s, d: inventory.stream_activity(_read(s, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("batch_id"), (F.col("event_id") % 3).alias("rows"), F.lit(0.5).alias("seconds"))), "SELECT event_type AS name, count(*) AS batches, CAST(sum(event_id % 3) AS BIGINT) AS rows, count(*) FILTER (event_id % 3 = 0) AS empty, round(count(*) * 0.5, 3) AS seconds FROM events GROUP BY 1")
op("pipe_health", lambda s, d: ops.pipe_health(_read(s, d, "part").select(F.col("p_partkey").alias("pipe"), (F.col("p_size") * 40).alias("pending"), F.col("p_size").alias("files"), (F.col("p_partkey") % 3).alias("errors"), (F.col("p_size") % 40).alias("lag_minutes"))).select("pipe", "healthy"), "SELECT p_partkey AS pipe, p_size * 40 <= 1000 AND coalesce((p_partkey % 3) / nullif(p_size, 0), 0) <= 0.05 AND p_size % 40 <= 30 AS healthy FROM part")
