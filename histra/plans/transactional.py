"""The stock-and-order analytical queries, over an order-entry schema made from the given tables, and statement templates.

oorder and order_line come from orders and lineitem, stock and item from parts and suppliers. The computed join keys (a remainder
of a product, the code of a letter) are kept, as they are what these shapes test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import dialect

_BASE = """
item AS (SELECT p_partkey AS i_id, p_name AS i_name, p_type AS i_data, p_retailprice AS i_price FROM part),
stock AS (SELECT p_partkey AS s_i_id, p_partkey % 10 + 1 AS s_w_id, (p_partkey * 7) % 91 AS s_quantity, p_size AS s_order_cnt, ((p_partkey % 10 + 1) * p_partkey) % (SELECT count(*) FROM supplier) AS su_key FROM part),
oorder AS (SELECT o_orderkey AS o_id, o_custkey AS o_c_id, o_orderkey % 10 + 1 AS o_d_id, o_orderdate AS o_entry_d, cast(substring(o_orderpriority, 1, 1) AS int) AS o_carrier_id FROM orders),
order_line AS (SELECT l_orderkey AS ol_o_id, l_linenumber AS ol_number, l_partkey AS ol_i_id, l_partkey % 10 + 1 AS ol_supply_w_id, l_quantity AS ol_quantity, l_extendedprice AS ol_amount, l_shipdate AS ol_delivery_d FROM lineitem)"""


def _q(body: str, *more: str) -> str:
    return f"WITH {','.join([_BASE, *more])}\n{body}"


QUERIES = {
    "c1_lines_by_number": _q("SELECT ol_number, round(sum(ol_quantity), 2) AS sum_qty, round(sum(ol_amount), 2) AS sum_amount, round(avg(ol_quantity), 4) AS avg_qty, round(avg(ol_amount), 4) AS avg_amount, count(*) AS count_order FROM order_line WHERE ol_delivery_d > date '1996-01-02' GROUP BY ol_number"),
    "c2_least_stock": _q(
        "SELECT s_suppkey, s_name, n_name, i_id, i_name FROM item JOIN stock ON i_id = s_i_id JOIN supplier ON su_key = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN least ON m_i_id = su_key AND m_quantity = s_quantity WHERE i_data LIKE '%O%' AND r_name LIKE 'EUROP%'",
        "least AS (SELECT su_key AS m_i_id, min(s_quantity) AS m_quantity FROM stock GROUP BY su_key)",
    ),
    "c3_open_orders": _q("SELECT ol_o_id, round(sum(ol_amount), 2) AS revenue, cast(cast(o_entry_d AS date) AS varchar(10)) AS entry FROM customer JOIN oorder ON o_c_id = c_custkey JOIN order_line ON ol_o_id = o_id WHERE c_mktsegment LIKE 'A%' AND o_entry_d > date '2001-01-01' GROUP BY ol_o_id, o_entry_d"),
    "c4_late_orders": _q("SELECT o_carrier_id, count(*) AS order_count FROM oorder WHERE o_entry_d >= date '1997-01-01' AND EXISTS (SELECT 1 FROM order_line WHERE ol_o_id = o_id AND ol_delivery_d >= o_entry_d + INTERVAL 80 DAY) GROUP BY o_carrier_id"),
    "c5_letter_key": _q("SELECT n_name, round(sum(ol_amount), 2) AS revenue FROM customer JOIN oorder ON o_c_id = c_custkey JOIN order_line ON ol_o_id = o_id JOIN stock ON s_i_id = ol_i_id JOIN supplier ON su_key = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE ascii(substring(c_mktsegment, 1, 1)) % 25 = s_nationkey AND r_name IN ('ASIA', 'AFRICA', 'EUROPE', 'AMERICA') GROUP BY n_name"),
    "c6_revenue": _q("SELECT round(sum(ol_amount), 2) AS revenue FROM order_line WHERE ol_delivery_d >= date '1996-01-01' AND ol_delivery_d < date '2000-01-01' AND ol_quantity BETWEEN 1 AND 20"),
    "c7_nation_pairs": _q("SELECT s_nationkey AS supp_nation, c_nationkey AS cust_nation, cast(year(o_entry_d) AS bigint) AS l_year, round(sum(ol_amount), 2) AS revenue FROM supplier JOIN stock ON su_key = s_suppkey JOIN order_line ON ol_i_id = s_i_id JOIN oorder ON o_id = ol_o_id JOIN customer ON c_custkey = o_c_id JOIN nation n1 ON n1.n_nationkey = s_nationkey JOIN nation n2 ON n2.n_nationkey = c_nationkey WHERE (n1.n_name = 'NATION_5' AND n2.n_name = 'NATION_6') OR (n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_5') GROUP BY s_nationkey, c_nationkey, year(o_entry_d)"),
    "c8_share": _q("SELECT cast(year(o_entry_d) AS bigint) AS l_year, round(sum(CASE WHEN n2.n_name = 'NATION_7' THEN ol_amount ELSE 0 END) / sum(ol_amount), 6) AS mkt_share FROM item JOIN stock ON i_id = s_i_id JOIN supplier ON su_key = s_suppkey JOIN order_line ON ol_i_id = i_id JOIN oorder ON o_id = ol_o_id JOIN customer ON c_custkey = o_c_id JOIN nation n1 ON n1.n_nationkey = c_nationkey JOIN region ON r_regionkey = n1.n_regionkey JOIN nation n2 ON n2.n_nationkey = s_nationkey WHERE r_name = 'EUROPE' AND i_data LIKE '%O' OR i_id < 50 GROUP BY year(o_entry_d)"),
    "c9_profit": _q("SELECT n_name, cast(year(o_entry_d) AS bigint) AS l_year, round(sum(ol_amount), 2) AS sum_profit FROM item JOIN stock ON i_id = s_i_id JOIN supplier ON su_key = s_suppkey JOIN order_line ON ol_i_id = i_id JOIN oorder ON o_id = ol_o_id JOIN nation ON n_nationkey = s_nationkey WHERE i_data LIKE '%M' GROUP BY n_name, year(o_entry_d)"),
    "c10_customers": _q("SELECT c_custkey, c_name, round(sum(ol_amount), 2) AS revenue, n_name FROM customer JOIN oorder ON o_c_id = c_custkey JOIN order_line ON ol_o_id = o_id JOIN nation ON n_nationkey = c_nationkey WHERE o_entry_d >= date '2000-06-01' AND o_entry_d <= ol_delivery_d GROUP BY c_custkey, c_name, n_name"),
    "c11_weighty_stock": _q(
        "SELECT s_i_id, ordercount FROM held WHERE ordercount > (SELECT sum(ordercount) * 0.005 FROM held)",
        "held AS (SELECT s_i_id, cast(sum(s_order_cnt) AS bigint) AS ordercount FROM stock JOIN supplier ON su_key = s_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY s_i_id)",
    ),
    "c12_carriers": _q("SELECT ol_number, cast(sum(CASE WHEN o_carrier_id IN (1, 2) THEN 1 ELSE 0 END) AS bigint) AS high_line_count, cast(sum(CASE WHEN o_carrier_id NOT IN (1, 2) THEN 1 ELSE 0 END) AS bigint) AS low_line_count FROM oorder JOIN order_line ON ol_o_id = o_id WHERE o_entry_d <= ol_delivery_d AND ol_delivery_d < date '2020-01-01' GROUP BY ol_number"),
    "c13_orders_per_customer": _q("SELECT c_count, count(*) AS custdist FROM per_customer GROUP BY c_count", "per_customer AS (SELECT c_custkey, count(o_id) AS c_count FROM customer LEFT JOIN oorder ON o_c_id = c_custkey AND o_carrier_id > 2 GROUP BY c_custkey)"),
    "c14_promotion": _q("SELECT round(100.0 * sum(CASE WHEN i_data LIKE 'PR%' THEN ol_amount ELSE 0 END) / (1 + sum(ol_amount)), 6) AS promo_revenue FROM order_line JOIN item ON ol_i_id = i_id WHERE ol_delivery_d >= date '1996-01-02' AND ol_delivery_d < date '2020-01-02'"),
    "c15_best_supplier": _q(
        "SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON supplier_no = s_suppkey WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)",
        "revenue AS (SELECT su_key AS supplier_no, round(sum(ol_amount), 2) AS total_revenue FROM order_line JOIN stock ON ol_i_id = s_i_id AND ol_supply_w_id = s_w_id WHERE ol_delivery_d >= date '1997-01-02' GROUP BY su_key)",
    ),
    "c16_suppliers_of_items": _q("SELECT i_name, substring(i_data, 1, 3) AS brand, i_price, count(DISTINCT su_key) AS supplier_cnt FROM stock JOIN item ON i_id = s_i_id WHERE i_data NOT LIKE 'ME%' AND su_key NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY i_name, substring(i_data, 1, 3), i_price"),
    "c17_small_lines": _q("SELECT round(sum(ol_amount) / 2.0, 2) AS avg_yearly FROM order_line JOIN usual ON ol_i_id = u_id WHERE ol_quantity < a", "usual AS (SELECT i_id AS u_id, avg(ol_quantity) AS a FROM item JOIN order_line ON ol_i_id = i_id WHERE i_data LIKE '%L' GROUP BY i_id)"),
    "c18_big_orders": _q("SELECT c_name, o_id, round(sum(ol_amount), 2) AS amount FROM customer JOIN oorder ON o_c_id = c_custkey JOIN order_line ON ol_o_id = o_id GROUP BY c_name, o_id HAVING sum(ol_amount) > 300000"),
    "c19_three_ways": _q("SELECT round(sum(ol_amount), 2) AS revenue FROM order_line JOIN item ON ol_i_id = i_id WHERE (i_data LIKE '%O' AND ol_quantity BETWEEN 1 AND 10 AND i_price BETWEEN 1 AND 4000 AND ol_supply_w_id IN (1, 2, 3)) OR (i_data LIKE '%Y' AND ol_quantity BETWEEN 1 AND 10 AND i_price BETWEEN 1 AND 4000 AND ol_supply_w_id IN (1, 2, 4)) OR (i_data LIKE '%L' AND ol_quantity BETWEEN 1 AND 10 AND i_price BETWEEN 1 AND 4000 AND ol_supply_w_id IN (1, 5, 3))"),
    "c20_spare_stock": _q("SELECT s_name, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name < 'NATION_3' AND s_suppkey IN (SELECT su_key FROM stock JOIN order_line ON ol_i_id = s_i_id WHERE ol_delivery_d > date '1997-05-23' AND s_i_id IN (SELECT i_id FROM item WHERE i_data LIKE 'S%') GROUP BY s_i_id, su_key, s_quantity HAVING 20 * s_quantity > sum(ol_quantity))"),
    "c21_last_deliveries": _q("SELECT s_name, count(*) AS numwait FROM supplier JOIN stock ON su_key = s_suppkey JOIN order_line l1 ON l1.ol_i_id = s_i_id JOIN oorder ON o_id = l1.ol_o_id JOIN nation ON n_nationkey = s_nationkey WHERE l1.ol_delivery_d > o_entry_d + INTERVAL 30 DAY AND n_name = 'NATION_8' AND NOT EXISTS (SELECT 1 FROM order_line l2 WHERE l2.ol_o_id = l1.ol_o_id AND l2.ol_delivery_d > l1.ol_delivery_d) GROUP BY s_name"),
    "c22_idle_customers": _q("SELECT substring(c_mktsegment, 1, 1) AS country, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE substring(c_mktsegment, 1, 1) IN ('A', 'B', 'F', 'H') AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM oorder WHERE o_c_id = c_custkey AND o_carrier_id = 1) GROUP BY substring(c_mktsegment, 1, 1)"),
    # Statement shapes whose text is put together at run time.
    "t1_observations": "SELECT event_id, event_type, user_id FROM events WHERE user_id = 7 AND event_id BETWEEN 100 AND 5000 AND event_type IN ('click', 'view', 'error')",
    "t2_membership_join": "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate BETWEEN date '1997-01-01' AND date '1997-01-31' AND c_nationkey IN (1, 2, 3)",
    "t3_digest_work": "SELECT count(*) AS n FROM (SELECT md5(concat(md5(concat(c_name, 'x')), 'y')) AS d FROM customer) q WHERE d < 'a'",
    "t5_seat_price": "SELECT p_partkey, round(p_retailprice + p_retailprice * (p_size % 10) / 10.0, 4) AS price FROM part WHERE p_size > 40",
    "t6_stock_level": _q("SELECT count(DISTINCT s_i_id) AS low_stock FROM order_line JOIN stock ON s_i_id = ol_i_id AND s_w_id = ol_supply_w_id WHERE ol_o_id BETWEEN 100 AND 400 AND s_quantity < 20"),
}

#: The orders in which the statements return their rows.
ORDERS = {
    "c1_lines_by_number": "ol_number",
    "c2_least_stock": "n_name, s_name, i_id",
    "c3_open_orders": "revenue DESC, entry",
    "c4_late_orders": "o_carrier_id",
    "c5_letter_key": "revenue DESC",
    "c7_nation_pairs": "supp_nation, cust_nation, l_year",
    "c8_share": "l_year",
    "c9_profit": "n_name, l_year DESC",
    "c10_customers": "revenue DESC",
    "c11_weighty_stock": "ordercount DESC",
    "c12_carriers": "ol_number",
    "c13_orders_per_customer": "custdist DESC, c_count DESC",
    "c15_best_supplier": "s_suppkey",
    "c16_suppliers_of_items": "supplier_cnt DESC",
    "c18_big_orders": "amount DESC, o_id",
    "c20_spare_stock": "s_name",
    "c21_last_deliveries": "numwait DESC, s_name",
    "c22_idle_customers": "country",
}
QUERIES = {name: f"{text} ORDER BY {ORDERS[name]}" if name in ORDERS else text for name, text in QUERIES.items()}

#: Templates with parameters, as a driver with prepared statements would run them.
TEMPLATES = {
    "t4_point_read": ("SELECT c_custkey, c_name FROM customer WHERE c_custkey = :k", {"k": 42}),
    "t4_whole_scan": ("SELECT c_custkey, c_nationkey FROM customer WHERE TRUE ORDER BY c_custkey", {}),
    "t4_equal_scan": ("SELECT c_custkey FROM customer WHERE c_nationkey = :v ORDER BY c_custkey", {"v": 7}),
    "t4_greater_scan": ("SELECT c_custkey FROM customer WHERE c_acctbal > :v ORDER BY c_custkey", {"v": 9000}),
    "t4_less_scan": ("SELECT c_custkey FROM customer WHERE c_acctbal < :v ORDER BY c_custkey", {"v": 0}),
    "t4_remainder_scan": ("SELECT c_custkey FROM customer WHERE c_custkey % :m = :r ORDER BY c_custkey", {"m": 97, "r": 5}),
    "t7_expanded_list": ("SELECT n_name FROM nation WHERE array_contains(:keys, n_nationkey)", {"keys": [1, 5, 9]}),
}

TEMPLATE_ORACLES = {
    "t4_point_read": "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42",
    "t4_whole_scan": "SELECT c_custkey, c_nationkey FROM customer",
    "t4_equal_scan": "SELECT c_custkey FROM customer WHERE c_nationkey = 7",
    "t4_greater_scan": "SELECT c_custkey FROM customer WHERE c_acctbal > 9000",
    "t4_less_scan": "SELECT c_custkey FROM customer WHERE c_acctbal < 0",
    "t4_remainder_scan": "SELECT c_custkey FROM customer WHERE c_custkey % 97 = 5",
    "t7_expanded_list": "SELECT n_name FROM nation WHERE n_nationkey IN (1, 5, 9)",
}


def run_template(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from pyspark.sql import functions as F

    text, args = TEMPLATES[name]
    return dialect.run(spark, sf_dir, text, {k: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else v for k, v in args.items()})


#: Statements whose text differs by dialect; any other dialect takes the first text.
STATEMENTS = {
    "cheap_parts": {
        "standard": "SELECT p_partkey, p_name FROM part WHERE p_retailprice < 1000 ORDER BY p_partkey",
        "brackets": "SELECT p_partkey, p_name FROM part WHERE `p_retailprice` < CAST(1000 AS DOUBLE) ORDER BY p_partkey",
    }
}


def statement(name: str, dialect_name: str = "standard") -> str:
    texts = STATEMENTS[name]
    return texts.get(dialect_name, texts["standard"])


def upsert(rows: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the changes of latest `order` put in place by key, or added: one pass, as an aggregate over both."""
    from pyspark.sql import functions as F

    columns = rows.columns
    both = rows.withColumn("_at", F.lit(None).cast(dict(changes.dtypes)[order])).unionByName(changes.withColumnRenamed(order, "_at"))
    last = F.max_by(F.struct(*columns), F.struct(F.col("_at").isNotNull(), "_at"))
    return both.groupBy(F.col(key).alias("_key")).agg(last.alias("r")).select("r.*")
