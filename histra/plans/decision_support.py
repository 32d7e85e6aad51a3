"""The 22 decision-support shapes over the given star schema.

Columns that the given tables lack are replaced so that the operators stay: partsupp comes from lineitem, lateness from ship
and order date, ship mode from the return flag, containers from part sizes, phone prefixes from nation keys. Sums of doubles
are rounded, as engines add in different orders, and + 0.0 turns a negative zero positive.
"""

from __future__ import annotations

PARTSUPP = """partsupp AS (
  SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_supplycost, sum(l_quantity) AS ps_availqty
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""

QUERIES = {
    "h1_pricing_summary": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= date '2001-12-01' - INTERVAL 90 DAY
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "h2_minimum_cost_supplier": f"""
WITH {PARTSUPP},
offers AS (
  SELECT s_acctbal, s_name, n_name, p_partkey, p_brand, ps_supplycost, min(ps_supplycost) OVER (PARTITION BY p_partkey) AS least
  FROM part JOIN partsupp ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey
       JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE p_size = 15 AND p_type LIKE '%O%' AND r_name = 'EUROPE')
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand, round(ps_supplycost, 4) AS supplycost
FROM offers WHERE ps_supplycost = least ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "h3_shipping_priority": """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, cast(cast(o_orderdate AS date) AS varchar(10)) AS orderdate
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < date '1998-03-15' AND l_shipdate > date '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, orderdate, l_orderkey LIMIT 10""",
    "h4_order_priority": """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= date '1996-07-01' AND o_orderdate < date '1996-07-01' + INTERVAL 3 MONTH
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY)
GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "h5_local_supplier_volume": """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
     JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= date '1996-01-01' AND o_orderdate < date '1996-01-01' + INTERVAL 1 YEAR
GROUP BY n_name ORDER BY revenue DESC, n_name""",
    "h6_revenue_change": """
SELECT round(sum(l_extendedprice * l_discount), 2) + 0.0 AS revenue FROM lineitem
WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1996-01-01' + INTERVAL 1 YEAR AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "h7_volume_shipping": """
WITH shipping AS (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, cast(year(l_shipdate) AS bigint) AS l_year, l_extendedprice * (1 - l_discount) AS volume
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
       JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
  WHERE ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
    AND l_shipdate BETWEEN date '1995-01-01' AND date '1999-12-31')
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "h8_market_share": """
WITH all_nations AS (
  SELECT cast(year(o_orderdate) AS bigint) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation_name
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
       JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
       JOIN nation n2 ON s_nationkey = n2.n_nationkey
  WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND o_orderdate BETWEEN date '1995-01-01' AND date '1996-12-31')
SELECT o_year, round(sum(CASE WHEN nation_name = 'NATION_1' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share
FROM all_nations GROUP BY o_year ORDER BY o_year""",
    "h9_product_profit": f"""
WITH {PARTSUPP},
profit AS (
  SELECT n_name AS nation_name, cast(year(o_orderdate) AS bigint) AS o_year, l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity AS amount
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
       JOIN partsupp ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = s_nationkey
  WHERE p_name LIKE '%red%')
SELECT nation_name, o_year, round(sum(amount), 1) AS sum_profit FROM profit GROUP BY nation_name, o_year ORDER BY nation_name, o_year DESC""",
    "h10_returned_items": """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderdate >= date '1996-10-01' AND o_orderdate < date '1996-10-01' + INTERVAL 3 MONTH AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "h11_important_stock": f"""
WITH {PARTSUPP},
held AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS value FROM partsupp JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_7')
SELECT ps_partkey, round(sum(value), 2) AS stock_value FROM held GROUP BY ps_partkey
HAVING sum(value) > (SELECT sum(value) * 0.001 FROM held) ORDER BY stock_value DESC, ps_partkey""",
    "h12_shipping_modes": """
SELECT l_returnflag, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high_line_count,
       sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate + INTERVAL 60 DAY AND l_shipdate >= date '1997-01-01' AND l_shipdate < date '1998-01-01'
GROUP BY l_returnflag ORDER BY l_returnflag""",
    "h13_customer_distribution": """
WITH per_customer AS (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '1-%' GROUP BY c_custkey)
SELECT c_count, count(*) AS custdist FROM per_customer GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "h14_promotion_effect": """
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= date '1996-09-01' AND l_shipdate < date '1996-09-01' + INTERVAL 1 MONTH""",
    "h15_top_supplier": """
WITH revenue AS (
  SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem
  WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1996-01-01' + INTERVAL 3 MONTH GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    "h16_parts_suppliers": f"""
WITH {PARTSUPP}
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#15' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (9, 14, 19, 23, 36, 45, 49, 3)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "h17_small_quantity": """
WITH usual AS (SELECT l_partkey AS k, 0.2 * avg(l_quantity) AS low FROM lineitem GROUP BY l_partkey)
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey JOIN usual ON k = l_partkey
WHERE p_brand = 'Brand#23' AND p_size BETWEEN 1 AND 40 AND l_quantity < low""",
    "h18_large_orders": """
WITH big AS (SELECT l_orderkey AS k FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 300)
SELECT c_name, c_custkey, o_orderkey, cast(cast(o_orderdate AS date) AS varchar(10)) AS orderdate, o_totalprice, round(sum(l_quantity), 2) AS quantity
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderkey IN (SELECT k FROM big)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, orderdate, o_orderkey LIMIT 100""",
    "h19_discounted_revenue": """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_returnflag IN ('A', 'R')
  AND ((p_brand = 'Brand#12' AND p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 21)
    OR (p_brand = 'Brand#23' AND p_size BETWEEN 1 AND 30 AND l_quantity BETWEEN 10 AND 40)
    OR (p_brand = 'Brand#7' AND p_size BETWEEN 1 AND 45 AND l_quantity BETWEEN 20 AND 50))""",
    "h20_promotion_candidates": f"""
WITH {PARTSUPP},
sold AS (SELECT l_partkey AS k, l_suppkey AS s, 0.5 * sum(l_quantity) AS half FROM lineitem WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1998-01-01' GROUP BY l_partkey, l_suppkey)
SELECT s_name, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey
WHERE n_name = 'NATION_3' AND s_suppkey IN (
  SELECT ps_suppkey FROM partsupp JOIN sold ON ps_partkey = k AND ps_suppkey = s
  WHERE ps_availqty > half AND ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%'))
ORDER BY s_name""",
    "h21_waiting_suppliers": """
WITH late AS (SELECT l_orderkey AS k, l_suppkey AS s, max(CASE WHEN l_shipdate > o_orderdate + INTERVAL 60 DAY THEN 1 ELSE 0 END) AS is_late
              FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY l_orderkey, l_suppkey)
SELECT s_name, count(*) AS numwait FROM late a JOIN supplier ON s_suppkey = a.s JOIN nation ON n_nationkey = s_nationkey
WHERE a.is_late = 1 AND n_name = 'NATION_4' AND EXISTS (SELECT 1 FROM late b WHERE b.k = a.k AND b.s <> a.s)
  AND NOT EXISTS (SELECT 1 FROM late c WHERE c.k = a.k AND c.s <> a.s AND c.is_late = 1)
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "h22_sales_opportunity": """
WITH rich AS (SELECT avg(c_acctbal) AS usual FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (3, 7, 11, 13, 17, 18, 23))
SELECT substring(c_name, 1, 8) AS prefix, c_nationkey AS country, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal
FROM customer WHERE c_nationkey IN (3, 7, 11, 13, 17, 18, 23) AND c_acctbal > (SELECT usual FROM rich)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
GROUP BY substring(c_name, 1, 8), c_nationkey ORDER BY country""",
}
