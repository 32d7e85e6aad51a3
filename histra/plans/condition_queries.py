"""Predicate-language queries over relations made from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histra.functions.condition_engine import bag, difference, evaluate, inputs, lineage_difference, mismatches, rows_in_result, transition_delta, uncovered
from histra.functions.condition_language import parse_query

from .dialect import read


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations customer {nation, segment, level}, nation {name, region} and kv, as row versions."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    level = F.floor(F.col("c_acctbal") / 100).cast("long")
    customers = c.select(F.format_string("customer:%d", "c_custkey").alias("key"), F.to_json(F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), level.alias("level"))).alias("value"))
    nations = n.select(F.format_string("nation:%d", "n_nationkey").alias("key"), F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("value"))
    plain = c.select(F.format_string("k%d", "c_custkey").alias("key"), level.cast("string").alias("value"))
    return customers.unionByName(nations).unionByName(plain)


FILTER = {"from": {"relation": "customer", "alias": "c"}, "where": ["c.level % 7 = 3 AND c.segment = 'BUILDING'", "c.level > 10"], "select": {"columns": ["c.k AS id", "c.level"]}}
MODULUS = {"from": {"relation": "kv"}, "where": ["value % 4 = 1"], "select": {"columns": ["k", "value"]}}
JOIN = {
    "from": {"relation": "customer", "alias": "c"},
    "joins": [{"relation": "nation", "alias": "n", "on": ["c.nation = n.id", "n.region < 2"]}],
    "where": ["c.level < 20"],
    "select": {"columns": ["n.name", "c.segment", "c.level % 5 AS rest"]},
}
DISTINCT = {**JOIN, "select": {"distinct": True, "columns": ["n.name", "c.segment"]}}
BROKEN = {"from": {"relation": "customer", "alias": "c"}, "where": ["c.level > 'a'"], "select": {"columns": ["c.k"]}}


def _result(query: dict):
    return lambda spark, sf_dir: bag(evaluate(parse_query(query), state(spark, sf_dir)))


def _inputs(query: dict):
    return lambda spark, sf_dir: inputs(evaluate(parse_query(query), state(spark, sf_dir))).select("key")


def _lineage_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(parse_query(DISTINCT), state(spark, sf_dir)).rows.select("out", F.size("lineage").cast("long").alias("versions"))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(parse_query(BROKEN), state(spark, sf_dir)).errors.select(F.col("failed").cast("long").alias("failed"))


def _transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What writing value + 1 to every third key changes in the result of MODULUS."""
    before = state(spark, sf_dir).filter("key like 'k%' and key not like '%:%'")
    number = F.substring("key", 2, 20).cast("long")
    after = before.withColumn("value", F.when(number % 3 == 0, (F.col("value").cast("long") + 1).cast("string")).otherwise(F.col("value")))
    query = parse_query(MODULUS)
    return difference(evaluate(query, before), evaluate(query, after))


def _shifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """kv before and after value + 4 for every third key, which leaves remainders by 4 as they were, and + 1 for every seventh."""
    before = state(spark, sf_dir).filter("key like 'k%' and key not like '%:%'")
    number, value = F.substring("key", 2, 20).cast("long"), F.col("value").cast("long")
    after = before.withColumn("value", (value + F.when(number % 3 == 0, 4).otherwise(0) + F.when(number % 7 == 0, 1).otherwise(0)).cast("string"))
    return before, after


def _lineage_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _shifted(spark, sf_dir)
    query = parse_query(MODULUS)
    return lineage_difference(evaluate(query, before), evaluate(query, after))


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of MODULUS recorded before the change, held against the state after it."""
    before, after = _shifted(spark, sf_dir)
    query = parse_query(MODULUS)
    then = evaluate(query, before)
    return mismatches(query, after, then.rows.select("out"), inputs(then))


def _in_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_in_result(parse_query(FILTER), state(spark, sf_dir), ["key"])


def _join_in_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_in_result(parse_query(JOIN), state(spark, sf_dir), ["key"]).groupBy("in_result").agg(F.count("*").alias("rows"))


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transition_delta(parse_query(MODULUS), *_shifted(spark, sf_dir))


#: A condition on one side first, then the equality: planned as a filter and an equi-join.
LATE_EQUALITY = {**JOIN, "joins": [{"relation": "nation", "alias": "n", "on": ["n.region < 2", "c.level < 15", "n.id = c.nation"]}]}

QUERIES = {
    "q2_join_after_filters": _result(LATE_EQUALITY),
    "q9_lineage_difference": _lineage_change,
    "q10_recorded_mismatches": _recorded,
    "q12_out_of_scope": lambda spark, sf_dir: uncovered(parse_query(JOIN), state(spark, sf_dir), state(spark, sf_dir).select("key")),
    "q24_rows_in_result": _in_result,
    "q24_rows_in_join": _join_in_result,
    "q25_transition_delta": _delta,
    "q4_filter": _result(FILTER),
    "q18_floor_mod": _result(MODULUS),
    "q2_join": _result(JOIN),
    "q6_distinct": _result(DISTINCT),
    "q6_distinct_lineage": _lineage_sizes,
    "q7_provenance": _inputs(JOIN),
    "q11_transition": _transition,
    "q17_comparison_error": _errors,
}

_STATE = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS nation, c_mktsegment AS segment, floor(c_acctbal / 100)::BIGINT AS level FROM customer),
n AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation),
j AS (SELECT c.*, n.name FROM c JOIN n ON nation = id WHERE region < 2 AND level < 20),
mod4 AS (SELECT k, level AS value FROM c WHERE ((level % 4) + 4) % 4 = 1)
"""

_SHIFT = _STATE.rstrip() + """,
b AS (SELECT k, level AS value FROM c), a AS (SELECT k, level + CASE WHEN k % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS value FROM c),
bi AS (SELECT * FROM b WHERE ((value % 4) + 4) % 4 = 1), ai AS (SELECT * FROM a WHERE ((value % 4) + 4) % 4 = 1),
was AS (SELECT * FROM bi EXCEPT SELECT * FROM ai), now AS (SELECT * FROM ai EXCEPT SELECT * FROM bi)
"""

ORACLES = {
    "q2_join_after_filters": _STATE + """SELECT '{"name":"' || name || '","rest":' || ((level % 5) + 5) % 5 || ',"segment":"' || segment || '"}' AS out, count(*) AS n FROM j WHERE level < 15 GROUP BY ALL""",
    "q9_lineage_difference": _SHIFT + "SELECT 'k' || k AS key, value::VARCHAR AS value, 'a' AS side FROM was UNION ALL SELECT 'k' || k, value::VARCHAR, 'b' FROM now",
    "q10_recorded_mismatches": _SHIFT
    + """SELECT 'value' AS what, '{"k":"k' || k || '","value":' || value || '}' AS item, 'recorded' AS side FROM was UNION ALL SELECT 'value', '{"k":"k' || k || '","value":' || value || '}', 'evaluated' FROM now
UNION ALL SELECT 'input', 'k' || k || '=' || value, 'recorded' FROM was UNION ALL SELECT 'input', 'k' || k || '=' || value, 'evaluated' FROM now""",
    "q12_out_of_scope": "SELECT 'k' || c_custkey AS key FROM customer",
    "q24_rows_in_result": _STATE + """SELECT 'customer:' || k AS key, ((level % 7) + 7) % 7 = 3 AND segment = 'BUILDING' AND level > 10 AS in_result FROM c
UNION ALL SELECT 'nation:' || id, false FROM n UNION ALL SELECT 'k' || k, false FROM c""",
    "q24_rows_in_join": "SELECT false AS in_result, (SELECT 2 * count(*) FROM customer) + (SELECT count(*) FROM nation) AS rows",
    "q25_transition_delta": _SHIFT + """SELECT 'k' || b.k AS key, ((b.value % 4) + 4) % 4 = 1 AS was_in, ((a.value % 4) + 4) % 4 = 1 AS is_in FROM b JOIN a USING (k)
WHERE was_in <> is_in OR (was_in AND a.value <> b.value)""",
    "q4_filter": _STATE + """SELECT '{"id":"' || k || '","level":' || level || '}' AS out, count(*) AS n FROM c WHERE ((level % 7) + 7) % 7 = 3 AND segment = 'BUILDING' AND level > 10 GROUP BY ALL""",
    "q18_floor_mod": _STATE + """SELECT '{"k":"k' || k || '","value":' || value || '}' AS out, count(*) AS n FROM mod4 GROUP BY ALL""",
    "q2_join": _STATE + """SELECT '{"name":"' || name || '","rest":' || ((level % 5) + 5) % 5 || ',"segment":"' || segment || '"}' AS out, count(*) AS n FROM j GROUP BY ALL""",
    "q6_distinct": _STATE + """SELECT DISTINCT '{"name":"' || name || '","segment":"' || segment || '"}' AS out, 1::BIGINT AS n FROM j""",
    "q6_distinct_lineage": _STATE + """SELECT '{"name":"' || name || '","segment":"' || segment || '"}' AS out, count(DISTINCT k) + 1 AS versions FROM j GROUP BY ALL""",
    "q7_provenance": _STATE + """SELECT 'customer:' || k AS key FROM j UNION SELECT 'nation:' || nation FROM j""",
    "q11_transition": _STATE
    + """, m AS (SELECT k, level + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS value FROM c),
a AS (SELECT '{"k":"k' || k || '","value":' || value || '}' AS out FROM mod4), b AS (SELECT '{"k":"k' || k || '","value":' || value || '}' AS out FROM m WHERE ((value % 4) + 4) % 4 = 1)
SELECT out, 1::BIGINT AS n_a, 0::BIGINT AS n_b FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT out, 0, 1 FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "q17_comparison_error": "SELECT 1::BIGINT AS failed",
}
