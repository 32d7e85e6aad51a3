"""Queries over captured changes, converted traces and recorded histories that are written and read back, and the same in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histra.operators import capture, solve, suites, traces, validate
from histra.operators.history import EVENTS_SQL, History, from_events
from histra.sources import histories

from . import transactional
from .dialect import read

KEYS, MODULUS = 20, 4
#: One history of all users: transactions and keys are told apart by the history they come from.
SPREAD = 1_000_000


def _ops(make):
    return lambda spark, sf_dir: make(capture.captured_events(read(spark, sf_dir, "events"), KEYS))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(capture.object_key("customer", id="c_custkey").alias("key"), capture.primary_key("c_custkey").alias("pk"), F.round(F.col("c_acctbal") * 100).cast("long").alias("value"))


def _initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return capture.initial_snapshot(s, capture.object_key("supplier", n="s_nationkey", id="s_suppkey"), capture.primary_key("s_nationkey", "s_suppkey"), F.col("s_suppkey"))


def _stock_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("item"), capture.object_key("order_line", o="l_orderkey", n="l_linenumber").alias("line_key"))
    stock = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), capture.object_key("stock", i="p_partkey").alias("stock_key"), F.col("p_size").alias("quantity"))
    return capture.stock_level(lines, stock, ["l_suppkey"], 10).select("l_suppkey", F.array_join("result", ",").alias("items"), "n_versions")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.export(_initial(spark, sf_dir), capture.captured_events(read(spark, sf_dir, "events"), KEYS))


def _order_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, lit = read(spark, sf_dir, "orders"), F.lit
    query = capture.stock_level_query(F.col("o_custkey") % 10, F.col("o_orderkey") % 10, F.col("o_orderkey") - 20, F.col("o_orderkey"), lit(15))
    row = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    before = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") - 1)
    return o.select("o_orderkey", query.alias("query"), capture.written_row(capture.object_key("order", w="o_custkey", o="o_orderkey"), F.col("o_orderkey"), before, row).alias("write"))


def derived_trace(events: DataFrame) -> DataFrame:
    """A trace as a table: a transaction for each user and day; reads of a missing row are marked, reads by condition have all five
    kinds of conditions and one version each. A first version for each even row number."""
    ops = capture.captured_events(events, KEYS)
    n = F.col("event_id")
    kind = F.get(F.array(*[F.lit(k) for k in ("true", "eq", "mod", "gt", "lt")]), (n % 5).cast("int"))
    condition = F.struct(kind.alias("kind"), (n % 100).alias("value"), F.lit(7).cast("long").alias("modulus"), (n % 7).alias("target"))
    key, number = F.concat(F.lit("kv:"), F.col("id").cast("string")), F.col("id").cast("string")
    absent = (F.col("kind") == "r") & (F.col("id") % 2 == 1) & (n % 11 == 0)
    value = F.when(absent, F.lit(capture.ABSENT) - F.col("id")).otherwise(n)
    asked = F.col("kind") == "pr"
    version = lambda k: F.when(asked, F.array(F.struct(k.alias("key"), n.alias("value"))))
    op = F.struct(
        F.col("op_index").cast("int").alias("op_index"), F.col("kind").alias("type"), F.when(~asked, key).alias("key"), F.when(~asked, value).alias("value"), absent.alias("absent"),
        F.when(asked, condition).alias("predicate"), version(number).alias("results"), version(key).alias("read_versions"),
    )
    day = F.substring("day", 9, 2).cast("long")
    txns = ops.groupBy(F.col("user_id").alias("session"), day.alias("session_seq")).agg(F.collect_list(op).alias("ops"))
    none = lambda t: F.lit(None).cast(t)
    rows = txns.select(F.lit("txn").alias("record_type"), none("string").alias("key"), none("bigint").alias("value"), (F.col("session") * 100 + F.col("session_seq")).alias("txn"), "session", "session_seq", F.lit("commit").alias("status"), none("string").alias("error"), "ops")
    first = events.sparkSession.range(0, KEYS, 2).select(
        F.lit("initial").alias("record_type"), F.concat(F.lit("kv:"), F.col("id").cast("string")).alias("key"), F.col("id").alias("value"), none("bigint").alias("txn"), none("bigint").alias("session"), none("bigint").alias("session_seq"), none("string").alias("status"), none("string").alias("error"), none(f"array<{traces.OP}>").alias("ops")
    )
    return rows.unionByName(first)


def _trace(make):
    return lambda spark, sf_dir: make(derived_trace(read(spark, sf_dir, "events")))


def _conditions(t: DataFrame) -> DataFrame:
    ops = t.select("txn", F.explode("ops").alias("o")).filter("o.type = 'pr'")
    return ops.select("txn", F.col("o.op_index").cast("long").alias("op_index"), traces.predicate_text(F.col("o.predicate")).alias("condition"))


def _case_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace is converted, written, read again and held against itself."""
    t = derived_trace(read(spark, sf_dir, "events"))
    path = histories.scratch_folder(spark, "case")
    histories.write_history(traces.convert(t), traces.initial_state(t), path, "derived")
    manifest = json.loads(spark.read.text(f"{path}/{histories.MANIFEST_FILE}").first()[0])
    absent = F.col("value").cast("long") <= capture.ABSENT
    return suites.audit(t, histories.read_transactions(spark, path), histories.read_initial(spark, path).withColumn("absent", absent), manifest["format"])


def _one_history(h: History) -> History:
    key, txn = F.concat(F.lit("kv:"), F.col("history_id").cast("string"), F.lit("-"), F.substring_index("key", ":", -1)), F.col("history_id") * SPREAD + F.col("txn")
    moved = lambda df, with_key=True, with_txn=True: (
        df.withColumns({**({"key": key} if with_key else {}), **({"txn": txn} if with_txn else {})}).withColumn("history_id", F.lit(0).cast("long"))
    )
    return History(moved(h.txns, False), moved(h.ops), moved(h.pred_reads, False), moved(h.pred_inputs), moved(h.initial, with_txn=False))


def _recorded(make, integers_only: bool = False):
    """The derived histories as one recorded case, written and read again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines, initial = solve.recorded_lines(_one_history(from_events(read(spark, sf_dir, "events"))))
        path = histories.scratch_folder(spark, "history")
        histories.write_history(lines.withColumnRenamed("text", "ops"), initial, path, "derived")
        return make(spark, path, histories.read_transactions(spark, path, integers_only)).drop("case")

    return run


def _verdicts(level: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines, initial = solve.recorded_lines(from_events(read(spark, sf_dir, "events")))
        return solve.recorded_verdicts(solve.parsed(lines), initial, level, 2000).select(F.col("case").cast("long").alias("history_id"), "verdict")

    return run


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived history as a case of a catalog; those of single events are expected to be accepted, the others' verdicts of the
    search over remainders are."""
    h = from_events(read(spark, sf_dir, "events"))
    lines, initial = solve.recorded_lines(h)
    found = solve.verdicts(h, "SER", 2000)
    expected = found.select(F.col("history_id").cast("string").alias("case"), F.when(F.col("history_id") % 3 == 0, "ACCEPT").otherwise(F.col("verdict")).alias("expected_verdict"))
    return suites.catalog_summary(suites.run_catalog(solve.parsed(lines), initial, expected, "SER", 2000)).select("total_cases", "matched_expected", "mismatched_or_failed", "timed_out", "all_matched")


def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of all kinds over the parts as versions (key "stock:<size>:<id>", value size)."""
    p = read(spark, sf_dir, "part").select(F.concat_ws(":", F.lit("stock"), F.col("p_brand"), F.col("p_partkey")).alias("key"), F.col("p_size").cast("long").alias("value"), "p_partkey")
    comparator = F.get(F.array(*[F.lit(c) for c in suites.COMPARATORS]), (F.col("p_partkey") % 5).cast("int"))
    kind = F.get(F.array(*[F.lit(k) for k in ("inventory_threshold", "order_filter", "search_ranked_docs")]), (F.col("p_partkey") % 3).cast("int"))
    number = lambda n: F.lit(n).cast("long")
    allowed = F.when(F.col("p_partkey") % 2 == 0, F.array(*[number(n) for n in (1, 5, 20, 25, 30)])).otherwise(F.array().cast("array<bigint>"))
    c = F.struct(kind.alias("kind"), F.lit("stock:Brand#1").alias("key_prefix"), comparator.alias("comparator"), number(25).alias("threshold"), allowed.alias("allowed"), number(40).alias("min_score"))
    return p.select("p_partkey", suites.suite_condition(c, F.col("key"), F.col("value")).alias("matches"))


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared edges, a third of them wrong in some way, against the derived histories."""
    h = from_events(read(spark, sf_dir, "events"))
    case = F.col("history_id").cast("string").alias("case")
    ref = lambda txn, at: F.struct(txn.cast("long").alias("txn"), at.cast("long").alias("op_index"))
    none = F.lit(None).cast("struct<txn: bigint, op_index: bigint>")
    n = F.col("value")
    reads = h.ops.filter("type = 'r'").select(
        case, F.col("value").alias("n"), F.when(n % 5 == 0, "WW").otherwise("RW").alias("type"), F.when(n % 7 == 0, F.lit(-7)).otherwise(F.col("txn")).cast("long").alias("src"), F.col("txn").alias("dst"), F.when(n % 11 == 0, "kv:none").otherwise(F.col("key")).alias("key"),
        ref(F.col("txn"), F.col("op_index")).alias("read_op"), F.when(n % 13 == 0, ref(F.col("txn"), F.col("op_index"))).otherwise(none).alias("write_op"), none.alias("condition_op"),
    )
    asked = h.pred_reads.select(case, (F.col("txn") * 1000 + F.col("op_index")).alias("n"), F.lit("PR_RW").alias("type"), F.col("txn").alias("src"), F.col("txn").alias("dst"), F.lit("kv:1").alias("key"), none.alias("read_op"), none.alias("write_op"), ref(F.col("txn"), F.col("op_index") + F.when(F.col("txn") % 4 == 0, 1000).otherwise(0)).alias("condition_op"))
    kinds = h.ops.select(case, "txn", "op_index", "type", "key").unionByName(h.pred_reads.select(case, "txn", "op_index", F.lit("pr").alias("type"), F.lit(None).cast("string").alias("key")))
    return suites.conflict_faults(reads.unionByName(asked), h.txns.select(case, "txn"), kinds)


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.round(F.col("c_acctbal") * 100).cast("long").alias("v"))
    # Some keys are new: those of orders whose key is above all customers'.
    changes = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 9 == 0, -F.col("o_orderkey")).otherwise(F.col("o_custkey")).alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderkey").alias("at"))
    return transactional.upsert(rows, changes, "k", "at")


def _dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import dialect

    return dialect.run(spark, sf_dir, transactional.statement("cheap_parts", "brackets"))


QUERIES = {
    "x1_object_keys": _keys,
    "x2_operation_numbers": _ops(lambda ops: ops.select(F.col("user_id").alias("session"), "day", "op_index", "kind", "event_id")),
    "x3_written_versions": _ops(capture.written_versions),
    "x3_latest_versions": _ops(capture.latest_versions),
    "x4_point_reads": _ops(capture.point_reads),
    "x4_condition_reads": _ops(lambda ops: capture.condition_reads(ops, KEYS, MODULUS)),
    "x5_initial_snapshot": _initial,
    "x6_stock_level": _stock_level,
    "x7_export": _exported,
    "x8_conditions": _trace(_conditions),
    "x9_x10_converted": _trace(lambda t: traces.convert(t).select("session", "txn", "ops")),
    "x11_initial_state": _trace(traces.initial_state),
    "x12_counts": _trace(traces.counts),
    "x13_order_entry": _order_entry,
    "v13_case_audit": _case_audit,
    "v15_suite_conditions": _suite,
    "v16_conflict_faults": _conflicts,
    "s1_recorded_transactions": _recorded(lambda spark, path, lines: histories.transactions(lines).select("case", "session", F.col("so_pos").cast("long").alias("so_pos"), "txn")),
    "s2_recorded_initial": _recorded(lambda spark, path, lines: histories.read_initial(spark, path).drop("absent")),
    "s4_recorded_operations": _recorded(lambda spark, path, lines: histories.operations(lines).select("case", "txn", F.col("op_index").cast("long").alias("op_index"), "type", "key", "value")),
    "s5_recorded_inputs": _recorded(lambda spark, path, lines: histories.predicate_inputs(lines).withColumn("op_index", F.col("op_index").cast("long"))),
    "s7_strict_conditions": _recorded(lambda spark, path, lines: histories.moduli(lines).withColumn("op_index", F.col("op_index").cast("long")), True),
    "s16_text_dump": _recorded(lambda spark, path, lines: histories.text_dump(lines).withColumn("so_pos", F.col("so_pos").cast("long"))),
    "v12_session_sequence": _recorded(lambda spark, path, lines: validate.session_sequence_violations(lines.withColumn("session_seq", F.coalesce("session_seq", F.lit(0))))),
    "g21_recorded_verdicts": _verdicts("SER"),
    "g23_recorded_verdicts": _verdicts("SI"),
    "g29_catalog": _catalog,
    "t4_upsert": _upsert,
    "t8_dialect": _dialect,
}

_C = f"""WITH c AS (SELECT user_id, substr(ts::VARCHAR, 1, 10) AS day, ts, event_id, event_id % {KEYS} AS id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'w' WHEN event_type IN ('view', 'click') THEN 'r' ELSE 'pr' END AS kind,
  (row_number() OVER (PARTITION BY user_id, substr(ts::VARCHAR, 1, 10) ORDER BY ts, event_id) - 1)::BIGINT AS op_index FROM events)
"""
_SEEN = f", l AS (SELECT * FROM c WHERE kind <> 'pr'), v AS (SELECT *, last_value(CASE WHEN kind = 'w' THEN event_id END IGNORE NULLS) OVER (PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM l)\n"
_KIND = "['true', 'eq', 'mod', 'gt', 'lt'][(event_id % 5) + 1]"
_COND = f"CASE {_KIND} WHEN 'true' THEN 'TRUE' WHEN 'eq' THEN 'value = ' || (event_id % 100) WHEN 'mod' THEN 'value % 7 = ' || (event_id % 7) WHEN 'gt' THEN 'value > ' || (event_id % 100) ELSE 'value < ' || (event_id % 100) END"
_T = _C.rstrip() + f""", t AS (SELECT *, user_id * 100 + substr(day, 9, 2)::BIGINT AS txn, kind = 'r' AND id % 2 = 1 AND event_id % 11 = 0 AS absent,
  CASE WHEN kind = 'r' AND id % 2 = 1 AND event_id % 11 = 0 THEN {capture.ABSENT} - id ELSE event_id END AS value, {_COND} AS cond FROM c)
"""
_H = "WITH " + EVENTS_SQL + "\n"
_KEY = "'kv:' || history_id || '-' || split_part(key, ':', 2)"
_QUERY = """'{"from":{"relation":"kv"},"where":["value % ' || modulus || ' = ' || residue || '"],"select":{"columns":["canonical_key AS key","value"]}}'"""
_STOCK = "concat('{\"select\":{\"distinct\":true,\"columns\":[\"s.s_i_id\"]},\"from\":{\"relation\":\"order_line\",\"alias\":\"ol\"},\"joins\":[{\"type\":\"INNER\",\"relation\":\"stock\",\"alias\":\"s\",\"on\":[\"ol.ol_w_id = s.s_w_id\",\"ol.ol_i_id = s.s_i_id\"]}],\"where\":[\"ol.ol_w_id = ', o_custkey % 10, '\",\"ol.ol_d_id = ', o_orderkey % 10, '\",\"ol.ol_o_id >= ', o_orderkey - 20, '\",\"ol.ol_o_id < ', o_orderkey, '\",\"s.s_quantity < 15\"]}')"

ORACLES = {
    "x1_object_keys": """SELECT 'customer:id=' || c_custkey AS key, '{"c_custkey":' || c_custkey || '}' AS pk, round(c_acctbal * 100)::BIGINT AS value FROM customer""",
    "x2_operation_numbers": _C + "SELECT user_id AS session, day, op_index, kind, event_id FROM c",
    "x3_written_versions": _C + "SELECT 'kv:id=' || id AS key, event_id AS version, lag(event_id) OVER (PARTITION BY id ORDER BY ts, event_id) AS before, user_id AS session, day, op_index FROM c WHERE kind = 'w'",
    "x3_latest_versions": _C + "SELECT 'kv:id=' || id AS key, arg_max(event_id, (ts, event_id)) AS version, count(*) AS writes FROM c WHERE kind = 'w' GROUP BY id",
    "x4_point_reads": _C + _SEEN + f"SELECT user_id AS session, day, op_index, 'kv:id=' || id AS key, coalesce(seen, {capture.ABSENT} - id) AS value, seen IS NULL AS absent FROM v WHERE kind = 'r'",
    "x4_condition_reads": _C
    + f""", l AS (SELECT user_id, day, ts, event_id, op_index, kind, k AS id FROM c, range({KEYS}) q(k) WHERE kind = 'pr' UNION ALL SELECT user_id, day, ts, event_id, op_index, kind, id FROM c WHERE kind = 'w'),
v AS (SELECT *, last_value(CASE WHEN kind = 'w' THEN event_id END IGNORE NULLS) OVER (PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM l)
SELECT user_id AS session, day, op_index, count(*) FILTER (seen % {MODULUS} = event_id % {MODULUS}) AS results, min(seen) FILTER (seen % {MODULUS} = event_id % {MODULUS}) AS least, max(seen) FILTER (seen % {MODULUS} = event_id % {MODULUS}) AS most
FROM v WHERE kind = 'pr' GROUP BY ALL""",
    "x5_initial_snapshot": """SELECT 'initial' AS record_type, 'supplier:n=' || s_nationkey || ':id=' || s_suppkey AS key, '{"s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}' AS pk, s_suppkey AS value FROM supplier""",
    "x6_stock_level": """SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS items, count(DISTINCT (l_orderkey, l_linenumber)) + count(DISTINCT l_partkey) AS n_versions
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10 GROUP BY l_suppkey""",
    "x7_export": _C
    + """SELECT 0 AS part, NULL::BIGINT AS session, NULL::VARCHAR AS day, 'supplier:n=' || s_nationkey || ':id=' || s_suppkey AS key, '{"record_type":"initial","key":"supplier:n=' || s_nationkey || ':id=' || s_suppkey || '","value":' || s_suppkey || '}' AS line FROM supplier
UNION ALL SELECT 1, user_id, day, NULL, '{"record_type":"txn","session":' || user_id || ',"day":"' || day || '","status":"commit","ops":[' || string_agg('{"op_index":' || op_index || ',"type":"' || kind || '"' || CASE WHEN kind <> 'pr' THEN ',"key":"kv:id=' || id || '"' ELSE '' END || CASE WHEN kind = 'w' THEN ',"value":' || event_id ELSE '' END || '}', ',' ORDER BY op_index) || ']}'
FROM c GROUP BY user_id, day""",
    "x8_conditions": _T + "SELECT txn, op_index, cond AS condition FROM t WHERE kind = 'pr'",
    "x9_x10_converted": _T
    + """SELECT user_id AS session, txn, '[' || string_agg(CASE WHEN kind = 'pr' THEN '{"type":"pr","query":{"from":{"relation":"kv"},"where":["' || cond || '"],"select":{"columns":["k","value"]}},"result":{"values":[{"k":"' || id || '","value":' || event_id || '}],"inputs":[{"key":"kv:' || id || '","value":' || event_id || '}]}}'
ELSE '{"type":"' || kind || '","key":"kv:' || id || '","value":' || value || '}' END, ',' ORDER BY op_index) || ']' AS ops FROM t GROUP BY user_id, txn""",
    "x11_initial_state": _T + f"SELECT 'kv:' || k AS key, k::VARCHAR AS value FROM range(0, {KEYS}, 2) q(k) UNION ALL SELECT 'kv:' || id, ({capture.ABSENT} - id)::VARCHAR FROM t WHERE absent GROUP BY id",
    "x12_counts": _T + "SELECT count(DISTINCT txn) AS transactions, 0 AS aborted, count(*) FILTER (kind = 'r') AS point_reads, count(*) FILTER (kind = 'pr') AS predicate_reads, count(*) FILTER (kind = 'w') AS writes, count(*) AS operations FROM t",
    "x13_order_entry": f"""SELECT o_orderkey, {_STOCK} AS query, '{{"type":"w","key":"order:w=' || o_custkey || ':o=' || o_orderkey || '","value":' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ',"before_value":' || (o_orderkey - 1) ELSE '' END || ',"row":{{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}}}}' AS write FROM orders""",
    "v13_case_audit": _T
    + f"""SELECT (SELECT count(DISTINCT txn) FROM t) AS raw_txns, (SELECT count(DISTINCT txn) FROM t) AS txns, {KEYS // 2} AS raw_initial, (SELECT count(DISTINCT id) FROM t WHERE absent) AS absent,
{KEYS // 2} + (SELECT count(DISTINCT id) FROM t WHERE absent) AS keys, true AS valid""",
    "v15_suite_conditions": """SELECT p_partkey, starts_with('stock:' || p_brand || ':' || p_partkey, 'stock:Brand#1') AND CASE p_partkey % 3 WHEN 2 THEN p_size >= 40
ELSE CASE p_partkey % 5 WHEN 0 THEN p_size >= 25 WHEN 1 THEN p_size > 25 WHEN 2 THEN p_size <= 25 WHEN 3 THEN p_size < 25 ELSE p_size = 25 END AND (p_partkey % 3 = 0 OR p_partkey % 2 = 1 OR p_size IN (1, 5, 20, 25, 30)) END AS matches FROM part""",
    "v16_conflict_faults": _H
    + """SELECT history_id::VARCHAR AS case, value AS n, CASE WHEN value % 7 = 0 THEN 'no such transaction' WHEN value % 5 = 0 THEN 'unsupported type' WHEN value % 11 = 0 THEN 'no such read' WHEN value % 13 = 0 THEN 'no such write' END AS fault FROM ops WHERE type = 'r' AND (value % 7 = 0 OR value % 5 = 0 OR value % 11 = 0 OR value % 13 = 0)
UNION ALL SELECT history_id::VARCHAR, txn * 1000 + op_index, 'no such condition read' FROM pred_reads WHERE txn % 4 = 0""",
    "s1_recorded_transactions": _H + f"SELECT session, so_pos, history_id * {SPREAD} + txn AS txn FROM txns",
    "s2_recorded_initial": _H + f"SELECT {_KEY} AS key, value::VARCHAR AS value FROM initial",
    "s4_recorded_operations": _H + f"SELECT history_id * {SPREAD} + txn AS txn, op_index, type, {_KEY} AS key, value::VARCHAR AS value FROM ops UNION ALL SELECT history_id * {SPREAD} + txn, op_index, 'pr', NULL, NULL FROM pred_reads",
    "s5_recorded_inputs": _H + f"SELECT history_id * {SPREAD} + txn AS txn, op_index, {_KEY} AS key, value::VARCHAR AS value FROM pred_inputs",
    "s7_strict_conditions": _H + f"SELECT history_id * {SPREAD} + txn AS txn, op_index, modulus, residue FROM pred_reads",
    "s16_text_dump": _H
    + f""", o AS (SELECT history_id, txn, op_index, upper(type) || ' ' || {_KEY} || ' ' || value AS s FROM ops UNION ALL SELECT history_id, txn, op_index, 'PR ? ' || {_QUERY} FROM pred_reads)
SELECT session, so_pos, 'txn ' || (history_id * {SPREAD} + txn) || ' [' || string_agg(s, '; ' ORDER BY op_index) || ']' AS line FROM txns JOIN o USING (history_id, txn) GROUP BY session, so_pos, history_id, txn""",
    "v12_session_sequence": _H + f"SELECT session, history_id * {SPREAD} + txn AS txn FROM txns WHERE so_pos > 0",
    "g29_catalog": _H + "SELECT count(DISTINCT history_id) AS total_cases, count(DISTINCT history_id) AS matched_expected, 0::BIGINT AS mismatched_or_failed, 0::BIGINT AS timed_out, true AS all_matched FROM txns",
    "t4_upsert": """WITH c AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN -o_orderkey ELSE o_custkey END AS k, max(o_orderkey) AS v FROM orders GROUP BY 1)
SELECT coalesce(c.k, c_custkey) AS k, coalesce(c.v, round(c_acctbal * 100)::BIGINT) AS v FROM customer FULL JOIN c ON c.k = c_custkey""",
    "t8_dialect": "SELECT p_partkey, p_name FROM part WHERE p_retailprice < 1000",
}
