from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from histra.functions import clauses
from histra.operators import generate, solve, statistics, suites, traces
from histra.sources import histories
from histra.streaming import ingest

TRACE = [
    {"record_type": "initial", "key": "kv:1", "value": 10},
    {"record_type": "txn", "txn": 2, "session": 1, "session_seq": 2, "status": "commit", "ops": [{"op_index": 1, "type": "w", "key": "kv:1", "value": 11}, {"op_index": 0, "type": "r", "key": "kv:1", "value": 10}]},
    {"record_type": "txn", "txn": 1, "session": 1, "session_seq": 1, "status": "commit", "ops": [{"op_index": 0, "type": "pr", "predicate": {"kind": "mod", "modulus": 5, "target": 0}, "results": [{"key": "1", "value": 10}], "read_versions": [{"key": "kv:1", "value": 10}]}, {"op_index": 1, "type": "r", "key": "kv:7", "value": -1000000000007, "absent": True}]},
    {"record_type": "abort", "txn": 3, "session": 2, "session_seq": 1, "status": "abort", "error": "x"},
]


@pytest.fixture
def trace(spark, tmp_path):
    (tmp_path / "trace.jsonl").write_text("\n".join(json.dumps(r) for r in TRACE))
    return traces.read_trace(spark, f"{tmp_path}/trace.jsonl")


def test_trace_to_history_and_back(spark, trace, tmp_path):
    histories.write_history(traces.convert(trace), traces.initial_state(trace), f"{tmp_path}/h", "t")
    lines = histories.read_transactions(spark, f"{tmp_path}/h")
    assert [(r.session, r.so_pos, r.txn) for r in histories.transactions(lines).orderBy("so_pos").collect()] == [(1, 0, 1), (1, 1, 2)]
    ops = [(r.txn, r.op_index, r.type, r.key, r.value) for r in histories.operations(lines).orderBy("txn", "op_index").collect()]
    assert ops == [(1, 0, "pr", None, None), (1, 1, "r", "kv:7", "-1000000000007"), (2, 0, "r", "kv:1", "10"), (2, 1, "w", "kv:1", "11")]
    assert json.loads(histories.operations(lines).filter("type = 'pr'").first().query)["where"] == ["value % 5 = 0"]
    assert [tuple(r) for r in histories.predicate_inputs(lines).collect()] == [("h", 1, 0, "kv:1", "10")]
    assert json.loads(histories.predicate_values(lines).first().value) == {"k": "1", "value": 10}
    assert {(r.key, r.value) for r in histories.read_initial(spark, f"{tmp_path}/h").collect()} == {("kv:1", "10"), ("kv:7", "-1000000000007")}
    assert tuple(traces.counts(trace).first()) == (2, 1, 2, 1, 1, 4)
    assert json.loads((tmp_path / "h" / "manifest.json").read_text())["transactions"] == 2


def write_lines(folder, *rows, initial=(("kv:1", 1),), **manifest):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / histories.HISTORY_FILE).write_text("\n\n".join(json.dumps(r) for r in rows))
    (folder / histories.INITIAL_FILE).write_text(json.dumps([{"key": k, "value": v} for k, v in initial]))
    (folder / histories.MANIFEST_FILE).write_text(json.dumps({"format": histories.FORMAT, **manifest}))


def txn(n, session, *ops):
    return {"session": session, "txn": n, "status": "commit", "ops": list(ops)}


def w(key, value):
    return {"type": "w", "key": key, "value": value}


def r(key, value):
    return {"type": "r", "key": key, "value": value}


def pr(query, values, inputs):
    return {"type": "pr", "query": query, "result": {"values": values, "inputs": [{"key": k, "value": v} for k, v in inputs.items()]}}


MODULUS = {"from": {"relation": "kv"}, "where": ["value % 2 = 1"], "select": {"columns": ["k", "value"]}}
BAD_OPERATIONS = [
    {**w("a", 1), "write_id": 3},
    {"type": "w", "value": 1},
    {"type": "x", "key": "a", "value": 1},
    w("a", 1.5),
    w("a", None),
    w("a", [1]),
    {"type": "pr", "result": {"values": [], "inputs": []}},
    {"type": "pr", "query": MODULUS},
    {"type": "pr", "predicate": {"kind": "true"}, "results": []},
    {"type": "pr", "query": MODULUS, "result": {"values": [], "inputs": [{"key": "a", "value": 1}, {"key": "a", "value": 1}]}},
    {"type": "pr", "query": MODULUS, "result": {"values": [], "inputs": [{"key": "a", "value": 1, "source_txn": 1}]}},
]


def test_bad_histories(spark, tmp_path):
    write_lines(tmp_path / "good", txn(1, 1, w("a", 1), w("b", {"write_id": 4}), r("a", "x"), pr(MODULUS, [], {})))
    assert histories.operations(histories.read_transactions(spark, f"{tmp_path}/good")).count() == 4
    with pytest.raises(Exception, match="can't be stored"):
        histories.operations(histories.read_transactions(spark, f"{tmp_path}/good", integers_only=True)).collect()
    for k, rows in enumerate([[{**txn(1, 1), "status": "abort"}], [txn(1, 1), txn(1, 2)], *[[txn(1, 1, o)] for o in BAD_OPERATIONS]]):
        write_lines(tmp_path / f"bad{k}", *rows)
        with pytest.raises(Exception, match="InvalidHistory"):
            histories.transactions(histories.read_transactions(spark, f"{tmp_path}/bad{k}")).collect()


def test_strict_conditions(spark, tmp_path):
    write_lines(tmp_path / "h", txn(1, 1, pr(MODULUS, [], {})), txn(2, 1, pr({**MODULUS, "where": ["value > 3"]}, [], {})))
    lines = histories.read_transactions(spark, f"{tmp_path}/h")
    assert [tuple(x) for x in histories.moduli(lines.filter("txn = 1")).collect()] == [("h", 1, 0, 2, 1)]
    with pytest.raises(Exception, match="InvalidHistory"):
        histories.moduli(lines).collect()


def test_many_splits_keep_the_order_of_lines(spark, tmp_path):
    write_lines(tmp_path / "h", *[txn(n, n % 3, w(f"kv:{n}", n)) for n in range(2000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = histories.read_transactions(spark, f"{tmp_path}/h")
        assert lines.rdd.getNumPartitions() > 8
        order = histories.transactions(lines).orderBy("session", "so_pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [x.txn for x in order] == [n for s in range(3) for n in range(s, 2000, 3)]


JOIN = {"from": {"relation": "a", "alias": "x"}, "joins": [{"relation": "b", "alias": "y", "on": ["x.group = y.group"]}], "where": ["x.n > 0"], "select": {"distinct": True, "columns": ["y.name"]}}


def catalog(tmp_path):
    start = (("a:1", {"group": 1, "n": 0}), ("b:1", {"group": 1, "name": "one"}))
    on, off = {"group": 1, "n": 5}, {"group": 1, "n": -5}
    seen = pr(JOIN, [{"name": "one"}], {"a:1": on, "b:1": {"group": 1, "name": "one"}})
    none = pr(JOIN, [], {})
    # The join sees the write of transaction 1; of transaction 2 it may be before or after.
    write_lines(tmp_path / "joined", txn(1, 1, w("a:1", on)), txn(2, 2, w("a:1", off)), txn(3, 3, seen), initial=start, expected_verdict="ACCEPT")
    # One session reads the join after the write, then without it, although nobody took it back.
    write_lines(tmp_path / "lost", txn(1, 1, w("a:1", on)), txn(2, 2, seen), txn(3, 2, none), initial=start, expected_verdict="REJECT")
    write_lines(tmp_path / "never", txn(1, 1, pr(JOIN, [{"name": "two"}], {})), initial=start, expected_verdict="REJECT")
    # Write skew by conditions: both see no odd value, both write one.
    skew = [txn(1, 1, pr(MODULUS, [], {}), w("kv:1", 3)), txn(2, 2, pr(MODULUS, [], {}), w("kv:2", 5))]
    write_lines(tmp_path / "skew", *skew, initial=(("kv:1", 0), ("kv:2", 2)), expected_verdict="REJECT")
    write_lines(tmp_path / "wide", txn(1, 1, pr({**MODULUS, "where": ["value >= 1"]}, [{"k": "1", "value": 1}], {"kv:1": 1})), expected_verdict="REJECT")


def test_catalog_on_disk(spark, tmp_path):
    catalog(tmp_path)
    lines, initial, expected = suites.read_catalog(spark, str(tmp_path))
    results = suites.run_catalog(lines.filter("case <> 'wide'"), initial.filter("case <> 'wide'"), expected.filter("case <> 'wide'"))
    assert {x.case: x.actual_verdict for x in results.collect()} == {"joined": "ACCEPT", "lost": "REJECT", "never": "REJECT", "skew": "REJECT"}
    summary = suites.catalog_summary(results).first()
    assert (summary.total_cases, summary.matched_expected, summary.all_matched, summary.reject) == (4, 4, True, 3)
    suites.write_results(results, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/results.jsonl").count() == spark.read.option("header", True).csv(f"{tmp_path}/out/results.csv").count() == 4
    # Snapshot isolation allows the skew.
    found = {x.case: x.verdict for x in solve.recorded_verdicts(lines.filter("case in ('skew', 'lost')"), initial, "SI").collect() if x.case in ("skew", "lost")}
    assert found == {"skew": "ACCEPT", "lost": "REJECT"}
    # A comparator of the extended language, and a search that is not allowed a step.
    wide = solve.recorded_verdicts(lines.filter("case = 'wide'"), initial.filter("case = 'wide'"), extended=True).first()
    assert wide.verdict == "ACCEPT"
    with pytest.raises(Exception, match="ConditionError"):
        solve.recorded_verdicts(lines.filter("case = 'wide'"), initial.filter("case = 'wide'")).collect()
    assert solve.recorded_verdicts(lines.filter("case = 'joined'"), initial.filter("case = 'joined'"), budget=1).first().verdict == "UNKNOWN"


def test_audit_finds_what_is_missing(spark, trace, tmp_path):
    histories.write_history(traces.convert(trace), traces.initial_state(trace), f"{tmp_path}/h", "t")
    lines, initial = histories.read_transactions(spark, f"{tmp_path}/h"), histories.read_initial(spark, f"{tmp_path}/h")
    marked = initial.withColumn("absent", F.col("value").cast("long") <= traces.ABSENT)
    assert suites.audit(trace, lines, marked, histories.FORMAT).first().valid
    assert not suites.audit(trace, lines.limit(1), marked, histories.FORMAT).first().valid
    assert not suites.audit(trace, lines, marked, "other").first().valid


def test_keys_with_quotation_marks(spark, tmp_path):
    rows = [{"record_type": "txn", "txn": 1, "session": 1, "session_seq": 1, "status": "commit", "ops": [{"op_index": 0, "type": "w", "key": 'kv:"a\\b', "value": 1}]}]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(x) for x in rows) + '\nnot json\n{"record_type": "other"}\n\n')
    bad = traces.rejected_lines(spark, f"{tmp_path}/t.jsonl").collect()
    assert [x.line for x in bad] == ["not json", '{"record_type": "other"}']
    (tmp_path / "t.jsonl").write_text(json.dumps(rows[0]))
    trace = traces.read_trace(spark, f"{tmp_path}/t.jsonl")
    histories.write_history(traces.convert(trace), traces.initial_state(trace), f"{tmp_path}/q", "t")
    assert histories.operations(histories.read_transactions(spark, f"{tmp_path}/q")).first().key == 'kv:"a\\b'


def test_result_files(spark, tmp_path):
    samples = statistics.samples_of(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    lines = statistics.result_lines(samples, 86400)
    statistics.write_csv(lines, statistics.RESULT_HEADINGS, f"{tmp_path}/r", ["time"])
    back = spark.read.option("header", True).csv(f"{tmp_path}/r")
    assert tuple(back.columns) == statistics.RESULT_HEADINGS and back.count() == lines.count()
    statistics.write_csv(statistics.sample_lines(samples, 86400), statistics.SAMPLE_HEADINGS, f"{tmp_path}/s", ["time"])
    statistics.write_csv(statistics.raw_lines(samples), statistics.RAW_HEADINGS, f"{tmp_path}/w", ["start_s"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/w").count() == samples.count()
    assert statistics.time_buckets(samples.limit(0), 60).count() == 0


def test_log_metrics_and_stages(spark):
    text = ["Sessions count: 12", "SER_PRUNE: 40ms", "x", "[[[[ REJECT ]]]]", "Transactions count: 7", "Events count:9", "lower: 3ms"]
    got = {x.name: x.value for x in statistics.log_metrics(spark.createDataFrame([(t,) for t in text], "line string")).collect()}
    assert got == {"sessions_count": "12", "time_ser_prune_ms": "40", "actual_verdict": "REJECT", "transactions_count": "7", "events_count": "9"}
    stages = statistics.Stages()
    for _ in range(2):
        stages.start("A")
        stages.end("A")
    assert stages.lines()[0].startswith("A: ") and stages.most_mb > 0


def test_suite_conditions_refuse_what_they_do_not_know(spark):
    row = lambda kind, comparator: spark.range(1).select(F.struct(F.lit(kind).alias("kind"), F.lit("a").alias("key_prefix"), F.lit(comparator).alias("comparator"), F.lit(1).cast("long").alias("threshold"), F.lit(None).cast("array<bigint>").alias("allowed"), F.lit(1).cast("long").alias("min_score")).alias("p"))
    ask = lambda df: df.select(suites.suite_condition(F.col("p"), F.lit("ab"), F.lit(1).cast("long")).alias("m")).first().m
    assert ask(row("order_filter", "ge")) is True and ask(row("inventory_threshold", "gt")) is False
    for bad in (row("other", "ge"), row("order_filter", "ne")):
        with pytest.raises(Exception, match="unsupported"):
            ask(bad)


def test_generated_rows(spark):
    lines = generate.lineitems(spark, 3000, 500, 40).cache()
    again = generate.lineitems(spark, 3000, 500, 40).repartition(5)
    assert lines.exceptAll(again).isEmpty()
    x = lines.agg(F.countDistinct("l_orderkey").alias("o"), F.avg("l_linenumber").alias("n"), F.avg("l_quantity").alias("q"), F.min("l_discount").alias("d0"), F.max("l_discount").alias("d1"), F.max("l_partkey").alias("p")).first()
    assert x.o == 3000 and abs(x.n - 3) < 0.5 and abs(x.q - 25.5) < 0.7 and (x.d0, x.d1) == (0.0, 0.1) and x.p <= 500
    owners = generate.orders(spark, 20_000, 300).select("o_custkey").distinct()
    assert owners.filter("o_custkey % 3 = 0").isEmpty() and owners.count() == 200
    c = generate.customers(spark, 5000).agg(F.countDistinct("c_nationkey").alias("n"), F.min("c_acctbal").alias("a"), F.max("c_acctbal").alias("b")).first()
    assert c.n == 25 and c.a >= -999.99 and c.b <= 9999.99


def test_clauses_against_all_assignments():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 6)
        made = [tuple(rng.choice([-1, 1]) * rng.randint(1, n) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 14))]
        made += rng.choice([[], clauses.exactly_one(1, n), clauses.equals_and(1, *range(2, n + 1)), clauses.equals_or(n, 1), clauses.implies(1, n), clauses.at_least_one(*range(1, n + 1))])
        possible = any(all(any(v[abs(x)] == (x > 0) for x in c) for c in made) for bits in itertools.product([False, True], repeat=n) for v in [dict(enumerate(bits, 1))])
        got = clauses.Clauses(made).solve()
        assert (got is not None) == possible
        if got:
            assert all(any(got[abs(x)] == (x > 0) for x in c) for c in made)
    assert clauses.Clauses([()]).solve() is None


def test_edn_operations(spark, tmp_path):
    (tmp_path / "j.txt").write_text("0\t:ok\t:txn\t[[:w 1 5] [:r 2 nil] [:rp [:mod 4 1] {1 5, 3 9}]]\n")
    got = [(r.f, r.key, r.value, r.predicate, r.found) for r in histories.read_edn_operations(spark, f"{tmp_path}/j.txt").orderBy("op_index").collect()]
    assert got == [("w", "1", 5, None, None), ("r", "2", None, None, None), ("rp", None, None, "[:mod 4 1]", "{1 5, 3 9}")]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tbl").write_text("1|x y|\n2|z|\n")
    (tmp_path / "a.csv").write_text('k,v\n1,"x, y"\n')
    assert [tuple(r) for r in histories.read_delimited(spark, f"{tmp_path}/a.tbl", "k int, v string", "tbl").orderBy("k").collect()] == [(1, "x y"), (2, "z")]
    assert histories.read_delimited(spark, f"{tmp_path}/a.csv", "k int, v string").first().v == "x, y"


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = ingest.latest_versions(stream(), f"{tmp_path}/state", f"{tmp_path}/c1")
    q.awaitTermination()
    last = max((tmp_path / "state").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    expected = events.filter("event_type in ('purchase', 'signup')").groupBy((F.col("event_id") % 20).alias("k")).agg(F.max(F.struct("ts", "event_id")).alias("m"))
    assert {(r.key, r.value) for r in spark.read.parquet(str(last)).collect()} == {(f"kv:{r.k}", r.m.event_id) for r in expected.collect()}
    q = ingest.windowed_counts(stream(), "1 day", "40 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()
