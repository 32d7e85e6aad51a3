"""Suites of recorded cases: conditions of their own kinds, checks of declared conflicts, audits, and a run over a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histra.sources import histories

from . import solve

#: Comparators and kinds of edges that a suite's files may name.
COMPARATORS = ("ge", "gt", "le", "lt", "eq")
EDGE_TYPES = ("RW", "PR_RW", "PR_WR")


def compared(value: Column, comparator: Column, threshold: Column) -> Column:
    return (
        F.when(comparator == "ge", value >= threshold)
        .when(comparator == "gt", value > threshold)
        .when(comparator == "le", value <= threshold)
        .when(comparator == "lt", value < threshold)
        .when(comparator == "eq", value == threshold)
        .otherwise(F.raise_error(F.concat(F.lit("unsupported comparator: "), F.coalesce(comparator, F.lit("null")))).cast("boolean"))
    )


def suite_condition(p: Column, key: Column, value: Column) -> Column:
    """Whether a version satisfies a suite's condition, a struct (kind, key_prefix, comparator, threshold, allowed, min_score):
    inventory_threshold compares, order_filter also asks for one of the allowed values (any, if there are none), and
    search_ranked_docs asks for a least score."""
    own = F.startswith(key, p["key_prefix"])
    some = F.size(F.coalesce(p["allowed"], F.array().cast("array<bigint>"))) == 0
    return (
        F.when(p["kind"] == "inventory_threshold", own & compared(value, p["comparator"], p["threshold"]))
        .when(p["kind"] == "order_filter", own & compared(value, p["comparator"], p["threshold"]) & (some | F.array_contains(p["allowed"], value)))
        .when(p["kind"] == "search_ranked_docs", own & (value >= p["min_score"]))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported kind: "), F.coalesce(p["kind"], F.lit("null")))).cast("boolean"))
    )


def conflict_faults(edges: DataFrame, txns: DataFrame, ops: DataFrame) -> DataFrame:
    """edges: case, n, type, src, dst, key, and perhaps null references read_op, write_op, condition_op (txn, op_index); txns: case,
    txn; ops: case, txn, op_index, type, key. The declared edges that do not stand in the history: case, n, fault."""
    for side in ("src", "dst"):
        here = txns.select("case", F.col("txn").alias(side), F.lit(True).alias(f"_{side}"))
        edges = edges.join(here, ["case", side], "left")
    for name in ("read_op", "write_op", "condition_op"):
        there = ops.select("case", F.struct("txn", "op_index").alias(name), F.struct("type", "key").alias(f"_{name}"))
        edges = edges.join(there, ["case", name], "left")

    def not_there(name: str, kind: str, same_key: bool) -> Column:
        found = F.col(f"_{name}")
        wrong = found.isNull() | (found["type"] != kind)
        return F.col(name).isNotNull() & F.coalesce((wrong | (found["key"] != F.col("key"))) if same_key else wrong, F.lit(True))

    fault = (
        F.when(F.col("_src").isNull() | F.col("_dst").isNull(), "no such transaction")
        .when(F.col("type").isNull() | ~F.col("type").isin(*EDGE_TYPES), "unsupported type")
        .when(not_there("read_op", "r", True), "no such read")
        .when(not_there("write_op", "w", True), "no such write")
        .when(not_there("condition_op", "pr", False), "no such condition read")
    )
    return edges.withColumn("fault", fault).filter("fault is not null").select("case", "n", "fault")


def audit(trace: DataFrame, lines: DataFrame, initial: DataFrame, manifest_format: str) -> DataFrame:
    """One row: whether a recorded case has the transactions and first versions of its raw trace, and a format that is known."""
    raw = trace.agg(F.count_if(F.col("record_type") == "txn").alias("raw_txns"), F.count_if(F.col("record_type") == "initial").alias("raw_initial"))
    own = lines.agg(F.count("*").alias("txns"))
    first = initial.agg(F.count("*").alias("keys"), F.count_if("absent").alias("absent"))
    both = raw.crossJoin(own).crossJoin(first)  # one row each
    good = (F.col("raw_txns") == F.col("txns")) & (F.col("raw_initial") + F.col("absent") == F.col("keys")) & F.lit(manifest_format in (histories.FORMAT, histories.FORMAT.split("-kv-")[0]))
    return both.select("raw_txns", "txns", "raw_initial", "absent", "keys", good.alias("valid"))


def run_catalog(lines: DataFrame, initial: DataFrame, expected: DataFrame, level: str = "SER", budget: int | None = None) -> DataFrame:
    """expected: case, expected_verdict. Decides every case: case, expected_verdict, actual_verdict, matched, timed_out."""
    found = solve.recorded_verdicts(lines, initial, level, budget)
    rows = expected.join(found.select("case", F.col("verdict").alias("actual_verdict")), "case", "left")
    return rows.select("case", "expected_verdict", F.coalesce("actual_verdict", F.lit("MISSING")).alias("actual_verdict"), F.col("actual_verdict").eqNullSafe(F.col("expected_verdict")).alias("matched"), F.coalesce(F.col("actual_verdict") == "UNKNOWN", F.lit(False)).alias("timed_out"))


def catalog_summary(results: DataFrame) -> DataFrame:
    counts = results.agg(F.count("*").alias("total_cases"), F.count_if("matched").alias("matched_expected"), F.count_if("timed_out").alias("timed_out"), *[F.count_if(F.col("actual_verdict") == v).alias(v.lower()) for v in ("ACCEPT", "REJECT", "UNKNOWN")])
    return counts.withColumn("mismatched_or_failed", F.col("total_cases") - F.col("matched_expected")).withColumn("all_matched", F.col("total_cases") == F.col("matched_expected"))


def write_results(results: DataFrame, path: str) -> None:
    """Folders of results as JSON lines and as CSV, a short table, and the summary."""
    results.write.mode("overwrite").json(f"{path}/results.jsonl")
    results.write.mode("overwrite").option("header", True).csv(f"{path}/results.csv")
    results.select("case", "expected_verdict", "actual_verdict", "matched").write.mode("overwrite").option("header", True).csv(f"{path}/table.csv")
    catalog_summary(results).write.mode("overwrite").json(f"{path}/summary.json")


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, initial, expected) of all cases below a folder; a manifest names the verdict that is expected."""
    pattern = f"{path}/*"
    manifests = spark.read.option("multiLine", True).schema("expected_verdict string").json(f"{pattern}/{histories.MANIFEST_FILE}")
    expected = manifests.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("case"), "expected_verdict")
    return histories.read_transactions(spark, pattern), histories.read_initial(spark, pattern), expected
