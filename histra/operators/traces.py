"""Raw change traces to histories.

A trace is JSON lines of three record types: initial (a row version before the run), txn (a committed transaction with its
operations) and abort. Conversion keeps the committed transactions, in order of session, session_seq and txn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OP = "struct<op_index: int, type: string, key: string, value: bigint, absent: boolean, predicate: struct<kind: string, value: bigint, modulus: bigint, target: bigint>, results: array<struct<key: string, value: bigint>>, read_versions: array<struct<key: string, value: bigint>>>"
SCHEMA = f"record_type string, key string, value bigint, txn bigint, session bigint, session_seq bigint, status string, error string, ops array<{OP}>"
#: Value of a key that is not there, by its number.
ABSENT = -1_000_000_000_000


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def predicate_text(p: Column) -> Column:
    """The predicate of an operation in the predicate language."""
    kind = p["kind"]
    return (
        F.when(kind == "true", "TRUE")
        .when(kind == "eq", F.concat(F.lit("value = "), p["value"].cast("string")))
        .when(kind == "mod", F.concat(F.lit("value % "), p["modulus"].cast("string"), F.lit(" = "), p["target"].cast("string")))
        .when(kind == "gt", F.concat(F.lit("value > "), p["value"].cast("string")))
        .when(kind == "lt", F.concat(F.lit("value < "), p["value"].cast("string")))
    )


def _checked(trace: DataFrame) -> DataFrame:
    rows = trace.filter("record_type = 'txn' and status = 'commit'")
    numbers = F.transform("ops", lambda o: o["op_index"])
    twice = F.size(F.array_distinct(numbers)) < F.size(numbers)
    return rows.withColumn("txn", F.when(twice, F.raise_error(F.lit("duplicate op_index"))).otherwise(F.col("txn")))


def convert(trace: DataFrame) -> DataFrame:
    """line_no order columns, session, txn and ops as JSON text, as write_history takes them."""
    ordered = F.array_sort("ops", lambda a, b: a["op_index"] - b["op_index"])
    columns = F.struct(F.array(F.lit("k"), F.lit("value")).alias("columns"))

    def one(o: Column) -> Column:
        point = F.to_json(F.struct(o["type"].alias("type"), o["key"].alias("key"), o["value"].alias("value")))
        query = F.struct(F.struct(F.lit("kv").alias("relation")).alias("from"), F.array(predicate_text(o["predicate"])).alias("where"), columns.alias("select"))
        values = F.transform(F.array_sort(o["results"]), lambda x: F.struct(x["key"].alias("k"), x["value"].alias("value")))
        read = F.to_json(F.struct(F.lit("pr").alias("type"), query.alias("query"), F.struct(values.alias("values"), F.array_sort(o["read_versions"]).alias("inputs")).alias("result")))
        return F.when(o["type"] == "pr", read).otherwise(point)

    return _checked(trace).select(F.struct("session", "session_seq", "txn").alias("line_no"), "session", "txn", F.concat(F.lit("["), F.array_join(F.transform(ordered, one), ","), F.lit("]")).alias("ops"))


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line: lines of a trace that are no record, with their place in the file."""
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n")).alias("line_no"), F.col("value").alias("line"))
    kind = F.from_json("line", "record_type string, txn bigint, key string")
    bad = kind["record_type"].isNull() | ~kind["record_type"].isin("initial", "txn", "abort") | ((kind["record_type"] == "initial") & kind["key"].isNull()) | ((kind["record_type"] == "txn") & kind["txn"].isNull())
    return lines.filter((F.trim("line") != "") & F.coalesce(bad, F.lit(True)))


def initial_state(trace: DataFrame) -> DataFrame:
    """key, value: the recorded first versions, and one for each key that was first read while absent."""
    known = trace.filter("record_type = 'initial'").select("key", "value")
    reads = _checked(trace).select(F.explode("ops").alias("o")).filter("o.absent").groupBy("o.key").agg(F.max("o.value").alias("value"))
    missing = reads.join(known, "key", "left_anti").select("key", F.least("value", F.lit(ABSENT)).alias("value"))
    return known.unionByName(missing).select("key", F.col("value").cast("string").alias("value"))


def counts(trace: DataFrame) -> DataFrame:
    """What a manifest tells: transactions, point reads, predicate reads, writes, operations, aborted attempts."""
    ops = _checked(trace).select(F.explode("ops").alias("o"))
    n = ops.agg(F.count_if(F.col("o.type") == "r").alias("point_reads"), F.count_if(F.col("o.type") == "pr").alias("predicate_reads"), F.count_if(F.col("o.type") == "w").alias("writes"), F.count("*").alias("operations"))
    t = trace.agg(F.count_if((F.col("record_type") == "txn") & (F.col("status") == "commit")).alias("transactions"), F.count_if(F.col("record_type") == "abort").alias("aborted"))
    return t.crossJoin(n)  # one row each
