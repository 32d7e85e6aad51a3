"""Reading and writing recorded histories: a folder with the initial state, the history's lines and a manifest.

A path may be a pattern that names many folders: each is a case, named by its folder, and all of them are read at once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Names of files, the manifest's format, and fields of an older form of the lines, which are refused.
HISTORY_FILE, INITIAL_FILE, MANIFEST_FILE = "history.prhist.jsonl", "initial_state.json", "manifest.json"
FORMAT = "prhist-v2-kv-relational-predicate"
FORBIDDEN = ("write_id", "source_write_id", "source_txn", "source_op_index")

INITIAL_SCHEMA = "key string, value variant, absent boolean"
QUERY_SCHEMA = "struct<from: struct<relation: string, alias: string>, joins: array<struct<type: string, relation: string, alias: string, on: array<string>>>, where: array<string>, select: struct<distinct: boolean, columns: array<string>>>"
_REFUSED = ", ".join(f"{name}: variant" for name in FORBIDDEN)
OP_SCHEMA = f"struct<type: string, key: string, value: variant, query: {QUERY_SCHEMA}, result: struct<values: array<variant>, inputs: array<struct<key: string, value: variant, {_REFUSED}>>>, predicate: variant, results: variant, {_REFUSED}>"
LINE_SCHEMA = f"session bigint, session_seq bigint, txn bigint, status string, ops array<{OP_SCHEMA}>"


class InvalidHistory(ValueError):
    pass


def _bad_value(v: Column, integers_only: bool) -> Column:
    kind = F.schema_of_variant(v)
    fine = (kind == "BIGINT") if integers_only else kind.isin("BIGINT", "STRING", "BOOLEAN") | F.startswith(kind, F.lit("OBJECT"))
    return v.isNull() | ~fine


def _has(name: str):
    return lambda x: x[name].isNotNull()


def _complaint(o: Column, integers_only: bool) -> Column:
    """What is wrong with an operation; null if nothing is."""
    point, asked = o["type"].isin("r", "w"), o["type"] == "pr"
    keys = F.transform(o["result"]["inputs"], lambda i: i["key"])
    refused = F.lit(False)
    for name in FORBIDDEN:
        refused = refused | o[name].isNotNull() | F.coalesce(F.exists(o["result"]["inputs"], _has(name)), F.lit(False))
    return (
        F.when(refused, "a field of the older form")
        .when(o["type"].isNull() | ~(point | asked), "an unknown type of operation")
        .when(point & o["key"].isNull(), "an operation without key")
        .when(point & _bad_value(o["value"], integers_only), "a value that can't be stored")
        .when(asked & (o["predicate"].isNotNull() | o["results"].isNotNull()), "a condition read of the older form")
        .when(asked & (o["query"].isNull() | o["result"]["values"].isNull() | o["result"]["inputs"].isNull()), "a condition read without query or result")
        .when(asked & F.exists(keys, lambda k: k.isNull()), "an input without key")
        .when(asked & (F.size(F.array_distinct(keys)) < F.size(keys)), "a duplicate input key")
        .when(asked & F.exists(o["result"]["inputs"], lambda i: _bad_value(i["value"], integers_only)), "an input value that can't be stored")
    )


def read_transactions(spark: SparkSession, path: str, integers_only: bool = False) -> DataFrame:
    """One row for each line: case (the folder's name), line_no (sorts like the lines of a file), then the fields of LINE_SCHEMA.
    Blank lines are passed over. The order of a session's lines is its order; session_seq is not used. A line that breaks the
    format is an error. integers_only: the strict form, whose values are integers.

    Files are split and read in parallel: a line's place is the start of its split and its number within it.
    """
    lines = spark.read.text(f"{path}/{HISTORY_FILE}").select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("case"), F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n")).alias("line_no"), F.col("value").alias("line")
    )
    parsed = lines.filter(F.trim("line") != "").select("case", "line_no", F.from_json("line", LINE_SCHEMA, {"mode": "FAILFAST"}).alias("t")).select("case", "line_no", "t.*")
    wrong = F.filter(F.transform("ops", lambda o: _complaint(o, integers_only)), lambda x: x.isNotNull())
    return parsed.withColumn("ops", F.when(F.size(wrong) > 0, F.raise_error(F.concat(F.lit("InvalidHistory: "), F.get(wrong, 0)))).otherwise(F.col("ops")))


def read_initial(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(INITIAL_SCHEMA).option("multiLine", True).json(f"{path}/{INITIAL_FILE}")
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("case"), "key", F.to_json("value").alias("value"), F.coalesce("absent", F.lit(False)).alias("absent"))


def transactions(lines: DataFrame) -> DataFrame:
    """case, session, so_pos, txn, status; transactions that did not commit, and numbers used twice in a case, are errors."""
    order = Window.partitionBy("case", "session").orderBy("line_no")
    same = Window.partitionBy("case", "txn")
    rows = lines.select("case", "line_no", "session", "txn", "status", "ops").withColumn("so_pos", F.row_number().over(order) - 1).withColumn("copies", F.count("*").over(same))
    bad = F.when(~F.col("status").eqNullSafe("commit"), "InvalidHistory: a status is not commit").when(F.col("copies") > 1, "InvalidHistory: duplicate transaction")
    # The size of ops is asked for, so that a line with a broken operation fails here, too.
    checked = F.when(bad.isNotNull(), F.raise_error(bad)).when(F.size("ops") < 0, F.col("status")).otherwise(F.col("status"))
    return rows.withColumn("status", checked).select("case", "session", "so_pos", "txn", "status")


def operations(lines: DataFrame) -> DataFrame:
    """case, txn, op_index, type, key, value (canonical JSON), query (JSON of a condition read)."""
    rows = lines.select("case", "txn", F.posexplode("ops").alias("op_index", "o"))
    return rows.select("case", "txn", "op_index", "o.type", "o.key", F.to_json("o.value").alias("value"), F.to_json("o.query").alias("query"))


def predicate_inputs(lines: DataFrame) -> DataFrame:
    rows = lines.select("case", "txn", F.posexplode("ops").alias("op_index", "o")).filter("o.type = 'pr'")
    return rows.select("case", "txn", "op_index", F.explode("o.result.inputs").alias("i")).select("case", "txn", "op_index", "i.key", F.to_json("i.value").alias("value"))


def predicate_values(lines: DataFrame) -> DataFrame:
    rows = lines.select("case", "txn", F.posexplode("ops").alias("op_index", "o")).filter("o.type = 'pr'")
    return rows.select("case", "txn", "op_index", F.explode("o.result.values").alias("v")).select("case", "txn", "op_index", F.to_json("v").alias("value"))


def moduli(lines: DataFrame) -> DataFrame:
    """case, txn, op_index, modulus, residue of condition reads in the strict form, which looks at the first condition alone."""
    rows = lines.select("case", "txn", F.posexplode("ops").alias("op_index", "o")).filter("o.type = 'pr'").withColumn("w", F.get("o.query.where", 0))
    form = r"^\s*value\s*%\s*(\d+)\s*=\s*(-?\d+)\s*$"
    number = lambda k: F.regexp_extract("w", form, k).cast("long")
    good = F.coalesce(F.regexp_like("w", F.lit(form)), F.lit(False))
    return rows.select("case", "txn", "op_index", F.when(good, number(1)).otherwise(F.raise_error(F.lit("InvalidHistory: the condition is not value % m = r"))).alias("modulus"), number(2).alias("residue"))


def text_dump(lines: DataFrame) -> DataFrame:
    """line: sessions, their transactions and operations as text, with columns to order it by."""
    ops = operations(lines)
    body = ops.groupBy("case", "txn").agg(F.array_sort(F.collect_list(F.struct("op_index", F.concat_ws(" ", F.upper("type"), F.coalesce("key", F.lit("?")), F.coalesce("value", "query")).alias("s")))).alias("ops"))
    rows = transactions(lines).join(body, ["case", "txn"], "left")
    text = F.concat(F.lit("txn "), F.col("txn").cast("string"), F.lit(" ["), F.array_join(F.transform("ops", lambda o: o["s"]), "; "), F.lit("]"))
    return rows.select("case", "session", "so_pos", F.when(F.col("ops").isNull(), F.concat(F.lit("txn "), F.col("txn").cast("string"), F.lit(" []"))).otherwise(text).alias("line"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the session's checkpoint folder, which all executors share; it goes when the session ends."""
    from histra.operators.graph import checkpoint_folder

    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


def write_history(lines: DataFrame, initial: DataFrame, path: str, name: str) -> None:
    """lines: session, txn, ops (JSON array text), ordered by line_no; initial: key, value (JSON text). One file each, as the
    format asks: the order of lines is part of it."""
    text = F.concat(F.lit('{"session":'), "session", F.lit(',"txn":'), "txn", F.lit(',"status":"commit","ops":'), "ops", F.lit("}"))
    _single_file(lines.coalesce(1).sortWithinPartitions("line_no").select(text), f"{path}/{HISTORY_FILE}")
    row = F.concat(F.lit('{"key":'), F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(',"value":'), "value", F.lit("}"))
    whole = initial.select(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(row)), ","), F.lit("]")))
    _single_file(whole, f"{path}/{INITIAL_FILE}")
    manifest = json.dumps({"dataset_name": name, "format": FORMAT, "transactions": lines.count(), "initial_keys": initial.count()})
    _single_file(lines.sparkSession.createDataFrame([(manifest,)], "value string"), f"{path}/{MANIFEST_FILE}")


def _single_file(rows: DataFrame, path: str) -> None:
    """Write through Spark's writer to a folder, then move its one part to the path, on the same file system."""
    spark = rows.sparkSession
    rows.coalesce(1).write.mode("overwrite").text(f"{path}.parts")
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}.parts")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(folder, True)


def read_edn_operations(spark: SparkSession, path: str) -> DataFrame:
    """process, phase, kind, txn, op_index, f (w, r or rp), key, value, predicate, found: the micro-operations of lines
    "process \\t :invoke|:ok \\t :init|:txn \\t [[:w k v] [:r k v] [:rp [:= n] {k v}]]"; n for nil reads is null."""
    # txn numbers a line by its place in the file, not densely.
    lines = spark.read.text(path).select((F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.monotonically_increasing_id() % F.lit(1 << 33)).alias("txn"), F.col("value").alias("line"))
    lines = lines.withColumn("p", F.split("line", "\t")).filter(F.size("p") >= 4)
    micro = r"(\[:(?:w|r) [^\]]*\]|\[:rp \[[^\]]*\] \{[^}]*\}\])"
    ops = lines.select(F.col("p")[0].alias("process"), F.col("p")[1].alias("phase"), F.col("p")[2].alias("kind"), "txn", F.posexplode(F.regexp_extract_all(F.col("p")[3], F.lit(micro), F.lit(1))).alias("op_index", "m"))
    point = r"^\[:(w|r) (\S+) (\S+)\]$"
    return ops.select(
        "process", "phase", "kind", "txn", "op_index",
        F.regexp_extract("m", r"^\[:(\w+) ", 1).alias("f"),
        F.nullif(F.regexp_extract("m", point, 2), F.lit("")).alias("key"),
        F.expr("try_cast(nullif(regexp_extract(m, '^\\\\[:(w|r) (\\\\S+) (\\\\S+)\\\\]$', 3), '') as bigint)").alias("value"),
        F.nullif(F.regexp_extract("m", r"^\[:rp (\[[^\]]*\])", 1), F.lit("")).alias("predicate"),
        F.nullif(F.regexp_extract("m", r"(\{[^}]*\})\]$", 1), F.lit("")).alias("found"),
    )


def read_delimited(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """csv: with header; tbl and dat: "|" between and after the fields."""
    if kind == "csv":
        return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    wide = f"{schema}, _end string"
    return spark.read.schema(wide).option("sep", "|").csv(path).drop("_end")
