"""Change capture: what triggers beside a database would record, derived from tables of events and rows.

Versions and operations come from windows over the order of events, so nothing is kept between rows; the latest version of
each key is an aggregate. Keys are "<table>:<column>=<value>:..." and primary keys JSON objects, as for any captured table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A missing row of number id reads as this less id.
ABSENT = -1_000_000_000_000


def object_key(table: str, **columns: str) -> Column:
    """Canonical key of a row: "stock:w=1:i=7" for table "stock", w="s_w_id", i="s_i_id"."""
    return F.concat(F.lit(table), *[F.concat(F.lit(f":{short}="), F.col(name).cast("string")) for short, name in columns.items()])


def primary_key(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def captured_events(events: DataFrame, keys: int) -> DataFrame:
    """Events as operations of transactions (a user's day): session, txn_day, op_index from 0, kind w, r or pr, id (of the row),
    version (of a write) and ts, event_id for the order."""
    inside = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "w").when(F.col("event_type").isin("view", "click"), "r").otherwise("pr")
    rows = events.select("user_id", F.substring(F.col("ts").cast("string"), 1, 10).alias("day"), "ts", "event_id", kind.alias("kind"), (F.col("event_id") % keys).alias("id"))
    return rows.withColumn("op_index", (F.row_number().over(inside) - 1).cast("long"))


def written_versions(ops: DataFrame) -> DataFrame:
    """One row for each write: key, version, before (the version it replaced, null for the first)."""
    order = Window.partitionBy("id").orderBy("ts", "event_id")
    return ops.filter("kind = 'w'").select(object_key("kv", id="id").alias("key"), F.col("event_id").alias("version"), F.lag("event_id").over(order).alias("before"), F.col("user_id").alias("session"), "day", "op_index")


def latest_versions(ops: DataFrame) -> DataFrame:
    """The table of current versions: key, version, writes."""
    at = F.struct("ts", "event_id")
    return ops.filter("kind = 'w'").groupBy("id").agg(F.max_by("event_id", at).alias("version"), F.count("*").alias("writes")).select(object_key("kv", id="id").alias("key"), "version", "writes")


def point_reads(ops: DataFrame) -> DataFrame:
    """key, value and absent of each read: the version that was current, or the number that stands for a missing row."""
    before = Window.partitionBy("id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("kind") == "w", F.col("event_id")), ignorenulls=True).over(before)
    rows = ops.filter("kind <> 'pr'").withColumn("seen", seen).filter("kind = 'r'")
    return rows.select(F.col("user_id").alias("session"), "day", "op_index", object_key("kv", id="id").alias("key"), F.coalesce("seen", F.lit(ABSENT) - F.col("id")).alias("value"), F.col("seen").isNull().alias("absent"))


def condition_reads(ops: DataFrame, keys: int, modulus: int) -> DataFrame:
    """For each read by condition (version % modulus = event_id % modulus): how many current versions satisfied it, and the
    smallest and largest of them. Versions are looked up as of the read, key by key, by one window over reads and writes."""
    asked = ops.filter("kind = 'pr'").withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(keys - 1).cast("long"))))
    lines = asked.unionByName(ops.filter("kind = 'w'"))
    before = Window.partitionBy("id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = lines.withColumn("seen", F.last(F.when(F.col("kind") == "w", F.col("event_id")), ignorenulls=True).over(before)).filter("kind = 'pr'")
    hit = F.col("seen") % modulus == F.col("event_id") % modulus
    found = seen.groupBy("user_id", "day", "op_index").agg(F.count_if(hit).alias("results"), F.min(F.when(hit, F.col("seen"))).alias("least"), F.max(F.when(hit, F.col("seen"))).alias("most"))
    return found.withColumnRenamed("user_id", "session")


def initial_snapshot(rows: DataFrame, key: Column, pk: Column, value: Column) -> DataFrame:
    """Every current row as a version from before the run."""
    return rows.select(F.lit("initial").alias("record_type"), key.alias("key"), pk.alias("pk"), value.alias("value"))


def export(initial: DataFrame, ops: DataFrame) -> DataFrame:
    """The typed rows of a trace, in the order of `part`, `session`, `day`: one line for each first version and each transaction."""
    first = initial.select(F.lit(0).alias("part"), F.lit(None).cast("long").alias("session"), F.lit(None).cast("string").alias("day"), "key", F.to_json(F.struct("record_type", "key", "value")).alias("line"))
    op = F.struct("op_index", F.col("kind").alias("type"), F.when(F.col("kind") != "pr", object_key("kv", id="id")).alias("key"), F.when(F.col("kind") == "w", F.col("event_id")).alias("value"))
    txns = ops.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(op)).alias("ops"))
    line = F.to_json(F.struct(F.lit("txn").alias("record_type"), F.col("user_id").alias("session"), "day", F.lit("commit").alias("status"), "ops"))
    return first.unionByName(txns.select(F.lit(1).alias("part"), F.col("user_id").alias("session"), "day", F.lit(None).cast("string").alias("key"), line.alias("line")))


def stock_level(lines: DataFrame, stock: DataFrame, by: list[str], threshold: int) -> DataFrame:
    """A read over two tables: for each group `by` of order lines (item, line_key) the items whose stock (item, stock_key,
    quantity) is below the threshold, and the versions that took part: result (sorted items), n_versions (rows of both tables)."""
    joined = lines.join(stock, "item").filter(F.col("quantity") < threshold)
    read = F.array_union(F.collect_set("line_key"), F.collect_set("stock_key"))
    return joined.groupBy(*by).agg(F.array_sort(F.collect_set("item")).alias("result"), F.size(read).cast("long").alias("n_versions"))


def stock_level_query(warehouse: Column, district: Column, lower: Column, upper: Column, threshold: Column) -> Column:
    """The same read as a query object of the condition language (JSON), with its extended comparators."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    join = F.struct(F.lit("INNER").alias("type"), F.lit("stock").alias("relation"), F.lit("s").alias("alias"), F.array(F.lit("ol.ol_w_id = s.s_w_id"), F.lit("ol.ol_i_id = s.s_i_id")).alias("on"))
    where = F.array(text("ol.ol_w_id = ", warehouse), text("ol.ol_d_id = ", district), text("ol.ol_o_id >= ", lower), text("ol.ol_o_id < ", upper), text("s.s_quantity < ", threshold))
    return F.to_json(
        F.struct(
            F.struct(F.lit(True).alias("distinct"), F.array(F.lit("s.s_i_id")).alias("columns")).alias("select"),
            F.struct(F.lit("order_line").alias("relation"), F.lit("ol").alias("alias")).alias("from"),
            F.array(join).alias("joins"),
            where.alias("where"),
        )
    )


def written_row(key: Column, value: Column, before: Column, row: Column) -> Column:
    """A write as JSON: an integer version, and the row's columns beside it."""
    return F.to_json(F.struct(F.lit("w").alias("type"), key.alias("key"), value.alias("value"), before.alias("before_value"), row.alias("row")))
