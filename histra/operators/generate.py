"""Seeded data: counters, Zipf and other skewed numbers, and key-value workloads. Every column is an expression of the row
number and a seed, so a table of any size is made in parallel and comes out the same each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unit(i: Column, seed: int) -> Column:
    """A number in [0, 1) for each row number."""
    return F.shiftrightunsigned(F.xxhash64(i, F.lit(seed)), 11) / F.lit(float(1 << 53))


def uniform(i: Column, low: int, high: int, seed: int) -> Column:
    return (low + F.floor(unit(i, seed) * (high - low + 1))).cast("long")


def cyclic(i: Column, n: int) -> Column:
    return i % n


def zipfian(i: Column, n: int, seed: int, theta: float = 0.99) -> Column:
    """Zipf numbers 0 to n - 1 by the published closed form for skewed data generation."""
    zeta = lambda k: sum(1 / j**theta for j in range(1, k + 1)) if k <= 100_000 else zeta(100_000) + (k ** (1 - theta) - 100_000 ** (1 - theta)) / (1 - theta)
    zn, z2 = zeta(n), zeta(2)
    alpha = 1 / (1 - theta)
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - z2 / zn)
    u = unit(i, seed)
    tail = F.floor(n * F.pow(eta * u - eta + 1, F.lit(alpha)))
    return F.when(u * zn < 1, 0).when(u * zn < 1 + 0.5**theta, 1).otherwise(F.least(tail, F.lit(n - 1))).cast("long")


def scrambled_zipfian(i: Column, n: int, seed: int) -> Column:
    """Zipf counts, but popular values lie scattered."""
    return F.pmod(F.xxhash64(zipfian(i, n, seed)), F.lit(n))


def gaussian(i: Column, low: int, high: int, seed: int) -> Column:
    """The mean of twelve uniform numbers, spread over the range."""
    total = sum((unit(i, seed * 31 + k) for k in range(12)), F.lit(0.0))
    return (low + F.floor(total / 12 * (high - low + 1))).cast("long")


def weighted(i: Column, weights: dict[str, int], seed: int) -> Column:
    """Values in proportion to their weights."""
    point, upto, out = unit(i, seed) * sum(weights.values()), 0, F
    column = None
    for value, weight in weights.items():
        upto += weight
        column = (out.when if column is None else column.when)(point < upto, F.lit(value))
    return column


def key_value_workload(spark: SparkSession, txns: int, keys: int = 10, sessions: int = 4, most_ops: int = 5, most_writes: int = 32, seed: int = 1) -> DataFrame:
    """session, txn, op_index, type (r, w or pr, a third each), key, value, predicate. A key is retired after most_writes writes:
    key k becomes k + keys, and so on. Written values are unique."""
    i = F.col("txn")
    rows = spark.range(txns).select(F.col("id").alias("txn"))
    ops = rows.select((i % sessions).alias("session"), "txn", F.explode(F.sequence(F.lit(0).cast("long"), uniform(i, 1, most_ops, seed) - 1)).alias("op_index"))
    n = F.col("txn") * 1000 + F.col("op_index")
    ops = ops.withColumn("type", F.element_at(F.array(F.lit("r"), F.lit("w"), F.lit("pr")), (uniform(n, 0, 2, seed + 1) + 1).cast("int"))).withColumn("slot", zipfian(n, keys, seed + 2))
    before = Window.partitionBy("slot").orderBy("txn", "op_index").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.floor(F.coalesce(F.sum((F.col("type") == "w").cast("long")).over(before), F.lit(0)) / most_writes)
    kind = F.element_at(F.array(*[F.lit(p) for p in ("TRUE", "value = {}", "value % 4 = {}", "value > {}", "value < {}")]), (uniform(n, 0, 4, seed + 3) + 1).cast("int"))
    return ops.withColumn("key", F.col("slot") + turn * keys).select(
        "session", "txn", "op_index", "type", F.when(F.col("type") != "pr", F.col("key")).alias("key"), F.when(F.col("type") == "w", n).alias("value"),
        F.when(F.col("type") == "pr", F.replace(kind, F.lit("{}"), uniform(n, 0, 3, seed + 4).cast("string"))).alias("predicate"),
    )


#: Words of generated decision-support rows.
FLAGS, SEGMENTS, PRIORITIES = ("A", "N", "R"), ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _one_of(i: Column, values: tuple[str, ...], seed: int) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), uniform(i, 0, len(values) - 1, seed).cast("int"))


def customers(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id") + 1
    return spark.range(n).select(
        i.alias("c_custkey"), F.format_string("Customer#%09d", i).alias("c_name"), uniform(i, 0, 24, 101).cast("int").alias("c_nationkey"), F.round(uniform(i, -99_999, 999_999, 102) / 100, 2).alias("c_acctbal"), _one_of(i, SEGMENTS, 103).alias("c_mktsegment")
    )


def orders(spark: SparkSession, n: int, n_customers: int) -> DataFrame:
    """Two of three customers have orders, as in the published benchmark's rule."""
    i = F.col("id") + 1
    third = uniform(i, 0, max(0, n_customers * 2 // 3 - 1), 111)
    day = uniform(i, 0, 2405, 112)
    return spark.range(n).select(i.alias("o_orderkey"), (third + F.floor(third / 2) + 1).alias("o_custkey"), F.date_add(F.lit("1992-01-01").cast("date"), day.cast("int")).alias("o_orderdate"), _one_of(i, PRIORITIES, 113).alias("o_orderpriority"))


def lineitems(spark: SparkSession, n_orders: int, n_parts: int, n_suppliers: int) -> DataFrame:
    """One to seven lines for each order; ship dates 1 to 121 days after the order's."""
    rows = orders(spark, n_orders, n_orders).select("o_orderkey", "o_orderdate", F.explode(F.sequence(F.lit(1), uniform(F.col("o_orderkey"), 1, 7, 121).cast("int"))).alias("l_linenumber"))
    i = F.col("o_orderkey") * 8 + F.col("l_linenumber")
    quantity, part = uniform(i, 1, 50, 122), uniform(i, 1, n_parts, 123)
    price = (90_000 + F.floor(part / 10) % 20_001 + 100 * (part % 1000)) / 100
    return rows.select(
        F.col("o_orderkey").alias("l_orderkey"), part.alias("l_partkey"), uniform(i, 1, n_suppliers, 124).alias("l_suppkey"), "l_linenumber", quantity.cast("double").alias("l_quantity"), F.round(quantity * price, 2).alias("l_extendedprice"),
        (uniform(i, 0, 10, 125) / 100).alias("l_discount"), (uniform(i, 0, 8, 126) / 100).alias("l_tax"), _one_of(i, FLAGS, 127).alias("l_returnflag"), F.date_add("o_orderdate", uniform(i, 1, 121, 128).cast("int")).alias("l_shipdate"),
    )
