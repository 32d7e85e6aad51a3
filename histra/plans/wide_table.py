"""Scans of a wide table: k integer fields made from line items by a rule; projection, maxima and row-wise sums."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTHS = tuple(range(25, 251, 25))
#: Fields up to which Spark generates code for a stage (the default of spark.sql.codegen.maxFields); wider aggregates are interpreted.
MOST_AT_ONCE = 100


def field(i: int) -> Column:
    return ((F.col("l_orderkey") * i + F.col("l_partkey") + F.col("l_linenumber")) % (1000 + i)).alias(f"field{i}")


def field_sql(i: int) -> str:
    return f"((l_orderkey * {i} + l_partkey + l_linenumber) % {1000 + i})"


def read_records(lines: DataFrame, k: int, above: int = 990) -> DataFrame:
    """Fields 1 to k of the records whose first field is above a bound; only the three source columns are scanned."""
    return lines.filter(field(1) > above).select(*[field(i) for i in range(1, k + 1)])


def max_fields(lines: DataFrame, k: int) -> DataFrame:
    """One row. Fields beyond MOST_AT_ONCE are aggregated in groups, each a scan of the three source columns; the groups' single rows
    are put together by a last maximum, so an empty table gives nulls."""
    n = -(-k // MOST_AT_ONCE)
    bounds = [1 + k * g // n for g in range(n + 1)]
    groups = [lines.agg(*[F.max(field(i)).alias(f"max{i}") for i in range(lo, hi)]) for lo, hi in zip(bounds, bounds[1:])]
    if n == 1:
        return groups[0]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)
    return rows.agg(*[F.max(f"max{i}").alias(f"max{i}") for i in range(1, k + 1)])


def sum_record(lines: DataFrame, k: int, above: int = 990) -> DataFrame:
    """The sum along each record, not down the table."""
    return lines.filter(field(1) > above).select("l_orderkey", "l_linenumber", reduce(add, [field(i) for i in range(1, k + 1)]).alias("total"))


def oracle(kind: str, k: int, above: int = 990) -> str:
    if kind == "read":
        return f"SELECT {', '.join(f'{field_sql(i)} AS field{i}' for i in range(1, k + 1))} FROM lineitem WHERE {field_sql(1)} > {above}"
    if kind == "max":
        return f"SELECT {', '.join(f'max({field_sql(i)}) AS max{i}' for i in range(1, k + 1))} FROM lineitem"
    return f"SELECT l_orderkey, l_linenumber, {' + '.join(field_sql(i) for i in range(1, k + 1))} AS total FROM lineitem WHERE {field_sql(1)} > {above}"
