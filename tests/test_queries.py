"""Every query of the catalog against its SQL in another engine, on the smallest tables."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from histra import catalog
from histra.plans import transactional, wide_table
from histra.plans.dialect import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool):
        return f"{float(x):.8g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, other, name):
    df = catalog.queries()[name](spark, SF)
    result = other.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(transactional.ORDERS))
def test_statements_return_their_order(spark, name):
    rows = catalog.queries()[name](spark, SF).collect()
    first, *down = transactional.ORDERS[name].split(",")[0].split(" ")
    values = [r[first] for r in rows]
    assert values == sorted(values, reverse=bool(down))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("k", [wide_table.MOST_AT_ONCE, wide_table.MOST_AT_ONCE + 1, 2 * wide_table.MOST_AT_ONCE + 1])
def test_wide_maxima_in_groups(spark, k):
    lines = spark.createDataFrame([(1, 2, 3), (40, 50, 60)], "l_orderkey long, l_partkey long, l_linenumber long")
    expected = {f"max{i}": max((a * i + b + c) % (1000 + i) for a, b, c in [(1, 2, 3), (40, 50, 60)]) for i in range(1, k + 1)}
    assert [r.asDict() for r in wide_table.max_fields(lines, k).collect()] == [expected]
    assert [set(r) for r in wide_table.max_fields(lines.limit(0), k).collect()] == [{None}]
