"""All queries of the library by name, with equivalent SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from histra.plans import capture_queries, condition_queries, decision_support, dialect, history_queries, run_queries, transactional, wide_table

Query = Callable[[SparkSession, str], DataFrame]


def _sql(text: str) -> Query:
    return lambda spark, sf_dir: dialect.run(spark, sf_dir, text)


def _template(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactional.run_template(spark, sf_dir, name)


def _wide(make: Callable[[DataFrame, int], DataFrame], k: int) -> Query:
    return lambda spark, sf_dir: make(dialect.read(spark, sf_dir, "lineitem"), k)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {name: _sql(text) for name, text in decision_support.QUERIES.items()}
    for n, k in enumerate(wide_table.WIDTHS, 1):
        found[f"w{n}_read_{k}"] = _wide(wide_table.read_records, k)
        found[f"w{n + 10}_max_{k}"] = _wide(wide_table.max_fields, k)
        found[f"w{n + 20}_sum_{k}"] = _wide(wide_table.sum_record, k)
    found.update(history_queries.QUERIES)
    found.update(condition_queries.QUERIES)
    found.update(run_queries.QUERIES)
    found.update(capture_queries.QUERIES)
    found.update({name: _sql(text) for name, text in transactional.QUERIES.items()})
    found.update({name: partial(_template, name) for name in transactional.TEMPLATES})
    return found


def oracle_sql() -> dict[str, str]:
    found = dict(decision_support.QUERIES)
    for n, k in enumerate(wide_table.WIDTHS, 1):
        found[f"w{n}_read_{k}"] = wide_table.oracle("read", k)
        found[f"w{n + 10}_max_{k}"] = wide_table.oracle("max", k)
        found[f"w{n + 20}_sum_{k}"] = wide_table.oracle("sum", k)
    found.update(history_queries.ORACLES)
    found.update(condition_queries.ORACLES)
    found.update(run_queries.ORACLES)
    found.update(capture_queries.ORACLES)
    found.update(transactional.QUERIES)
    found.update(transactional.TEMPLATE_ORACLES)
    return found
