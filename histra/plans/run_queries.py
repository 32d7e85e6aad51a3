"""Queries over run samples and generated data, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from histra.operators import generate, statistics

from .dialect import read


def _of(make):
    return lambda spark, sf_dir: make(statistics.samples_of(read(spark, sf_dir, "events")))


def _merged(s):
    a, b = statistics.histogram(s.filter("worker_id < 4"), F.col("txn_type")), statistics.histogram(s.filter("worker_id >= 2"), F.col("txn_type"))
    return statistics.merge(a, b)


def _generated(spark, sf_dir):
    i = F.col("id")
    return spark.range(10_000).select("id", generate.cyclic(i, 7).alias("cycle"), generate.uniform(i, 1, 6, 3).alias("die"), generate.zipfian(i, 100, 5).alias("zipf"), generate.scrambled_zipfian(i, 100, 5).alias("scattered"), generate.gaussian(i, 0, 9, 2).alias("bell"), generate.weighted(i, {"a": 1, "b": 3}, 4).alias("pick"))


QUERIES = {
    "r4_result_lines": _of(lambda s: statistics.result_lines(s, 3600)),
    "r5_sample_lines": _of(lambda s: statistics.sample_lines(s, 7200, "view")),
    "r5_raw_lines": _of(statistics.raw_lines),
    "r6_histogram_top": _of(lambda s: statistics.top(statistics.histogram(s, F.col("worker_id")), 3)),
    "r6_histogram_json": _of(lambda s: statistics.histogram_json(statistics.histogram(s, F.col("txn_type")))),
    "s18_run_summary": _of(lambda s: statistics.run_summary(s).select(*[F.get_json_object("line", f"$.{c}").cast("double").alias(c) for c in ("requests", "elapsed_ns", "throughput", "goodput")], F.get_json_object("line", "$.latency.p99").cast("long").alias("p99"))),
    "d6_settings": lambda spark, sf_dir: statistics.settings(spark),
    "s13_generated_customers": lambda spark, sf_dir: generate.customers(spark, 5000),
    "s13_generated_lineitems": lambda spark, sf_dir: generate.lineitems(spark, 5000, 2000, 100),
    "r1_distribution": _of(statistics.distribution),
    "r1_distribution_by_type": _of(lambda s: statistics.distribution(s, ["txn_type"])),
    "r2_time_buckets": _of(lambda s: statistics.time_buckets(s, 3600, "purchase")),
    "r3_throughput": _of(statistics.throughput),
    "r6_histogram_merge": _of(_merged),
    "r6_histogram_extremes": _of(lambda s: statistics.extremes(statistics.histogram(s, F.col("txn_type")))),
    "r7_statuses": _of(statistics.statuses),
    "d1_d3_generated": _generated,
    "d4_key_value_workload": lambda spark, sf_dir: generate.key_value_workload(spark, 2000),
}

_S = """WITH s AS (SELECT event_type AS txn_type, epoch_us(ts) * 1000 AS start_ns, round(value * 100)::BIGINT AS latency_us, user_id % 8 AS worker_id,
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_id % 17 = 0 THEN 'RETRY' WHEN event_id % 23 = 0 THEN 'USER_ABORTED' ELSE 'SUCCESS' END AS status FROM events)
"""
_FIGURES = ", ".join(f"l[least(floor({p} * len(l))::BIGINT, len(l) - 1) + 1] AS {n}" for n, p in statistics.SHARES.items())
_LISTS = "SELECT {by} count(*) AS count, round(avg(latency_us), 4) AS mean, round(coalesce(stddev_samp(latency_us), 0), 4) AS stddev, list_sort(list(latency_us)) AS l FROM s {group}"


def _buckets(seconds: int, where: str = "") -> str:
    ns = seconds * 1_000_000_000
    return f""", e AS (SELECT min(start_ns) AS f, max(start_ns) AS t FROM s), g AS (SELECT unnest(range(0, (t - f) // {ns} + 1)) AS bucket FROM e),
l AS (SELECT (start_ns - f) // {ns} AS bucket, count(*) AS count, round(avg(latency_us), 4) AS mean, round(coalesce(stddev_samp(latency_us), 0), 4) AS stddev, list_sort(list(latency_us)) AS l FROM s, e {where} GROUP BY ALL),
b AS (SELECT bucket, count, mean, stddev, {_FIGURES} FROM l)
"""


ORACLES = {
    "r1_distribution": _S + f"SELECT count, mean, stddev, {_FIGURES} FROM ({_LISTS.format(by='', group='')})",
    "r1_distribution_by_type": _S + f"SELECT txn_type, count, mean, stddev, {_FIGURES} FROM ({_LISTS.format(by='txn_type,', group='GROUP BY txn_type')})",
    "r2_time_buckets": _S + _buckets(3600, "WHERE txn_type = 'purchase'") + f"SELECT g.bucket, coalesce(count, 0) AS count, {', '.join(f'coalesce({c}, -1) AS {c}' for c in ('mean', 'stddev', *statistics.SHARES))} FROM g LEFT JOIN b USING (bucket)",
    "r4_result_lines": _S
    + _buckets(3600)
    + f"SELECT g.bucket * 3600 AS time, round(coalesce(count, 0) / 3600, 3) AS throughput, {', '.join(f'round(coalesce({c}, -1) / 1000.0, 3) AS {c}_ms' for c in ('mean', *statistics.SHARES))}, round(1000.0 / coalesce(mean, -1), 3) AS scaled FROM g LEFT JOIN b USING (bucket)",
    "r5_sample_lines": _S
    + _buckets(7200, "WHERE txn_type = 'view'")
    + f"SELECT g.bucket * 7200 AS time, coalesce(count, 0) AS requests, round(coalesce(count, 0) / 7200, 3) AS throughput, {', '.join(f'trunc(coalesce({c}, -1))::BIGINT AS {c}' for c in ('mean', *statistics.SHARES))} FROM g LEFT JOIN b USING (bucket)",
    "r5_raw_lines": _S + "SELECT dense_rank() OVER (ORDER BY txn_type) AS type_index, txn_type, round(start_ns / 1e9, 6) AS start_s, latency_us, worker_id, 0 AS phase_id FROM s",
    "r6_histogram_top": _S + "SELECT worker_id AS value, count(*) AS count FROM s GROUP BY worker_id ORDER BY count DESC, value LIMIT 3",
    "r6_histogram_json": _S + """SELECT '{' || string_agg('"' || txn_type || '":' || n, ',' ORDER BY txn_type) || '}' AS line FROM (SELECT txn_type, count(*) AS n FROM s GROUP BY txn_type)""",
    "s18_run_summary": _S + """SELECT count(*)::DOUBLE AS requests, (max(start_ns) - min(start_ns))::DOUBLE AS elapsed_ns, round(count(*) / (max(start_ns) - min(start_ns)) * 1e9, 9) AS throughput,
round(count(*) FILTER (status = 'SUCCESS') / (max(start_ns) - min(start_ns)) * 1e9, 9) AS goodput, list_sort(list(latency_us))[least(floor(0.99 * count(*))::BIGINT, count(*) - 1) + 1] AS p99 FROM s""",
    "r3_throughput": _S + "SELECT round(count(*) / (max(start_ns) - min(start_ns)) * 1e9, 9) AS throughput, round(count(*) FILTER (status = 'SUCCESS') / (max(start_ns) - min(start_ns)) * 1e9, 9) AS goodput FROM s",
    "r6_histogram_merge": _S + "SELECT txn_type AS value, (count(*) FILTER (worker_id < 4) + count(*) FILTER (worker_id >= 2))::BIGINT AS count FROM s GROUP BY txn_type",
    "r6_histogram_extremes": _S + "SELECT min(n) AS min_count, arg_min(txn_type, (n, txn_type)) AS min_value, max(n) AS max_count, arg_max(txn_type, (n, txn_type)) AS max_value, sum(n)::BIGINT AS total, count(*) AS values FROM (SELECT txn_type, count(*) AS n FROM s GROUP BY txn_type)",
    "r7_statuses": _S + 'SELECT txn_type, ' + ", ".join(f"count(*) FILTER (status = '{k}') AS \"{k}\"" for k in ("SUCCESS", "USER_ABORTED", "RETRY", "RETRY_DIFFERENT", "ERROR", "UNKNOWN")) + " FROM s GROUP BY txn_type",
}
