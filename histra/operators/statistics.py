"""Statistics of a run's latency samples: (txn_type, start_ns, latency_us, worker_id, phase_id) and a status."""

from __future__ import annotations

import resource
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The shares at which latencies are reported.
SHARES = {"min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}


def samples_of(events: DataFrame) -> DataFrame:
    """The samples that the event table stands for: type, start, latency, worker, and a status."""
    start = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("long")
    status = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_id") % 17 == 0, "RETRY").when(F.col("event_id") % 23 == 0, "USER_ABORTED").otherwise("SUCCESS")
    return events.select(F.col("event_type").alias("txn_type"), start.alias("start_ns"), F.round(F.col("value") * 100).cast("long").alias("latency_us"), (F.col("user_id") % 8).alias("worker_id"), status.alias("status"))


def distribution(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation (0 for one sample) and the latencies at index floor(share * n), at most n - 1, of the
    sorted list; no interpolation. Without samples and without groups every figure is -1.

    Equal latencies are counted first, with map-side combine, so the running sum that finds the percentiles passes over the
    different latencies of a group and not over its samples."""
    by = by or []
    counts = samples.groupBy(*by, "latency_us").agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by).orderBy("latency_us").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    at = lambda share: F.least(F.floor(F.lit(share) * F.col("n")), F.col("n") - 1)
    figures = ranked.groupBy(*by).agg(*[F.min(F.when(F.col("upto") > at(s), F.col("latency_us"))).alias(name) for name, s in SHARES.items()])
    mean, deviation = F.avg("latency_us"), F.coalesce(F.stddev_samp("latency_us"), F.lit(0.0))
    means = samples.groupBy(*by).agg(F.count("*").alias("count"), F.round(mean, 4).alias("mean"), F.round(deviation, 4).alias("stddev"))
    if by:
        return means.join(figures, by)
    both = means.crossJoin(figures)  # one row each
    return both.select("count", *[F.when(F.col("count") == 0, F.lit(-1)).otherwise(F.col(c)).alias(c) for c in ("mean", "stddev", *SHARES)])


def time_buckets(samples: DataFrame, seconds: int, txn_type: str | None = None) -> DataFrame:
    """Tumbling windows from the first sample on, with the distribution of their latencies; empty windows are there too (count 0,
    figures -1). The type filters samples, not windows."""
    width = seconds * 1_000_000_000
    first, last = samples.agg(F.min("start_ns"), F.max("start_ns")).first()
    chosen = samples if txn_type is None else samples.filter(F.col("txn_type") == txn_type)
    placed = chosen.withColumn("bucket", F.floor((F.col("start_ns") - F.lit(first).cast("long")) / width))
    stats = distribution(placed, ["bucket"])
    grid = samples.sparkSession.range(0 if first is None else (last - first) // width + 1).select(F.col("id").alias("bucket"))
    figures = [c for c in stats.columns if c not in ("bucket", "count")]
    return grid.join(stats, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("count"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in figures])


#: Headings of result files.
RESULT_HEADINGS = ("Time (seconds)", "Throughput (requests/second)", "Average Latency (millisecond)", "Minimum Latency (millisecond)", "25th Percentile Latency (millisecond)", "Median Latency (millisecond)", "75th Percentile Latency (millisecond)", "90th Percentile Latency (millisecond)", "95th Percentile Latency (millisecond)", "99th Percentile Latency (millisecond)", "Maximum Latency (millisecond)", "tp (req/s) scaled")
SAMPLE_HEADINGS = ("Time (seconds)", "Requests", "Throughput (requests/second)", "Minimum Latency (microseconds)", "25th Percentile Latency (microseconds)", "Median Latency (microseconds)", "Average Latency (microseconds)", "75th Percentile Latency (microseconds)", "90th Percentile Latency (microseconds)", "95th Percentile Latency (microseconds)", "99th Percentile Latency (microseconds)", "Maximum Latency (microseconds)")
RAW_HEADINGS = ("Transaction Type Index", "Transaction Name", "Start Time (microseconds)", "Latency (microseconds)", "Worker Id (start number)", "Phase Id (index in config file)")


def result_lines(samples: DataFrame, seconds: int, txn_type: str | None = None) -> DataFrame:
    """time, throughput, and latencies of each window in milliseconds, to three places; scaled: 1000 by the mean in microseconds."""
    ms = lambda c: F.round(F.col(c) / 1000.0, 3).alias(f"{c}_ms")
    b = time_buckets(samples, seconds, txn_type)
    return b.select((F.col("bucket") * seconds).alias("time"), F.round(F.col("count") / seconds, 3).alias("throughput"), *[ms(c) for c in ("mean", "min", "p25", "p50", "p75", "p90", "p95", "p99", "max")], F.round(1000.0 / F.col("mean"), 3).alias("scaled"))


def sample_lines(samples: DataFrame, seconds: int = 1, txn_type: str | None = None) -> DataFrame:
    """time, requests, throughput and latencies of each window in whole microseconds."""
    whole = lambda c: F.col(c).cast("long").alias(c)
    b = time_buckets(samples, seconds, txn_type)
    return b.select((F.col("bucket") * seconds).alias("time"), F.col("count").alias("requests"), F.round(F.col("count") / seconds, 3).alias("throughput"), *[whole(c) for c in ("min", "p25", "p50", "mean", "p75", "p90", "p95", "p99", "max")])


def raw_lines(samples: DataFrame) -> DataFrame:
    """One line for each sample; types are numbered from 1 in order of their names."""
    names = samples.select("txn_type").distinct()
    numbered = names.withColumn("type_index", F.row_number().over(Window.orderBy("txn_type")))  # the types of a workload are few
    return samples.join(F.broadcast(numbered), "txn_type").select("type_index", "txn_type", F.round(F.col("start_ns") / 1e9, 6).alias("start_s"), "latency_us", "worker_id", F.lit(0).alias("phase_id"))


def write_csv(lines: DataFrame, headings: tuple[str, ...], path: str, order: list[str]) -> None:
    """A folder of CSV files with these headings; the files' names follow the order."""
    lines.orderBy(*order).toDF(*headings).write.mode("overwrite").option("header", True).csv(path)


def run_summary(samples: DataFrame) -> DataFrame:
    """One row, line: a JSON object of the run's figures."""
    d, t = distribution(samples), throughput(samples)
    n = samples.agg((F.max("start_ns") - F.min("start_ns")).alias("ns"), F.count("*").alias("n"))
    one = d.crossJoin(t).crossJoin(n)  # one row each
    figures = F.struct(*[F.col(c).alias(c) for c in SHARES], F.col("mean"))
    return one.select(F.to_json(F.struct(F.col("ns").alias("elapsed_ns"), F.col("n").alias("requests"), figures.alias("latency"), "throughput", "goodput")).alias("line"))


def throughput(samples: DataFrame) -> DataFrame:
    """Requests and successes a second over the span of the samples."""
    ns = F.max("start_ns") - F.min("start_ns")
    return samples.agg(F.round(F.count("*") / ns * 1e9, 9).alias("throughput"), F.round(F.count_if(F.col("status") == "SUCCESS") / ns * 1e9, 9).alias("goodput"))


def histogram(rows: DataFrame, value: Column, count: Column | None = None) -> DataFrame:
    return rows.groupBy(value.alias("value")).agg(F.sum(count if count is not None else F.lit(1)).alias("count"))


def merge(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """Sum (or, with sign -1, difference) of two histograms; values whose count comes to zero or less go."""
    both = a.unionByName(b.withColumn("count", sign * F.col("count")))
    return both.groupBy("value").agg(F.sum("count").alias("count")).filter("count > 0")


def extremes(h: DataFrame) -> DataFrame:
    low, high = F.min_by("value", F.struct("count", "value")), F.max_by("value", F.struct("count", "value"))
    return h.agg(F.min("count").alias("min_count"), low.alias("min_value"), F.max("count").alias("max_count"), high.alias("max_value"), F.sum("count").alias("total"), F.count("*").alias("values"))


def statuses(samples: DataFrame) -> DataFrame:
    kinds = ["SUCCESS", "USER_ABORTED", "RETRY", "RETRY_DIFFERENT", "ERROR", "UNKNOWN"]
    return samples.groupBy("txn_type").pivot("status", kinds).count().na.fill(0)


def top(h: DataFrame, n: int) -> DataFrame:
    """The n most frequent values of a histogram; ties to the smaller value."""
    return h.orderBy(F.col("count").desc(), "value").limit(n)


def histogram_json(h: DataFrame) -> DataFrame:
    """One row, line: the histogram as a JSON object, values in order. A histogram that is written whole is small by its nature."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("value").cast("string").alias("value"), "count")))
    return h.agg(F.to_json(F.map_from_arrays(F.transform(pairs, lambda p: p["value"]), F.transform(pairs, lambda p: p["count"]))).alias("line"))


#: Lines of a checker's log.
COUNTERS = {"sessions_count": "Sessions count", "transactions_count": "Transactions count", "events_count": "Events count"}


def log_metrics(lines: DataFrame) -> DataFrame:
    """line: text. name and number of timers ("STAGE: 12ms") and counters, and the verdict as a text; other lines give no row."""
    timer = r"^([A-Z0-9_]+):\s+([0-9]+)\s*ms$"
    rows = [lines.filter(F.regexp_like("line", F.lit(timer))).select(F.concat(F.lit("time_"), F.lower(F.regexp_extract("line", timer, 1)), F.lit("_ms")).alias("name"), F.regexp_extract("line", timer, 2).alias("value"))]
    for name, text in COUNTERS.items():
        form = rf"{text}:\s*([0-9]+)"
        rows.append(lines.filter(F.regexp_like("line", F.lit(form))).select(F.lit(name).alias("name"), F.regexp_extract("line", form, 1).alias("value")))
    verdict = r"\[\[\[\[\s*(ACCEPT|REJECT)\s*\]\]\]\]"
    rows.append(lines.filter(F.regexp_like("line", F.lit(verdict))).select(F.lit("actual_verdict").alias("name"), F.regexp_extract("line", verdict, 1).alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


class Stages:
    """Times of named stages on the driver, and the most memory that was seen at their ends."""

    def __init__(self) -> None:
        self.spent: dict[str, float] = {}
        self.since: dict[str, float] = {}
        self.most_mb = 0.0

    def start(self, name: str) -> None:
        self.since[name] = time.perf_counter()

    def end(self, name: str) -> None:
        self.spent[name] = self.spent.get(name, 0.0) + time.perf_counter() - self.since.pop(name)
        self.most_mb = max(self.most_mb, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)

    def lines(self) -> list[str]:
        return [f"{name}: {round(1000 * s)}ms" for name, s in self.spent.items()] + [f"Max memory: {self.most_mb:.0f} MB"]


def settings(spark: SparkSession, prefix: str = "spark.sql.") -> DataFrame:
    """name, value: what a collector of an engine's parameters would store."""
    rows = spark.sql("SET -v").select(F.col("key").alias("name"), "value")
    return rows.filter(F.startswith("name", F.lit(prefix)))
