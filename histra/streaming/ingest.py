"""Operations as a stream: windowed counts with late data, and the latest version of each key kept up by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of operations by event-time window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def latest_versions(events: DataFrame, folder: str, checkpoint: str, keys: int = 20) -> StreamingQuery:
    """Keeps folder/batch=<id> with the newest version of each key after each micro-batch. A batch reads the state before it and
    writes its own folder, so a batch that is run again gives the same state."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        writes = batch.filter("event_type in ('purchase', 'signup')").select(F.concat(F.lit("kv:"), F.col("event_id") % keys).alias("key"), F.col("event_id").alias("value"), "ts")
        if number:
            writes = writes.unionByName(spark.read.parquet(f"{folder}/batch={number - 1}"))
        latest = writes.groupBy("key").agg(F.max(F.struct("ts", "value")).alias("m")).select("key", "m.value", "m.ts")
        latest.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
