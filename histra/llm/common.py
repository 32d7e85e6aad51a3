"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the session names; make one only for a session that has none (tests, local runs)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="histra-checkpoint-"))


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and continue from there: later plans neither recompute it nor depend on
    shuffle files of executors that may be lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def no_text_as_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def sums_ahead(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df and, for each of sums, what the rows before this one in the order add up to (0 for the first).

    In two levels, so that no task holds more than a range of the order: sums of the ranges, as many as there are shuffle
    partitions, then sums inside a range. Sums of integers and decimals don't depend on where the ranges are cut.
    """
    dealt = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranges.select("_range", *[F.sum(f"_{name}").over(before).alias(f"_{name}") for name in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(F.broadcast(ahead), "_range")
    none = F.lit(0)
    own = {name: F.coalesce(F.sum(c).over(inside), none) + F.coalesce(F.col(f"_{name}"), none) for name, c in sums.items()}
    return rows.select(*[F.col(c) for c in df.columns], *[c.alias(name) for name, c in own.items()])
