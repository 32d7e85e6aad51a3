"""Running one SQL text against the tables of a directory."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "benchmark", "pages", "conversations", "embeddings")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, text: str, args: dict | None = None) -> DataFrame:
    """The text's tables are bound as DataFrames, so no view is left in the session and several directories can be used at
    once. Catalyst plans the whole text: filters and columns reach the Parquet scans, dimension tables are broadcast by size."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    bound = re.sub(r"\b(from|join|,)(\s+)(" + "|".join(used) + r")\b", lambda m: f"{m[1]}{m[2]}{{{m[3]}}}", text, flags=re.IGNORECASE) if used else text
    kept = {t: read(spark, sf_dir, t) for t in used if f"{{{t}}}" in bound}
    return spark.sql(bound, args=args or {}, **kept)
