"""The corpus pipeline: toxicity, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of the
next. All but the last return the columns of documents; n_chars follows the text.

Defined results, for every stage: a null text counts as empty and passes until mixing, which takes no document without words;
rows without doc_id pass toxicity (judged by their text), keep their lines or lose them like any other, link with nothing, and
are mixed and packed; rows that repeat a doc_id are judged each by its own text, and of rows equal in id and text one is left
by near_duplicates; columns beside those of documents pass through unchanged, whatever their names, up to packing, which
reads doc_id and text alone; an empty table gives empty tables, and without labels nothing is rejected as toxic.

The folders of the stages stand in the session's checkpoint folder; those of earlier stages are removed as soon as the next
stage is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histra.llm import common, jaccard_join, line_dedup, mixing, packing, toxicity


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of its own documents outside the held-out fold; documents that score 0.5 or more go."""
    return toxicity.reject(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later runs of repeated lines go, and documents of which nothing is left."""
    return _counted(line_dedup.without_repeats(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links of 0.8 or more stays."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken whole, and one with its first words for the rest."""
    return _counted(mixing.mixed_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A learned score and a tokenizer are not SQL; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
