"""License scan by diagonal voting.

Every rolling word k-gram of a text is joined with the k-grams of a fixed list of templates. A hit at word i of the text
and word j of the template votes for the diagonal i - j. Diagonals of one template that lie near each other are merged
(words put in or left out move a match to a neighbouring diagonal), and a merged span is accepted when enough of the
template's k-grams stand in it.

The template table is a constant of the program (a few hundred rows), so it is broadcast; no k-gram of a text is
shuffled, only hits are.

Defined results: a null text counts as empty; a text without words gives n_words 0, no labels and score 0. Rows that
repeat a doc_id with the same text give equal rows; rows with one doc_id and different texts are scanned apart. Only the
columns doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import ascii_lower, no_text_as_empty, table

#: Everything but digits, small ASCII letters and code points from 0x80 on separates words (after ASCII lower-casing).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False


#: The base phrases, which count only word for word.
BASE_TEMPLATES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
#: Sentences of public licenses, matched with gaps; at most 63 words each.
SPAN_TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
)


def template_grams(templates: tuple[Template, ...], k: int) -> list[tuple]:
    rows = []
    for t, template in enumerate(templates):
        words = template.text.split()
        if not k <= len(words) <= 63:
            raise ValueError(f"a template needs {k} to 63 words: {template.text!r}")
        n = len(words) - k + 1
        rows += [(t, template.label, template.exact, n, i, words[i : i + k]) for i in range(n)]
    return rows


def words_of(text):
    """Array of words; split leaves empty strings only at the two ends."""
    return F.array_remove(F.split(ascii_lower(no_text_as_empty(text)), SEPARATORS), "")


def scan(
    docs: DataFrame,
    templates: tuple[Template, ...] = BASE_TEMPLATES + SPAN_TEMPLATES,
    k: int = 2,
    slack: int = 2,
    min_cover: float = 0.75,
) -> DataFrame:
    """Spans: doc_id, text_hash, template, label, exact, first_word, last_word, cover."""
    spark = docs.sparkSession
    schema = "template int, label string, exact boolean, n_grams int, at int, words array<string>"
    grams = spark.createDataFrame(template_grams(templates, k), schema).withColumn("gram", F.xxhash64(*[F.col("words")[i] for i in range(k)]))
    text = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("doc_words"))
    rolling = F.transform(F.col("doc_words"), lambda w, i: F.xxhash64(w, *[F.get("doc_words", i + j) for j in range(1, k)]))
    hits = (
        text.select("doc_id", "text_hash", "doc_words", F.posexplode(rolling).alias("i", "gram"))
        .join(F.broadcast(grams), "gram")
        # equal hashes are compared word by word, so a collision never counts
        .filter(F.slice("doc_words", F.col("i") + 1, k) == F.col("words"))
        .select("doc_id", "text_hash", "template", "label", "exact", "n_grams", "at", (F.col("i") - F.col("at")).alias("diagonal"))
    )
    key = ["doc_id", "text_hash", "template", "label", "exact", "n_grams"]
    votes = hits.groupBy(*key, "diagonal").agg(
        F.expr("bit_or(shiftleft(1L, at))").alias("seen"), F.min("at").alias("low"), F.max("at").alias("high")
    )
    near = Window.partitionBy(*key).orderBy("diagonal")
    opens = (F.col("diagonal") - F.lag("diagonal").over(near) > slack) | F.lag("diagonal").over(near).isNull() | F.col("exact")
    merged = (
        votes.withColumn("span", F.sum(opens.cast("int")).over(near))
        .groupBy(*key, "span")
        .agg(
            F.expr("bit_count(bit_or(seen))").alias("n_seen"),
            F.min(F.col("diagonal") + F.col("low")).alias("first_word"),
            F.max(F.col("diagonal") + F.col("high") + k - 1).alias("last_word"),
        )
    )
    least = F.when(F.col("exact"), F.col("n_grams")).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n_grams") * F.lit(min_cover))))
    return merged.filter(F.col("n_seen") >= least).select(
        "doc_id", "text_hash", "template", "label", "exact", "first_word", "last_word", (F.col("n_seen") / F.col("n_grams")).alias("cover")
    )


def summarise(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """One row for each row of docs."""
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    found = spans.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.count_if("exact").alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first_word"))).cast("long").alias("last_word"),
        labels(F.when(F.col("exact"), F.col("label"))).alias("base_labels"),
        labels("label").alias("labels"),
        F.max("cover").alias("score"),
    )
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(found, counted.doc_id.eqNullSafe(found.d) & (counted.text_hash == found.h), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return summarise(docs, scan(docs))


def oracle_sql(templates: tuple[Template, ...] = BASE_TEMPLATES + SPAN_TEMPLATES, k: int = 2, slack: int = 2, min_cover: float = 0.75) -> str:
    rows = ", ".join(
        f"({t}, '{label}', {str(exact).lower()}, {n}, {at}, '{' '.join(words)}')" for t, label, exact, n, at, words in template_grams(templates, k)
    )
    return f"""
WITH grams(template, label, exact, n_grams, place, gram) AS (VALUES {rows}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
flat AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM w),
pairs AS (SELECT doc_id, i, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS gram FROM flat),
votes AS (SELECT p.doc_id, g.template, g.label, g.exact, g.n_grams, p.i - g.place AS diagonal, bit_or(1::BIGINT << g.place) AS seen, min(g.place) AS low, max(g.place) AS high
          FROM pairs p JOIN grams g USING (gram) GROUP BY ALL),
marked AS (SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER n > {slack}, true) THEN 1 ELSE 0 END AS opens FROM votes WINDOW n AS (PARTITION BY doc_id, template ORDER BY diagonal)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM marked),
merged AS (SELECT doc_id, template, label, exact, n_grams, span, bit_count(bit_or(seen)) AS n_seen, min(diagonal + low) AS first_word FROM numbered GROUP BY ALL),
spans AS (SELECT *, n_seen / n_grams::DOUBLE AS cover FROM merged WHERE n_seen >= CASE WHEN exact THEN n_grams ELSE greatest(1, ceil(n_grams * {min_cover}::DOUBLE)) END),
found AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(first_word) FILTER (exact) AS first_word, max(first_word) FILTER (exact) AS last_word,
                 array_to_string(list_sort(list_distinct(list(label) FILTER (exact))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(cover) AS score
          FROM spans GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN found USING (doc_id)"""
