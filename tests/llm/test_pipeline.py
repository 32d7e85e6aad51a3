"""The pipeline's stages, each on what the stage before kept."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    rows, labels = [], []
    for i in range(200):
        bad = i % 10 == 0
        rows.append((i, text(80) + (" you moron idiot " if bad else " ") + text(20), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(bad)))
    rows += [(500, rows[1][1], "en", "s0", 0), (501, rows[1][1] + " tail", "en", "s1", 0), (502, "l one\nl two\nl three\nl four", "en", "s2", 0), (503, "x\nl one\nl two\nl three\nl four\ny", "en", "s2", 0), (504, None, "en", "s3", 0), (505, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        kept[name] = docs.toPandas()
    assert set(kept["toxicity"].doc_id) == {r[0] for r in rows} - set(range(0, 200, 10))
    lines = kept["line_dedup"].set_index("doc_id")
    assert lines.text[503] == "x\ny" and lines.text[502] == rows[-4][1] and lines.n_chars[503] == 3
    assert {500, 501}.isdisjoint(kept["near_duplicates"].doc_id) and 1 in set(kept["near_duplicates"].doc_id)
    mixed = kept["mixing"]
    assert all(any(t == u or u.startswith(t) for u in kept["near_duplicates"].text[kept["near_duplicates"].doc_id == d]) for d, t in zip(mixed.doc_id, mixed.text, strict=True))
    assert kept["packing"].groupby("sequence_id").length.sum().max() <= 2048
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.agg(F.sum("length")).first()[0] == kept["packing"].length.sum()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_ties_repeats_and_clashing_columns(spark, tmp_path):
    rng = random.Random(10)
    text = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    a, b = text(60), text(70)
    rows = [(1, a, None, None), (1, a, None, None), (1, b, "en", "s"), (None, b, None, "s"), (2, None, None, None), (3, "", "en", "s"), (4, a, "en", "t"), (5, "é " * 20, None, "t"), (6, "word " * 30_000, "en", "u")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("size", "taken", "k", "n", "starts", "runs", "score", "_text", "row_hash", "component_id", "shard", "place", "wanted"):
        docs = docs.withColumn(name, F.lit("mine"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now.columns == columns and now.filter("size <> 'mine' or score <> 'mine' or shard <> 'mine'").isEmpty()
        kept[name] = [(r.doc_id, r.text) for r in now.collect()] if name != "packing" else now.toPandas()
    assert len(kept["toxicity"]) == len(rows)
    # The text of 1 stands on one line of over 50 words: its later copies go whole, those of b likewise (ids that are null come first).
    assert sorted(map(str, kept["line_dedup"])) == sorted(map(str, [(1, a), (1, a), (None, b), (2, None), (3, ""), (5, "é " * 20), (6, "word " * 30_000)]))
    assert sorted(map(str, kept["near_duplicates"])) == sorted(map(str, [(1, a), (None, b), (2, None), (3, ""), (5, "é " * 20), (6, "word " * 30_000)]))
    assert {d for d, _ in kept["mixing"]} <= {1, None, 5, 6} and all(t for _, t in kept["mixing"])
    assert kept["packing"].groupby("sequence_id").length.sum().max() <= 2048
