"""Each operator against a plain version of its contract, on small tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from histra.llm import common, fingerprint, jaccard_join, license_scan, line_dedup, mixing, packing, suffix_dedup, textnum, toxicity, url_filter, vp_search

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return BLANK.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}{rng.choice(['', '.', ','])}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(1, 150)) for _ in range(40)]
    passage = prose(rng, 90)
    texts = list(base)
    texts += [base[3], base[3], base[5]]
    for _ in range(12):
        near = base[7].split(" ")
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(6)]
    texts += ["\n".join(["same line here", "another line", "third line", f"own {i}", "same line here", "another line", "third line"]) for i in range(3)]
    texts += [None, "", "   ", "a", "é ü 日本 text", "x" * 3000, "Released under the MIT License. Licensed under the Apache License, Version 2.0.", "a\n\n\nb\n \nc\nd"]
    return pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": [["b", "a", None, "ä"][i % 4] for i in range(len(texts))], "n_chars": [len(t or "") for t in texts]})


@pytest.fixture(scope="module")
def docs(spark, corpus):
    # Columns whose names an operator might use itself.
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit(1)).withColumn("id", F.lit(2)).withColumn("n", F.lit(3)).withColumn("starts", F.lit(4)).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_fingerprints(spark, corpus, docs):
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = fingerprint.fingerprints(texts, ["doc_id"]).select("doc_id", fingerprint.as_string(F.col("fp_text")).alias("f"))
    by_text = {}
    for r in found.collect():
        by_text.setdefault(corpus.text[r.doc_id] or "", set()).add(r.f)
    assert all(len(x) == 1 for x in by_text.values())
    assert len({next(iter(x)) for t, x in by_text.items()}) == len({tuple(sorted(Counter(p for p in t.split("\n") if p).items())) for t in by_text})
    pairs = fingerprint.with_next(docs).toPandas().set_index("doc_id")
    ids = sorted(corpus.doc_id, reverse=True)
    assert [pairs.next_id[i] for i in ids] == [*ids[1:], ids[0]]


@pytest.mark.parametrize("ids", ["far", "one", "none", "whole range", "repeated"])
def test_next_document_whatever_the_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprint, "BLOCK_ROWS", 8)
    number = {"far": lambda i: i if i else (1 << 63) - 1, "one": lambda i: 7, "none": lambda i: None if i % 3 else i, "whole range": lambda i: (i - 100) * ((1 << 63) // 100), "repeated": lambda i: i // 40}[ids]
    rows = [(max(min(x, (1 << 63) - 1), -(1 << 63)) if (x := number(i)) is not None else None, f"text {i}") for i in range(201)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = fingerprint.with_next(df).withColumn("block_rows", F.lit(1)).collect()
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    assert {r.text: (r.next_id, r.next_text) for r in found} == {a[1]: b for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    cuts = spark.createDataFrame([(x,) for x in "bdfhj"], "p string").select("p", fingerprint._block(F.col("p"), ["b", "d", "f", "g"]).alias("n"))
    assert [r.n for r in cuts.orderBy("p").collect()] == [1, 2, 3, 4, 4]


def pairs_of(text):
    out = Counter()
    for paragraph in (text or "").split("\n"):
        w = [x for x in paragraph.split(" ") if x]
        out.update(zip(w, [*w[1:], None], strict=True))
    return out


def test_likeness_is_that_of_the_word_pairs(spark):
    rng = random.Random(31)
    base = prose(rng, 400, 5000).split(" ")
    rows = []
    for k, share in enumerate((0.0, 0.05, 0.2, 0.5, 0.8, 1.0)):
        rows.append((k, " ".join(base), " ".join(w if rng.random() >= share else f"new{rng.randint(0, 10**6)}" for w in base)))
    df = spark.createDataFrame(rows, "k long, text string, changed string")
    fp = fingerprint.fingerprints(df, ["k"], ("text", "changed")).select("k", fingerprint.likeness(F.col("fp_text"), F.col("fp_changed")).alias("near"))
    got = {r.k: r.near for r in fp.collect()}
    for k, a, b in rows:
        x, y = pairs_of(a), pairs_of(b)
        apart = sum((x[p] - y[p]) ** 2 for p in x | y)
        exact = max(0.0, 1 - apart / (sum(n * n for n in x.values()) + sum(n * n for n in y.values())))
        # 63 lanes: the estimate of |A - B|^2 has a deviation of about sqrt(2 / 63) of itself.
        assert abs(got[k] - exact) <= 4 * (2 / 63) ** 0.5 * (1 - exact) + 1e-9, (k, got[k], exact)


def test_fingerprint_is_homomorphic(spark):
    rows = [("a", "one two\nthree four"), ("b", "five six seven"), ("c", "five six seven\none two\nthree four")]
    fp = {r.k: r.fp_text for r in fingerprint.fingerprints(spark.createDataFrame(rows, "k string, text string"), ["k"]).collect()}
    joined = spark.createDataFrame([(fp["a"], fp["b"], fp["c"])], spark.createDataFrame([(fp["a"],)], fingerprint.fingerprints(spark.createDataFrame(rows, "k string, text string"), ["k"]).select("fp_text").schema).selectExpr("fp_text a", "fp_text b", "fp_text c").schema)
    out = joined.select((fingerprint.add(F.col("a"), F.col("b")) == F.col("c")).alias("plus"), (fingerprint.subtract(F.col("c"), F.col("b")) == F.col("a")).alias("minus"), fingerprint.likeness(F.col("a"), F.col("a")).alias("same")).first()
    assert out.plus and out.minus and out.same == 1.0


def test_fingerprints_of_very_long_texts(spark):
    rng = random.Random(1)
    # As expressions, so that no text of this size is sent along.
    long_one = F.repeat(F.lit("In. "), 5_000_000)
    prose_of = F.lit(prose(rng, 300) + "\n")
    texts = spark.range(4).select(F.col("id").alias("k"), F.when(F.col("id") == 0, long_one).when(F.col("id") == 1, prose_of).when(F.col("id") == 2, F.concat(long_one, F.lit("\n"), prose_of)).otherwise("In. In.").alias("text"))
    fp = common.materialise(fingerprint.fingerprints(texts, ["k"]).orderBy("k"))
    rows = [r.fp_text for r in fp.collect()]
    assert [r.n_pairs for r in rows] == [5_000_000, 300, 5_000_300, 2] and all(x is not None for r in rows for x in r.sketch)
    lanes = lambda r: [x >> low & fingerprint.LANE for x in r.sketch for low in (0, 21, 42)]
    # All pairs of the text but the last are equal: a lane counts all of them or none.
    assert {min((x - y) % (1 << 21) for y in (0, 4_999_999)) for x in lanes(rows[0])} <= {0, 1}
    assert [(x + y) % (1 << 21) for x, y in zip(lanes(rows[0]), lanes(rows[1]), strict=True)] == lanes(rows[2])
    pair = fp.select(F.col("k").alias("a"), F.col("fp_text").alias("x")).crossJoin(fp.select(F.col("k").alias("b"), F.col("fp_text").alias("y")))
    near = {(r.a, r.b): r.near for r in pair.select("a", "b", fingerprint.likeness(F.col("x"), F.col("y")).alias("near")).collect()}
    assert near[0, 1] == near[0, 3] == near[2, 1] == 0.0 and near[0, 0] == 1.0 and near[0, 2] > 0.9
    union = fp.groupBy().agg(*[F.max(F.when(F.col("k") == k, F.col("fp_text"))).alias(f"f{k}") for k in range(3)])
    out = union.select((fingerprint.add(F.col("f0"), F.col("f1")) == F.col("f2")).alias("plus"), (fingerprint.subtract(F.col("f2"), F.col("f0")) == F.col("f1")).alias("minus")).first()
    assert out.plus and out.minus


def test_fingerprint_query_edits(spark, corpus, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint.op2_fingerprint(spark, str(tmp_path)).toPandas().set_index("doc_id")
    ids = sorted(corpus.doc_id, reverse=True)
    text = {i: corpus.text[i] or "" for i in ids}
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        half = len(text[a]) // 2
        changed = text[a][: len(text[a]) - half] + text[b][:half]
        assert got.edited_sha256[a] == hashlib.sha256(changed.encode()).hexdigest()
        assert got.n_chars[a] == len(text[a])
    assert ((got.near_edited >= 0) & (got.near_edited <= 1) & (got.near_next >= 0) & (got.near_next <= 1)).all()


@pytest.mark.parametrize(("length", "pick", "most"), [(400, 192, 20_000), (60, 30, 20_000), (60, 30, 2), (20, 7, 1)])
def test_suffix_dedup(corpus, docs, length, pick, most):
    got = suffix_dedup.dedup(docs, length, pick, most).toPandas().set_index("doc_id")
    data = {i: (t or "").encode() for i, t in zip(corpus.doc_id, corpus.text, strict=True)}
    seen = Counter(b[s : s + length] for b in data.values() for s in range(len(b) - length + 1))
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        assert tuple(got.loc[i, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]]) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_of_very_many_surroundings(spark):
    # One passage in 120 surroundings of different lengths, in buckets of at most 5 pieces: several rounds of halving.
    rng = random.Random(20)
    passage = prose(rng, 40, 9000)
    texts = [prose(rng, rng.randint(0, 6), 3) + passage + prose(rng, rng.randint(0, 6), 3) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for length, pick in ((120, 80), (400, 192)):
        got = suffix_dedup.dedup(df, length, pick, 5).toPandas().set_index("doc_id")
        data = [t.encode() for t in texts]
        seen = Counter(b[s : s + length] for b in data for s in range(len(b) - length + 1))
        for i, b in enumerate(data):
            gone = np.zeros(len(b), bool)
            for s in range(len(b) - length + 1):
                if seen[b[s : s + length]] > 1:
                    gone[s : s + length] = True
            assert got.n_removed[i] == gone.sum()


@pytest.mark.parametrize("share", [1000, 3])
def test_suffix_dedup_with_hot_buckets(corpus, docs, monkeypatch, share):
    monkeypatch.setattr(suffix_dedup, "SAMPLE_EVERY", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 2)
    plain = {tuple(r) for r in suffix_dedup.dedup(docs, 60, 30).collect()}
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", share)
    monkeypatch.setattr(suffix_dedup, "SALTS", 5)
    assert {tuple(r) for r in suffix_dedup.dedup(docs, 60, 30).collect()} == plain
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 1 << 40)
    assert {tuple(r) for r in suffix_dedup.dedup(docs, 60, 30).collect()} == plain


def test_suffix_dedup_tells_rows_apart(spark):
    a, b = prose(random.Random(1), 100, 9000), prose(random.Random(2), 100, 9000)
    df = spark.createDataFrame([(None, a), (None, b), (5, a), (5, b[:300]), ((1 << 63) - 1, b), (-(1 << 63), "")], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(df).collect())
    assert got == sorted([(len(a), len(a)), (len(a), len(a)), (len(b), len(b)), (len(b), len(b)), (300, 0), (0, 0)])
    named = suffix_dedup.dedup(df.withColumn("doc_id", F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("x")))))
    assert sorted((r.n_bytes, r.n_removed) for r in named.collect()) == got


def thue_morse(n, a, b):
    out = a
    for _ in range(n):
        out += out.translate(str.maketrans(a + b, b + a))
    return out


def test_hashes_withstand_regular_texts(spark):
    one, other = thue_morse(12, "a", "b"), thue_morse(12, "b", "a")
    rows = [(1, one), (2, other), (3, f"x {one} y z u v w"), (4, f"x {other} y z u v w"), (5, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.components(df).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    data = np.frombuffer((one[:1024] + other[:1024]).encode(), np.uint8)
    stretches = textnum.Stretches(data)
    a, b = (x(np.array([0, 1024]), np.array([1024, 2048])) for x in (stretches.plain, stretches.prime))
    assert a[0] == a[1] and b[0] != b[1]  # the plain lane's known weakness, which the others do not share


def units(text):
    out = []
    for line in text.split("\n"):
        if out and not line.strip(" \t\x0b\f\r"):
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out


@pytest.mark.parametrize(("window", "long_words"), [(1, None), (3, None), (4, None), (3, 50), (4, 7), (2, 1)])
def test_line_dedup(corpus, docs, window, long_words):
    got = line_dedup.dedup(docs, window, long_words).toPandas().set_index("doc_id")
    seen = set()
    for i, text in zip(corpus.doc_id, corpus.text, strict=True):
        if text is None:
            assert got.text[i] is None and got.n_lines[i] == 0
            continue
        lines, gone = units(text), set()
        for width in range(1 if long_words else window, window + 1):
            for s in range(len(lines) - width + 1):
                if width < window and sum(len(words(x)) for x in lines[s : s + width]) <= long_words:
                    continue
                key = tuple(x.strip(" ") for x in lines[s : s + width])
                if key in seen:
                    gone.update(range(s, s + width))
                seen.add(key)
        assert got.text[i] == "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert (got.n_lines[i], got.n_removed[i]) == (len(lines), len(gone))
        assert got.n_runs[i] == sum(k - 1 not in gone for k in gone)


def test_line_dedup_of_long_passages(spark):
    rng = random.Random(6)
    one, left, right, short = prose(rng, 60, 9000), prose(rng, 30, 9000), prose(rng, 30, 9000), prose(rng, 20, 9000)
    texts = [f"a\n{one}\nb", f"{left}\n{right}\nc\n{short}\nd", f"e\n{one}\nf", f"g\n{left}\n{right}\nh", f"i\n{short}\nj", one, f"{left}\n{right}", f"{left}\nk"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = line_dedup.dedup(docs, long_words=50).toPandas().set_index("doc_id").text
    assert got.sort_index().tolist() == [texts[0], texts[1], "e\nf", "g\nh", texts[4], "", "", texts[7]]
    kept = line_dedup.without_repeats(docs).toPandas().set_index("doc_id").text
    assert kept.sort_index().to_dict() == {0: texts[0], 1: texts[1], 2: "e\nf", 3: "g\nh", 4: texts[4], 7: texts[7]}


def test_line_dedup_shuffles_fewer_rows_than_windows(spark):
    rng = random.Random(21)
    texts = ["\n".join(prose(rng, 5, 9000) for _ in range(60)) for _ in range(50)]
    shared = "\n".join(prose(rng, 5, 9000) for _ in range(9))
    texts = [f"{t}\n{shared}" if i % 10 == 0 else t for i, t in enumerate(texts)]
    lines = line_dedup.line_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), False)
    windows = lines.agg(F.sum(F.size("hashes") - 2)).first()[0]
    places = line_dedup.fingerprints(lines, 3, None)
    # Winnowing's density is 2 / (w + 1); a place stands for one to three windows, and all windows have theirs.
    assert 0.4 * windows < places.count() < 0.6 * windows
    assert places.agg(F.sum(F.size("windows")), F.max(F.size("windows"))).first() == (windows, 3)


def test_line_dedup_of_a_very_long_text(spark):
    # 60,000 lines, a third of them in repeated runs: time in proportion to the lines.
    lines = F.transform(F.sequence(F.lit(0), F.lit(59_999)), lambda i: F.concat(F.lit("line "), F.when(i % 9 < 3, i % 9).otherwise(i).cast("string")))
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(lines, "\n").alias("text"))
    row = line_dedup.dedup(df).first()
    assert (row.n_lines, row.n_removed, row.n_runs) == (60_000, 3 * (-(-60_000 // 9) - 1), -(-60_000 // 9) - 1)


def shingles(text):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("long_list", [128, 1])
def test_jaccard_join(corpus, docs, monkeypatch, long_list):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", long_list)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    got = jaccard_join.components(docs).toPandas().set_index("doc_id")
    sets = [shingles(t) for t in corpus.text]
    label = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got.n_shingles.sort_index().tolist() == [len(s) for s in sets]
    assert got.component_id.sort_index().tolist() == label


def test_one_of_each_keeps_rows_apart(spark):
    rng = random.Random(23)
    a, b, c = prose(rng, 60, 9000), prose(rng, 60, 9000), prose(rng, 60, 9000)
    rows = [(5, a), (5, b), (2, a + " tail"), (5, a), (7, c), (7, c), (None, a), (None, a), (8, None), (8, ""), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_hash", F.lit("mine")).repartition(3)
    got = jaccard_join.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted([("5", b), ("2", a + " tail"), ("7", c), ("None", a), ("None", a), ("8", ""), ("8", ""), ("9", "")])


def test_jaccard_bound_never_below_truth():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.uniform(0.7, 1)], rng.integers(0, 1 << 63, int(rng.integers(0, 40)), dtype=np.uint64))))
        common = len(np.intersect1d(a, b))
        if 5 * common >= 4 * (len(a) + len(b) - common):
            assert jaccard_join.may_link(jaccard_join.counted_cells(a), jaccard_join.counted_cells(b))


def test_mixing(corpus, docs):
    got = mixing.mix(mixing.materialise(mixing.sized(docs))).toPandas().set_index("doc_id")
    size = [len(words(t)) for t in corpus.text]
    assert got["size"].sort_index().tolist() == size
    totals = Counter()
    for s, n in zip(corpus.source, size, strict=True):
        totals[s] += n
    names = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full = {s: 0.0 for s in names}, set()
    while True:
        rest = sum(size) - sum(3 * totals[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: 3 * totals[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in names}
        above = {s for s in open_ if target[s] > 3 * totals[s]}
        if not above:
            break
        full |= above
    for i, s in enumerate(corpus.source):
        assert got.target[i] == pytest.approx(target[s])
        assert got.source_size[i] == totals[s] and got.taken[i] <= 3 * size[i]
    for s in names:
        taken = sum(got.taken[i] for i, x in enumerate(corpus.source) if x == s)
        assert abs(taken - target[s]) <= max(8, 0.02 * target[s])
    again = mixing.mix(mixing.materialise(mixing.sized(docs.repartition(7)))).toPandas().set_index("doc_id")
    assert again.taken.sort_index().tolist() == got.taken.sort_index().tolist()


def test_mixing_counts_points():
    for n in (0, 1, 7, 1000, 4321):
        points = [i * mixing.GOLDEN % mixing.FULL for i in range(n)]
        for mark in (0, 1, mixing.GOLDEN, mixing.GOLDEN + 1, mixing.FULL // 3, mixing.FULL - 1, mixing.FULL):
            assert mixing.points_below(n, mark) == sum(p < mark for p in points)


def test_mixing_small_sources_beside_a_huge_one(spark):
    rows = [(0, "big", 5_000_000_000)] + [(1 + k, f"tiny{k:02}", size) for k, size in enumerate([300, 1000, 3000, 12_000] * 10)]
    rows += [(100 + k, "many", 3) for k in range(100)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).toPandas()
    by_source = got.groupby("source").agg({"taken": "sum", "target": "first"})
    assert ((by_source.taken - by_source.target).abs() <= 8).all()
    assert (got.taken <= 3 * got["size"]).all()


def test_mixing_of_very_many_sources(spark):
    rows = [(i, f"host{i % 3000:04}", 1 + i % 7) for i in range(9000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    targets = mixing.source_targets(sizes).toPandas().sort_values("sid")
    assert targets.source.tolist() == sorted({r[1] for r in rows}) and targets.sid.tolist() == list(range(3000))
    assert targets.low.tolist() == [0, *targets.high.tolist()[:-1]] and targets.high.iloc[-1] >= mixing.FULL - 10
    assert targets.target.sum() == pytest.approx(sum(r[2] for r in rows)) and (targets.target <= 3 * targets.source_size + 1e-6).all()


def test_mixed_documents_of_repeated_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "d e f", "x"), (None, "g h", None), (None, "g h", None), (2, "i", "y"), (2, "i", "x"), (3, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(0)).withColumn("k", F.lit("k")).repartition(3)
    shares = mixing.mix(mixing.materialise(mixing.sized(docs)))
    given = shares.groupBy("doc_id", "row_hash").agg(F.sum("taken").alias("n")).filter("n > 0").collect()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    by_key = mixed.groupBy("doc_id", "source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).toPandas()
    assert by_key.n.sum() == sum(r.n for r in given)
    taken = shares.groupBy("doc_id", "source").agg(F.sum("taken").alias("n")).filter("n > 0").toPandas()
    key = lambda d: sorted((str(a), str(b), int(n)) for a, b, n in d.itertuples(index=False))
    assert key(by_key) == key(taken)


def test_license_scan(corpus, docs):
    got = license_scan.summarise(docs, license_scan.scan(docs)).toPandas().set_index("doc_id")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, text in zip(corpus.doc_id, corpus.text, strict=True):
        w = pattern.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        places = [(s, t.label) for t in license_scan.BASE_TEMPLATES for s in range(len(w)) if w[s : s + len(t.text.split())] == t.text.split()]
        assert got.n_words[i] == len(w) and got.n_base[i] == len(places)
        assert got.base_labels[i] == ",".join(sorted({x for _, x in places}))
        assert set(got.base_labels[i].split(",")) <= set(got.labels[i].split(","))
        if places:
            assert (got.first_word[i], got.last_word[i]) == (min(places)[0], max(places)[0]) and got.score[i] == 1.0


def test_license_scan_bridges_gaps(spark):
    text = "x y Redistribution and use in source and also binary forms, with or without modification, are permitted provided that conditions are met"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert license_scan.summarise(df, license_scan.scan(df)).first().labels == "bsd"


def test_packing(corpus, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in zip(corpus.doc_id, corpus.text, strict=True)}
    got = packing.pack(docs).toPandas()
    for i, rows in got.groupby("doc_id"):
        at = 0
        for r in rows.sort_values("start").itertuples():
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    assert set(got.doc_id) == set(ids)
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum()[:-1]] and rows.length.sum() <= 2048
    again = packing.pack(docs.repartition(5)).toPandas()
    assert sorted(again.itertuples(index=False)) == sorted(got.itertuples(index=False))


def test_packing_words_equal_whole_texts():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    pieces = ["it's", "We'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "naïve", "é", "Σίσυφος", "İx", "日本", "12,5", "a\x01b", "\x1c", "\t", "\xa0", "²", "x" * 50, "--", "...", "end.", "#tag"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "\n", "", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    path = packing.tokenizer_path()
    whole = Tokenizer.from_file(path)
    assert packing.WordTokenizer(path).encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_neighbours_share_windows():
    rng = np.random.default_rng(2)
    topics = [np.arange(k * 100, k * 100 + 100) for k in range(4)]
    docs = [rng.choice(topics[i % 4], 200).astype(np.uint32) for i in range(80)]
    rows = list(packing.pack_shard(docs))
    mates = {}
    for d, _, n, s, _ in rows:
        mates.setdefault(s, Counter())[d % 4] += n
    assert np.mean([max(c.values()) / sum(c.values()) for c in mates.values()]) > 0.8


def test_vp_search(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 12)).round(3)
    x[50:150] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 12), (602, [float("nan")] * 12), (603, []), (620, [None] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kind", F.lit(9)).repartition(3)
    exact = []
    for q in range(0, 600, 20):
        s = [(-float((x[q] * x[j]).sum()), j) for j in range(600) if j != q]
        exact += [(q, r + 1, j) for r, (_, j) in enumerate(sorted((round(a, 9), j) for a, j in s)[:20])]
    got = vp_search.search(df, factor=1.0, shard_rows=200).toPandas()
    assert sorted(got[["query_id", "rank", "vec_id"]].itertuples(index=False, name=None)) == sorted(exact)
    found = vp_search.search(df, shard_rows=200)
    truth = spark.createDataFrame([(q, j) for q, _, j in exact], "query_id long, vec_id long")
    assert vp_search.recall(found, truth) >= 0.9
    loose, tight = (vp_search.search(df, factor=f, shard_rows=200).agg(F.sum("looked_at")).first()[0] for f in (20.0, 1.0))
    assert loose < tight


def test_packing_brings_near_copies_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 32)
    monkeypatch.setattr(packing, "SHARD_CHARS", 320_000)
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    texts = [rng.choices(vocabulary, k=80) for _ in range(400)]
    near = [[*t[:20], "changed", *t[21:]] for t in texts]
    df = spark.createDataFrame(list(enumerate(" ".join(t) for t in texts + near)), "doc_id long, text string")
    got = packing.pack(df).toPandas()
    shard = got.groupby("doc_id").shard.first()
    sizes = shard.value_counts()
    assert len(sizes) >= 20 and sizes.max() <= 64
    assert np.mean([shard[i] == shard[i + 400] for i in range(400)]) > 0.8
    windows = got.groupby("doc_id").sequence_id.agg(set)
    assert np.mean([bool(windows[i] & windows[i + 400]) for i in range(400)]) > 0.75


def test_packing_counts_over_all_documents(spark):
    docs = [np.array(x, "<u2") for x in ([5, 5, 7, 1], [7, 9, 1], [5, 1], [1])]
    rows = [(i, i, 0, len(d), bytearray(d.tobytes())) for i, d in enumerate(docs)]
    whole = packing.statistics(spark.createDataFrame(rows, packing.TOKENS).repartition(3))
    assert (whole.n, whole.mean) == (4, 2.5) and {t: int(whole.df[t]) for t in np.flatnonzero(whole.df)} == {1: 4, 5: 2, 7: 2, 9: 1}


def test_packing_asks_with_all_terms_and_keeps_all_neighbours():
    # The seed shares each of its 30 terms with one document, and its last with ten more.
    seed = np.repeat(np.arange(100, 130), 2)
    helpers = [np.array([100 + k, 500 + k]) for k in range(30)]
    mates = [np.array([129, 129, 129]) for _ in range(10)]
    docs = [d.astype(np.uint32) for d in [seed, *helpers, *mates]]
    index = packing.Index(docs, packing.statistics_of(docs))
    assert len(index.nearest(0, np.arange(len(docs)) == 0)) == len(docs) - 1


@pytest.mark.parametrize("scale", [1e-120, 1e-7, 1.0, 1e7])
def test_vp_search_at_any_scale(spark, scale):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(2000, 16)) * scale
    x[300:340] = x[5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vp_search.search(df, shard_rows=500).toPandas()
    for q, rows in got.groupby("query_id"):
        score = (x[q] * x).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(2000), -score)) if j != q][:20]
        rows = rows.sort_values("rank")
        assert rows.vec_id.tolist() == order and rows["rank"].tolist() == list(range(1, 21))
        assert rows.score.tolist() == score[order].tolist()


def test_vp_search_with_repeated_rows(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    once = vp_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    twice = vp_search.search(spark.createDataFrame(rows + rows, "vec_id long, embedding array<double>"))
    key = ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, once.select(key).collect())) == sorted(map(tuple, twice.select(key).collect()))
    # An id with two vectors: both are candidates.
    both = vp_search.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (0, [3.0, 0.0])], "vec_id long, embedding array<double>"))
    assert [(r.query_id, r.vec_id, r.score) for r in both.orderBy("rank").collect()] == [(0, 1, 6.0), (0, 1, 3.0)]


def test_vp_search_query_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    ok = [(int(i), np.array(v, float)) for i, v in zip(rows.vec_id, rows.embedding, strict=True) if v is not None and np.isfinite(np.array(v, float)).all() and np.any(v)]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    got = vp_search.op1_vp_search(spark, "/root/testdata/sf0.01").toPandas()
    asked = [(i, v) for i, v in ok if i % 20 == 0]
    assert set(got.query_id) == {i for i, _ in asked}
    for q, v in asked:
        score = (v * x).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:20]
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == ids[order].tolist()


@pytest.mark.parametrize("norms", ["one long", "lognormal"])
def test_vp_search_with_unequal_norms(spark, norms):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= np.where(np.arange(1500) == 7, 10.0, 1.0)[:, None] if norms == "one long" else rng.lognormal(0, 0.5, 1500)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = range(0, 1500, 20)
    scores = x[list(asked)] @ x.T
    scores[np.arange(len(asked)), list(asked)] = -np.inf
    exact = [(q, int(j)) for q, s in zip(asked, scores, strict=True) for j in np.argsort(-s)[:20]]
    assert vp_search.recall(vp_search.search(df), spark.createDataFrame(exact, "query_id long, vec_id long")) == 1.0


def test_lexicon_matches_edit_distance():
    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    rng = random.Random(6)
    terms = ["moron", "idiot", "morons", "scum", "trash"]
    lexicon = toxicity.Lexicon(terms)
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            p = rng.randrange(len(w) + 1)
            rng.choice([lambda p=p: w.insert(p, rng.choice("morixs")), lambda p=p: w and w.pop(min(p, len(w) - 1)), lambda p=p: w.__setitem__(slice(p, p + 1), [rng.choice("moidt")])])()
        word = "".join(w)
        expected = 2 if word in terms else int(any(len(t) >= 5 and near(word, t) for t in terms))
        assert lexicon.match(word) == expected, word


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = prose(rng, 40) + (" you are a moron and an idiot " if bad else " ") + prose(rng, 10)
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (902, "such a mor0n, a real idiiot you moron"), (903, "good words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {"moron", "idiot"} <= set(model.terms)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(400))
    assert got[902] >= 0.5 and got[903] < 0.5 and got[900] == got[901] < 0.5
    assert {r.doc_id for r in toxicity.reject(docs, model).collect()} == {i for i in got if got[i] < 0.5}
    blank = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in toxicity.score(docs, blank, ["doc_id"]).collect()} == {0.5}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_features(text, terms):
    """Features by their definition: every word against every term, without trie, automaton or table."""
    strip = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w)
    w = text.lower().split()
    counts, exact = {}, 0

    def kind(word):
        if word in terms:
            return 2
        return int(len(word) >= 4 and any(len(t) >= 5 and edits(word, t) <= 1 for t in terms))

    for i, raw in enumerate(w):
        found = kind(strip(raw))
        if found < 2 and not strip(raw).isalpha():
            found = max(found, min(1, kind(strip(raw.translate(str.maketrans("0134578@$!", "oieastbasi"))))))
        if not found:
            continue
        before, after = w[max(0, i - 6) : i], w[i + 1 : i + 7]
        around = {strip(x) for x in before + after}
        marks = "\"“”«»„‘’"
        quoted = any(c in marks for x in [*before, raw] for c in x) and any(c in marks for x in [raw, *after] for c in x)
        where = "quoted" if quoted or around & toxicity.REPORT else "aimed" if around & toxicity.ADDRESS else "plain"
        counts[where, found] = counts.get((where, found), 0) + 1
        exact += found == 2
    logs = [np.log1p(counts.get((c, f), 0)) for f in (2, 1) for c in ("plain", "quoted", "aimed")]
    return [*logs, float(exact > 0), np.log1p(1000 * exact / len(w)) if exact else 0.0]


def test_toxicity_against_a_plain_version(spark):
    rng = random.Random(18)
    terms = ["moron", "idiot", "scum", "trash", "vermin"]
    bits = [*terms, "mor0n", "idi0t!", "idiots", "moronn", "scums", "tr4sh", "you", "said", '"moron"', "“idiot”", "the", "a", "house", "ver-min", "vermin.", "VERMIN", "$cum", "", "tras", "tra"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["", "   ", "moron", '"', "x" * 5000 + " moron"]
    reader = toxicity.Reader(terms)
    for t in texts:
        assert reader.features(t) == pytest.approx(plain_features(t, terms)), t
    model = toxicity.Model(tuple(terms), (0.5, -1.0, 2.0, 0.25, -0.5, 1.5, 0.75, 0.1, -2.0))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9000, None), (9000, None)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in toxicity.score(df, model, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        z = float(np.dot(plain_features(t, terms), model.weights[:-1])) + model.weights[-1]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)))
    assert toxicity.score(df, model, ["doc_id"]).filter("doc_id = 9000").count() == 2
    # The regression itself, against a plain search: its weights leave no better place nearby.
    x, y = np.array([plain_features(t, terms) for t in texts]), np.array([rng.random() < 0.3 for _ in texts], float)
    w = toxicity.fit(x, y)

    def loss(v):
        p = 1 / (1 + np.exp(-(x @ v[:-1] + v[-1])))
        return -np.sum(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.5 * np.sum(v[:-1] ** 2) + np.log1p(np.exp(-v[-1])) + np.log1p(np.exp(v[-1]))

    assert all(loss(w) <= loss(w + 1e-3 * rng2) + 1e-9 for rng2 in np.random.default_rng(1).normal(size=(200, len(w))))


def test_toxicity_without_documents_or_labels(spark, nothing):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(nothing, labels)
    assert toxicity.score(nothing, model, ["doc_id"]).count() == 0 and toxicity.reject(nothing, model).count() == 0
    docs = spark.createDataFrame([(1, "a moron"), (1, "a moron"), (2, None), (None, "x")], "doc_id long, text string")
    assert toxicity.reject(docs, toxicity.train(docs, labels.limit(0))).count() == 4


def test_quotation_is_set_apart():
    reader = toxicity.Reader(["moron"])
    plain, quoted = reader.features("you are such a moron today"), reader.features('the witness said "moron" in court')
    assert plain[2] > 0 and quoted[1] > 0 and quoted[2] == 0


def test_url_filter(spark):
    day = lambda s: pd.Timestamp(s).date()
    captures = spark.createDataFrame(
        [(1, "http://a.bad.org/x", day("2020-01-05")), (2, "https://u@A.bad.org:80", day("2020-02-05")), (3, "http://bad.org.", day("2020-03-05")), (4, "http://notbad.org", day("2020-01-05")), (5, None, day("2020-01-05")), (6, "nohost", day("2020-01-05")), (7, "http://a.bad.org", None)],
        "page_id long, url string, fetched_on date",
    ).withColumn("pattern", F.lit("clash"))
    entries = spark.createDataFrame(
        [("l", "spam", "bad.org", day("2020-01-01"), "add"), ("l", "spam", "bad.org", day("2020-02-01"), "remove"), ("l", "spam", "BAD.org", day("2020-03-01"), "add"), ("l", "adult", "a.bad.org", day("2020-02-01"), "add"), ("l", "adult", None, day("2020-02-01"), "add")],
        "list string, category string, pattern string, listed_on date, action string",
    )
    got = {r.page_id: r.categories for r in url_filter.evaluate(captures, entries).collect()}
    assert got == {1: "spam", 2: "adult", 3: "spam", 4: None, 5: None, 6: None, 7: None}
    assert {r.page_id for r in url_filter.filter_captures(captures, entries, ["spam"]).collect()} == {2, 4, 5, 6, 7}


@pytest.mark.parametrize("listed_rows", [500_000, 0])
def test_url_filter_with_odd_hosts_and_columns(spark, listed_rows):
    day = lambda s: pd.Timestamp(s).date()
    urls = ["http://[2001:db8::1]/", "http://[::1]:80/x", "https://10.0.0.1:8/", "http://10.0.0.2", "http://x.com", "http://u:p@[::1]", "http://[::1", "http://x.com", "", None]
    rows = [(i, u, day("2020-01-05"), "a", "b", "c", 1, "d") for i, u in enumerate(urls)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on date, day string, h string, pattern string, n_active int, host string")
    entries = spark.createDataFrame([("l", "spam", p, day("2020-01-01"), "add") for p in ("[::1]", "10.0.0.1", "0.2", "com", "2")], "list string, category string, pattern string, listed_on date, action string")
    got = {r.page_id: (r.host, r.n_active) for r in url_filter.evaluate(captures, entries, listed_rows).collect()}
    assert got == {0: ("[2001:db8::1]", 0), 1: ("[::1]", 1), 2: ("10.0.0.1", 1), 3: ("10.0.0.2", 0), 4: ("x.com", 1), 5: ("[::1]", 1), 6: (None, 0), 7: ("x.com", 1), 8: (None, 0), 9: (None, 0)}
    kept = url_filter.filter_captures(captures, entries)
    assert kept.columns == captures.columns and {r.page_id for r in kept.collect()} == {0, 3, 6, 8, 9}
    assert {(r.day, r.h, r.pattern, r.n_active, r.host) for r in kept.collect()} == {("a", "b", "c", 1, "d")}
    assert url_filter.evaluate(captures.limit(0), entries).count() == 0
    assert {r.n_active for r in url_filter.evaluate(captures.unionByName(captures), entries.limit(0)).collect()} == {0}


def test_empty_tables(spark, nothing):
    assert suffix_dedup.dedup(nothing).count() == 0
    assert line_dedup.dedup(nothing).count() == 0
    assert jaccard_join.components(nothing).count() == 0
    assert mixing.mix(mixing.materialise(mixing.sized(nothing))).count() == 0
    assert license_scan.summarise(nothing, license_scan.scan(nothing)).count() == 0
    assert packing.pack(nothing).count() == 0
    assert fingerprint.with_next(nothing).count() == 0
    assert vp_search.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert url_filter.sample_entries(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(200))
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (None, text, "a"), (2, text + " more", None)], "doc_id long, text string, source string")
    assert suffix_dedup.dedup(df).agg(F.sum("n_removed")).first()[0] > 0
    assert line_dedup.dedup(df, 1).count() == 4
    assert sorted(r.component_id for r in jaccard_join.components(df).collect() if r.component_id is not None) == [1, 1, 1]
    assert mixing.mix(mixing.materialise(mixing.sized(df))).count() == 4
    assert license_scan.summarise(df, license_scan.scan(df)).count() == 4
    packed = packing.pack(df).toPandas()
    assert packed.length.sum() == packed.drop_duplicates("doc_id").doc_tokens.sum() + packed[packed.doc_id == 1].doc_tokens.iloc[0]
    assert fingerprint.with_next(df).count() == 4
