r"""Mix sources to target weights with a low-discrepancy schedule.

A schedule of one slot for each word covers the size of the whole mix; slot i stands at the golden-ratio point
frac(i * 0.618...) (kept in 46-bit integers, so it is exact), and the point falls into the share of one source on the
line of cumulative targets. The slots of a source are ranked by i. The documents of a source, in an order shuffled by
md5, form a line of words; the slot of rank r takes word r modulo the size of the source, so a source that must give more
than it has is repeated word by word, three times at most.

How often a word is taken follows from the number of its source's slots, so the slots are counted and not made: the
number of points below a mark among the first n is a sum of floors, found in some steps as for Euclid's algorithm.

Size of a document: its number of words [^\x20\x09-\x0D]+, 0 for a null text. Sources are ordered by code point, null
last, and weigh 5, 2, 1 in turn. Defined results: documents without words take part with 0 words taken; an empty table
gives an empty result; rows that repeat a doc_id are documents of their own; only doc_id, source and text are read.

Scale: the text is read once and reduced to (doc_id, source, size, a hash). Running sums over a source are taken in two
levels (chunks of the shuffled order, then rows of a chunk), so a source with a third of all rows is not one task's work.
Running sums over the sources are taken in two levels, too, so there may be as many sources as hosts. The schedule costs one
sum for each source, whatever the size of the mix.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, materialise, no_text_as_empty, sums_ahead, table

WEIGHTS = (5, 2, 1)
MOST = 3
#: 2^46 and the golden ratio's fraction of it.
FULL = 1 << 46
GOLDEN = 43490275647443
#: With more sources than this the table of sources is joined by shuffling.
BROADCAST_SOURCES = 10_000


def row_hash() -> Column:
    return F.xxhash64(no_text_as_empty(F.col("text")), "source")


def sized(docs: DataFrame) -> DataFrame:
    words = F.array_remove(F.split(no_text_as_empty(F.col("text")), BLANKS), "")
    return docs.select("doc_id", "source", F.size(words).cast("long").alias("size"), row_hash().alias("row_hash"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, sid, source_size, target, low, high (the source's share of [0, FULL)), total."""
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    exact = "decimal(38,6)"
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums_ahead(by_source, [F.col("source").asc_nulls_last()], {"sid": F.lit(1).cast("long")})
    ranked = ranked.withColumn("w", cycle[(F.col("sid") % len(weights)).cast("int")]).withColumn("cap", most * F.col("source_size"))
    # Filling by weight: in order of cap / weight, a source stops at its cap if its share of what the former left is above it.
    ahead = sums_ahead(ranked, [F.col("cap") / F.col("w"), F.col("sid")], {"cap_ahead": F.col("cap").cast(exact), "w_ahead": F.col("w")})
    total, all_w = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    total, all_w = total or 0, all_w or 0
    stops = materialise(ahead.withColumn("stops", F.col("cap").cast(exact) * (all_w - F.col("w_ahead")) <= F.col("w") * (F.lit(total) - F.col("cap_ahead"))).drop("cap_ahead", "w_ahead"))
    stopped, open_w = stops.agg(F.sum(F.when(F.col("stops"), F.col("cap"))), F.sum(F.when(~F.col("stops"), F.col("w")))).first()
    share = F.col("w") * F.lit(float(total - (stopped or 0))) / F.lit(float(open_w or 1))
    goal = stops.withColumn("target", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share))
    # Cumulative targets are exact to six decimals, so neighbouring shares meet.
    cut = sums_ahead(goal, [F.col("sid")], {"from": F.col("target").cast(exact)})
    mark = lambda c: F.floor(F.least(c.cast("double") / F.lit(float(max(total, 1))), F.lit(1.0)) * FULL)
    low, high = mark(F.col("from")), mark(F.col("from") + F.col("target").cast(exact))
    return cut.select("source", "sid", "source_size", "target", low.alias("low"), high.alias("high"), F.lit(total).cast("long").alias("total"))


def floor_sum(n: int, m: int, a: int, b: int) -> int:
    """The sum of (a * i + b) // m for i from 0 to n - 1; a and b are not negative."""
    total = 0
    while n:
        total += n * (n - 1) // 2 * (a // m) + n * (b // m)
        a, b = a % m, b % m
        top = a * n + b
        if top < m:
            break
        n, b = divmod(top, m)
        m, a = a, m
    return total


def points_below(n: int, mark: int) -> int:
    """How many of the first n points of the schedule are below mark (0 to FULL)."""
    # A point is below mark if and only if adding FULL - mark to it does not reach the next multiple of FULL.
    return n - floor_sum(n, FULL, GOLDEN, FULL - mark) + floor_sum(n, FULL, GOLDEN, 0)


def slots_of(targets: DataFrame) -> DataFrame:
    """targets and n_slots: how many slots of the schedule fall into the share of each source."""

    @F.pandas_udf("long")
    def count(low: pd.Series, high: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([points_below(n, b) - points_below(n, a) for a, b, n in zip(low.tolist(), high.tolist(), total.tolist(), strict=True)], dtype="int64")

    return targets.withColumn("n_slots", count("low", "high", "total"))


def placed_documents(sizes: DataFrame, n_rows: int) -> DataFrame:
    """Adds start: the place of a document on its source's shuffled line of words."""
    digits = 1
    while n_rows >> (4 * digits + 11) and digits < 7:
        digits += 1
    docs = sizes.withColumn("order", F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    docs = docs.withColumn("chunk", F.substring("order", 1, digits))
    ahead = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = docs.groupBy("sid", "chunk").agg(F.sum("size").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    ties = [c for c in ("doc_id", "size", "row_hash") if c in docs.columns]
    own = Window.partitionBy("sid", "chunk").orderBy("order", *ties).rowsBetween(Window.unboundedPreceding, -1)
    return docs.join(chunks, ["sid", "chunk"]).withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(own), F.lit(0))).drop("order", "chunk", "ahead")


def mix(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """sizes: doc_id, source, size, perhaps row_hash (materialised). Returns these, source_size, target, taken."""
    n_rows = sizes.count()
    targets = materialise(slots_of(source_targets(sizes, most=most)))
    small = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    docs = placed_documents(sizes.join(small.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "low", "high", "total"), n_rows)
    # Each word is taken in every whole round over its source, and the first words once more in the round that is not whole.
    given, whole = F.least("n_slots", most * F.col("source_size")), F.greatest("source_size", F.lit(1))
    rest = F.least(F.col("size"), F.greatest(given % whole - F.col("start"), F.lit(0)))
    taken = F.col("size") * F.floor(given / whole) + rest
    return docs.select(*sizes.columns, "source_size", "target", taken.cast("long").alias("taken"))


#: Between a word and the blank after it.
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for each whole time a document is taken, and one with its first words for the rest. Rows
    that are equal in doc_id, text and source are documents of their own, each with its share."""
    shares = mix(materialise(sized(docs)))
    equal = Window.partitionBy("doc_id", "row_hash").orderBy(F.col("taken").desc())
    shares = shares.withColumn("k", F.row_number().over(equal)).filter("taken > 0")
    shares = shares.select(*[F.col(c).alias(f"_mix_{c}") for c in ("doc_id", "row_hash", "k", "size", "taken")])
    mine = Window.partitionBy("doc_id", "_mix_h").orderBy(F.lit(1))
    numbered = docs.withColumn("_mix_h", row_hash()).withColumn("_mix_n", F.row_number().over(mine))
    same = F.col("doc_id").eqNullSafe(F.col("_mix_doc_id")) & (F.col("_mix_h") == F.col("_mix_row_hash")) & (F.col("_mix_n") == F.col("_mix_k"))
    joined = numbered.join(shares, same)
    rest = (F.col("_mix_taken") % F.col("_mix_size")).cast("int")
    rows = joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_mix_taken") / F.col("_mix_size")).cast("int"))))
    text = F.when(F.col("_mix_copy") * F.col("_mix_size") <= F.col("_mix_taken"), F.col("text")).otherwise(F.array_join(F.slice(F.split("text", WORD_END), 1, rest), ""))
    return rows.withColumn("text", text).select(*docs.columns)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(materialise(sized(table(spark, sf_dir, "documents")))).drop("source", "row_hash")


def oracle_sql() -> str:
    """Every slot and every word is written out, whatever their number."""
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS sid FROM s),
w AS (SELECT *, [5, 2, 1][(sid % 3) + 1]::BIGINT AS w, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM r),
f AS (SELECT *, cap * (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) <= w * (total - coalesce(sum(cap) OVER b, 0)) AS stops
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CASE WHEN stops THEN cap::DOUBLE ELSE w::DOUBLE * (total - coalesce(sum(cap) FILTER (stops) OVER (), 0))::DOUBLE / (sum(w) FILTER (NOT stops) OVER ())::DOUBLE END AS target FROM f),
h AS (SELECT *, floor(least(sum(target::DECIMAL(38, 6)) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING)::DOUBLE / greatest(total, 1)::DOUBLE, 1.0) * {FULL})::BIGINT AS high FROM g),
t AS (SELECT *, coalesce(lag(high) OVER (ORDER BY sid), 0) AS low FROM h),
p AS (SELECT i AS slot, ((i::HUGEINT * {GOLDEN}) % {FULL})::BIGINT AS point FROM range((SELECT max(total)::BIGINT FROM t)) q(i)),
k AS (SELECT sid, source_size, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM p JOIN t ON point >= low AND point < high),
u AS (SELECT sid, rank % source_size AS word, count(*) AS uses FROM k WHERE rank < {MOST} * source_size GROUP BY ALL),
l AS (SELECT d.doc_id, size, source_size, target, sid,
             coalesce(sum(size) OVER (PARTITION BY sid ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT sid, start, unnest(range(start, start + size)) AS word FROM l WHERE size > 0),
x AS (SELECT sid, start, sum(uses) AS taken FROM c JOIN u USING (sid, word) GROUP BY ALL)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM l LEFT JOIN x ON l.sid = x.sid AND l.start = x.start AND l.size > 0"""
