r"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs (split at line feeds, empty ones left out). Each paragraph is hashed to a wide vector
of 71 lanes, and the fingerprint is the sum of the vectors:

* 8 identity lanes, the halves of four seeded 64-bit hashes of the paragraph, modulo 2^32;
* 63 sketch lanes: every word of the paragraph, together with the word after it in the same paragraph, adds a hash bit
  to each lane, modulo 2^21, and one lane counts these word pairs.

Sums do not depend on the order of paragraphs, and vectors can be added or subtracted one by one (`add`, `subtract`):
a paragraph that is put in or taken out changes the fingerprint without the rest of the text. As a single line feed that
moves changes no multiset of paragraphs, equal fingerprints mean equal multisets (up to a 256-bit collision).

Likeness of two fingerprints: the sketch lanes, read as +1/-1 sums, estimate the squared length of the difference of
the two multisets of word pairs; 1 - |A - B|^2 / (|A|^2 + |B|^2), cut to 0..1, is 1 for equal multisets and near 0 for
multisets without common pairs. |A|^2 is estimated by the number of pairs.

Three lanes of 21 bits are kept in one long. While they are summed, two lanes of 32 bits share a long, so one masked shift
and one addition serve two lanes: a text has less than 2^31 word pairs, so no lane reaches its neighbour. Only then are they
reduced. Differences of lanes are known modulo 2^21; the one nearest to what independent bits would give is taken.

Defined results: a null text counts as empty; the empty text has the zero vector; two zero vectors have likeness 1. Rows
that repeat a doc_id, and those without one, which come last, are ordered by a hash of their text. Only doc_id and text are
read.

Scale: which row comes next is found in blocks of neighbouring rows. The cuts between blocks are taken from a sample of the
rows' places in the order (SAMPLE for each block, at most MOST_BLOCKS blocks), not from the ids' range, so one far id, or a
third of all rows under one id or none, leaves blocks of like size. Cuts move work, not results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, no_text_as_empty, table

SEEDS = (11, 23, 47, 97)
N_IDENTITY = 2 * len(SEEDS)
LONGS = 21
LANE_BITS = (0, 21, 42)
LANE = (1 << 21) - 1
#: The lowest bit of each of the two lanes in a long of the sums.
HALVES, HALF_BITS = 1 | 1 << 32, 32
IDENTITY_MOD = 1 << 32
#: Documents of a block, about; blocks at most, and rows that are looked at for each to cut them (a string of 33 letters each).
BLOCK_ROWS, MOST_BLOCKS, SAMPLE = 512, 1 << 14, 16


def units(text: Column) -> Column:
    """Array of longs: the 8 identity lanes of the text, then a hash for each word pair."""
    paragraphs = F.filter(F.split(text, "\n"), lambda p: p != "")

    def identity(seed: int) -> Column:
        return F.aggregate(
            paragraphs,
            F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")),
            lambda s, p: F.struct(
                ((s.a + F.shiftrightunsigned(F.xxhash64(F.lit(seed), p), 32)) % IDENTITY_MOD).alias("a"),
                ((s.b + F.xxhash64(F.lit(seed), p).bitwiseAND(IDENTITY_MOD - 1)) % IDENTITY_MOD).alias("b"),
            ),
        )

    # A paragraph's last word is paired with the marker "\n", so pairs never cross paragraphs.
    words = F.filter(F.split(F.replace(text, F.lit("\n"), F.lit(" \n ")), " "), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.when(w != "\n", F.xxhash64(w)))
    nexts = F.concat(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), F.array(F.lit(None).cast("long")))
    pairs = F.filter(F.zip_with(hashes, nexts, lambda a, b: F.when(a.isNotNull(), F.xxhash64(a, F.coalesce(b, F.lit(0).cast("long"))))), lambda h: h.isNotNull())
    lanes = [x for s in SEEDS for x in (identity(s).a, identity(s).b)]
    return F.concat(F.array(*lanes), pairs)


def fingerprints(texts: DataFrame, key: list[str], columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """One row for each value of key, with a struct (identity array, n_pairs, sketch array) named fp_<column> for each of the
    text columns. Rows of one key must have equal texts; the key is the group of the sums.

    All columns are summed in one aggregate. The units of a text lie in one task, so the map side leaves one row for each
    text, whatever its length.
    """
    # Texts of one row are laid side by side, so there is one line for the longest of them and no condition in the sums.
    names = [f"u{k}" for k in range(len(columns))]
    wide = texts.select(*key, *[units(F.col(c)).alias(u) for u, c in zip(names, columns, strict=True)])
    spread = wide.select(*key, F.posexplode(F.arrays_zip(*names)).alias("i", "v"))
    zero = F.lit(0).cast("long")
    values = [F.coalesce(F.col("v")[u], zero).alias(u) for u in names]
    hashes = [F.when((F.col("i") >= N_IDENTITY) & F.col("v")[u].isNotNull(), F.col("v")[u]).otherwise(zero).alias(f"h{k}") for k, u in enumerate(names)]
    counts = [F.when((F.col("i") >= N_IDENTITY) & F.col("v")[u].isNotNull(), 1).otherwise(0).alias(f"c{k}") for k, u in enumerate(names)]
    spread = spread.select(*key, "i", *values, *hashes, *counts)
    sums = []
    for k, u in enumerate(names):
        sums += [F.max(F.when(F.col("i") == j, F.col(u))).alias(f"i{k}_{j}") for j in range(N_IDENTITY)]
        sums.append(F.sum(f"c{k}").alias(f"n{k}"))
        sums += [F.sum(F.shiftrightunsigned(f"h{k}", j).bitwiseAND(F.lit(HALVES))).alias(f"s{k}_{j}") for j in range(HALF_BITS)]
    total = spread.groupBy(*key).agg(*sums)

    def sketch(k: int, j: int) -> Column:
        lanes = [F.shiftrightunsigned(f"s{k}_{(j + low) % HALF_BITS}", (j + low) // HALF_BITS * HALF_BITS) for low in LANE_BITS]
        return _packed(lanes)

    return total.select(
        *key,
        *[
            F.struct(
                F.array(*[f"i{k}_{j}" for j in range(N_IDENTITY)]).alias("identity"), F.col(f"n{k}").alias("n_pairs"), F.array(*[sketch(k, j) for j in range(LONGS)]).alias("sketch")
            ).alias(f"fp_{c}")
            for k, c in enumerate(columns)
        ],
    )


def _packed(lanes: list[Column]) -> Column:
    """Three lanes in one long, each modulo 2^21."""
    one = F.lit(0).cast("long")
    for lane, low in zip(lanes, LANE_BITS, strict=True):
        one = one.bitwiseOR(F.shiftleft(lane.bitwiseAND(F.lit(LANE)), low))
    return one


def _lanes(sketch: Column) -> list[Column]:
    return [F.shiftrightunsigned(sketch, low).bitwiseAND(F.lit(LANE)) for low in LANE_BITS]


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union of two multisets; with sign -1, of the first without the second."""
    return F.struct(
        F.zip_with(a["identity"], b["identity"], lambda x, y: F.pmod(x + sign * y, F.lit(IDENTITY_MOD))).alias("identity"),
        (a["n_pairs"] + sign * b["n_pairs"]).alias("n_pairs"),
        F.zip_with(a["sketch"], b["sketch"], lambda x, y: _packed([p + sign * q for p, q in zip(_lanes(x), _lanes(y), strict=True)])).alias("sketch"),
    )


def subtract(a: Column, b: Column) -> Column:
    return add(a, b, -1)


def as_string(fp: Column) -> Column:
    longs = F.concat(F.array(fp["n_pairs"]), fp["sketch"])
    return F.concat(
        F.array_join(F.transform(fp["identity"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""),
        F.lit(":"),
        F.array_join(F.transform(longs, lambda x: F.lower(F.hex(x))), "."),
    )


def likeness(a: Column, b: Column) -> Column:
    """0 to 1."""
    extra = (a["n_pairs"] - b["n_pairs"]).cast("double")

    def squares(s: Column, x: Column, y: Column) -> Column:
        for p, q in zip(_lanes(x), _lanes(y), strict=True):
            off = 2 * (p - q).cast("double") - extra
            s = s + F.pow(off - 2 * (LANE + 1) * F.round(off / (2 * (LANE + 1))), F.lit(2.0))
        return s

    pairs = F.zip_with(a["sketch"], b["sketch"], lambda x, y: squares(F.lit(0.0), x, y))
    apart = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / (3 * LONGS)
    both = (a["n_pairs"] + b["n_pairs"]).cast("double")
    raw = F.when(both > 0, 1 - apart / both).otherwise(1.0)
    return F.when(a["identity"] == b["identity"], 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def _place(doc_id: Column, row_hash: Column) -> Column:
    """A string that sorts like the order: doc_id descending, null last, then the hash."""
    sortable = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    number = doc_id.cast("long")
    return F.concat(F.when(number.isNull(), "1").otherwise("0"), F.coalesce(sortable(F.bitwise_not(number)), F.lit("")), sortable(row_hash))


def _block(place: Column, cuts: list[str]) -> Column:
    """How many cuts lie at or before the place, by bisection in one array."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    marks = F.split(F.lit(",".join(cuts)), ",")

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= len(cuts)) & (F.get(marks, at + by - 1) <= place), at + by).otherwise(at)

    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), step)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, text, next_id, next_hash, next_text: beside each row the next one in descending order of doc_id;
    after the last comes the first.

    The rows are dealt to blocks of neighbours and ordered inside their block. The first row of each block is also put into the
    nearest block before it that has rows, as that block's last neighbour. The texts are shuffled once.
    """
    rows = docs.select("doc_id", no_text_as_empty(F.col("text")).alias("text"))
    n = rows.count()
    rows = rows.withColumn("row_hash", F.xxhash64("text")).withColumn("place", _place(F.col("doc_id"), F.col("row_hash")))
    blocks = min(MOST_BLOCKS, -(-n // BLOCK_ROWS))
    cuts: list[str] = []
    if blocks > 1:
        every = max(1, n // (blocks * SAMPLE))
        some = rows.filter(F.pmod(F.xxhash64(F.lit(31), "doc_id", "row_hash"), F.lit(every)) == 0).select("place").orderBy(F.xxhash64(F.lit(37), "place"))
        seen = sorted({r.place for r in some.limit(2 * MOST_BLOCKS * SAMPLE).collect()})
        cuts = [seen[k * len(seen) // blocks] for k in range(1, blocks)] if len(seen) > blocks else seen[1:]
        cuts = sorted(set(cuts))
    rows = rows.withColumn("block", _block(F.col("place"), cuts))
    # One row for each block, MOST_BLOCKS at most.
    tops = rows.groupBy("block").agg(F.min("place").alias("top"))
    order = Window.orderBy("block")
    before = F.coalesce(F.lag("block").over(order), F.max("block").over(Window.partitionBy()))
    tops = materialise(tops.select(F.col("block").alias("b"), "top", before.alias("halo")))
    flagged = rows.join(F.broadcast(tops), F.col("block") == F.col("b"), "left")
    halo = F.when(F.col("place") == F.col("top"), F.array("block", "halo")).otherwise(F.array("block"))
    dealt = flagged.select("doc_id", "text", "row_hash", "place", F.posexplode(halo).alias("is_halo", "block"))
    inside = Window.partitionBy("block").orderBy("is_halo", "place", "text")
    return (
        dealt.select("doc_id", "row_hash", "text", "is_halo", F.lead("doc_id").over(inside).alias("next_id"), F.lead("row_hash").over(inside).alias("next_hash"), F.lead("text").over(inside).alias("next_text"))
        .filter("is_halo = 0")
        .drop("is_halo")
    )


def edited(text: Column, next_text: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many of the next text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.char_length(text) - half), F.substr(next_text, F.lit(1), half))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(table(spark, sf_dir, "documents")).withColumn("changed", edited(F.col("text"), F.col("next_text")))
    digest = F.unhex(F.sha2(F.encode("changed", "UTF-8"), 256))
    texts = pairs.select("doc_id", "row_hash", F.char_length("text").cast("long").alias("n_chars"), digest.alias("digest"), "next_id", "next_hash", "text", "changed")
    rows = fingerprints(texts, ["doc_id", "row_hash", "n_chars", "digest", "next_id", "next_hash"], ("text", "changed"))
    rows = materialise(rows).withColumnsRenamed({"fp_text": "a", "fp_changed": "e"}).withColumn("edited_sha256", F.lower(F.hex("digest")))
    after = rows.select(F.col("doc_id").alias("d"), F.col("row_hash").alias("h"), F.col("a").alias("n")).dropDuplicates(["d", "h"])
    return rows.join(after, F.col("next_id").eqNullSafe(F.col("d")) & (F.col("next_hash") == F.col("h")), "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("a")).alias("fingerprint"),
        as_string(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e")).alias("near_edited"),
        likeness(F.col("a"), F.col("n")).alias("near_next"),
    )
