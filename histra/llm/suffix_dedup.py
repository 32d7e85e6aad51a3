r"""Removal of every byte that lies in a 400-byte string which also starts anywhere else, by column-wise construction of
a multi-string suffix order.

The method inserts one symbol of every string each round, from the right ends to the left, and updates the order of the
suffixes (whose preceding symbols are the collection's Burrows-Wheeler transform) and the common prefixes of neighbours.
A whole corpus in one such run would take as many rounds as its longest text has bytes, each passing over all strings, so
the texts are first cut into aligned strings that can be built apart:

1. Anchors. Every start s of a 400-byte string picks the smallest 8-byte hash among its next 192 places, p(s). The choice
   depends on the string alone, so two equal strings pick the same offset. Neighbouring starts with one anchor form a
   piece; all their strings contain the 209 bytes from the anchor, and the hash of these is the piece's bucket. Equal
   strings of 400 bytes therefore lie at the same column of pieces of one bucket. A collision of buckets costs nothing, as
   bytes decide inside; a piece's identity is 158 bits of three hash families, two of them modulo a prime.
2. Buckets with one piece go. A bucket whose pieces are all equal needs no bytes: copies are counted, not compared. Of the
   others, each distinct piece is cut from its text once.
3. Halving. A bucket with more distinct pieces than one task should hold (one passage in a great many surroundings) is
   split by content: its strings fall into those that reach far to the left of the anchor and those that reach far to the
   right, and each half has more bytes that all its strings contain; these make the buckets of the next round. Equal
   strings stay together, and after eight rounds at most a bucket's strings have one offset and are all equal. So every
   bucket, of whatever size, ends in the construction.
4. Column-wise construction over the distinct pieces of a bucket, aligned at the anchor: at most 591 rounds. A start is
   repeated when the common prefix with a neighbour in the order reaches 400, or when its piece has copies.

Batches of pieces come from Spark's sorted shuffle files, one after the other, so a task holds one batch.

Defined results: a null text counts as empty, with 0 bytes and the hash of nothing; texts under 400 bytes stay; rows that
are equal in doc_id and text count as places of their own, so they empty one another; equal text under other ids likewise.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textnum
from .common import materialise, no_text_as_empty, table

LENGTH = 400
#: Places among which a start picks its anchor; below 256.
PICK = 192
GRAM = 8
#: Distinct pieces of a bucket that one task builds at once; larger buckets are halved first.
MOST_PIECES = 20_000
#: One document in so many is looked at for buckets that hold more than one row in HOT_SHARE, at least HOT_LEAST of the sample's;
#: there are HOT_SHARE such buckets at most. Their rows are dealt to SALTS tasks to be counted.
SAMPLE_EVERY, HOT_SHARE, HOT_LEAST, SALTS = 64, 1000, 16, 256
BATCH_PIECES = 8192
#: What tells a piece apart.
PIECE = ["bucket", "piece", "piece2"]
#: What tells a row apart.
ROW = ["rid", "tid"]


def picked(data: np.ndarray, offsets: np.ndarray, length: int, pick: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of strings of `length` that lie in one row, and the anchor of each."""
    n = len(data)
    low, high = offsets[:-1], offsets[1:] - length
    change = np.zeros(n + 2, np.int32)
    has = high >= low
    np.add.at(change, low[has], 1)
    np.add.at(change, high[has] + 1, -1)
    starts = np.flatnonzero(np.cumsum(change[:n]))
    if not len(starts):
        return starts, starts
    grams = np.ndarray((n - GRAM + 1,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    place = np.arange(len(grams), dtype=np.uint64)
    value = grams * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value = (value & np.uint64(0xFFFFFFFF00000000)) | place
    blocks = -(-len(value) // pick) + 1
    padded = np.full(blocks * pick, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(value)] = value
    square = padded.reshape(blocks, pick)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[starts], ahead[starts + pick - 1])
    return starts, (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _anchors(length: int, pick: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in textnum.text_slices(batch.column(2)):
                starts, anchors = picked(data, offsets, length, pick)
                if not len(starts):
                    continue
                cut = np.flatnonzero((starts[1:] != starts[:-1] + 1) | (anchors[1:] != anchors[:-1])) + 1
                first, last = starts[np.concatenate(([0], cut))], starts[np.concatenate((cut, [len(starts)])) - 1]
                at = anchors[np.concatenate(([0], cut))]
                row = np.searchsorted(offsets, first, side="right") - 1
                hashes = textnum.Stretches(data)
                rid, tid = (np.asarray(batch.column(k).slice(lo, hi - lo))[row] for k in range(2))
                packed = (at - offsets[row]) << 16 | (at - first) << 8 | (at - last)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid),
                        pa.array(tid),
                        pa.array(textnum.signed(hashes.plain(at, at + length - pick + 1))),
                        pa.array(textnum.signed(hashes.prime(first, last + length))),
                        pa.array((hashes.plain(first, last + length) >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        pa.array(packed),
                    ],
                    names=[*ROW, *PIECE, "packed"],
                )

    return run


def _cut(length: int):
    """Bytes of the wanted pieces of each text."""
    schema = pa.schema([("bucket", pa.int64()), ("piece", pa.int64()), ("piece2", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("copies", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                data = text.as_py().encode()
                for w in wanted.as_py():
                    at, left, right = w["packed"] >> 16, w["packed"] >> 8 & 255, w["packed"] & 255
                    rows.append((w["bucket"], w["piece"], w["piece2"], left, right, w["copies"], data[at - left : at - right + length]))
                    if len(rows) >= 2000:
                        yield flush()
        if rows:
            yield flush()

    return run


def halves(piece: bytes, left: int, right: int, low: int, high: int, length: int) -> Iterator[tuple[int, bytes, int, int, bytes]]:
    """The parts of a piece whose strings start `low` to `middle` - 1 and `middle` to `high` bytes before the anchor: (side, what
    all strings of the side contain, left, right, bytes)."""
    middle = (low + high + 1) // 2
    for side, (near, far) in enumerate(((low, middle - 1), (middle, high))):
        a, b = min(left, far), max(right, near)
        if a >= b and far >= near:
            part = piece[left - a : left - b + length]
            # Any string of the side reaches from `near` or more before the anchor to length - far or more after it.
            yield side, piece[left - near : left - far + length], a, b, part


def _halve(low: int, high: int, length: int):
    """(bucket, piece, piece2, left, right, bytes) in; the same names, side, sub, sub1, sub2, left, right, bytes out."""

    def word(digest: bytes, lo: int, hi: int) -> int:
        return int.from_bytes(digest[lo:hi], "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(lo, 2000) for batch in batches for lo in range(0, batch.num_rows, 2000)):
            rows = []
            for bucket, piece, piece2, left, right, data in zip(*[c.to_pylist() for c in part.columns], strict=True):
                for side, common, a, b, cut in halves(data, left, right, low, high, length):
                    sub = hashlib.blake2b(common, digest_size=8, key=bucket.to_bytes(8, "little", signed=True) + bytes([side])).digest()
                    own = hashlib.blake2b(cut, digest_size=12, key=bytes([a, b])).digest()
                    rows.append((bucket, piece, piece2, side, word(sub, 0, 8), word(own, 0, 8), word(own, 8, 12), a, b, cut))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*PIECE, "side", "sub", "sub1", "sub2", "left", "right", "bytes"])

    return run


def small_buckets(pieces: DataFrame, length: int, pick: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """pieces: the distinct pieces with their bytes. Returns them in buckets of at most `most` pieces, and, if any bucket was
    halved, whose pieces they are: (bucket, piece, piece2) and (of_bucket, of_piece, of_piece2)."""
    done, owners = None, None
    # Ranges of offsets still together, as (low, high); each round halves all of them.
    open_, spans, names = pieces.withColumn("span", F.lit(0)), [(0, pick - 1)], None
    while True:
        sizes = open_.groupBy("bucket").agg(F.count("*").alias("m")).filter(F.col("m") > most)
        crowded = materialise(sizes.select("bucket"))
        none = crowded.isEmpty()
        ready = open_ if none else open_.join(crowded, "bucket", "left_anti")
        ready = ready.drop("span")
        done = ready if done is None else done.unionByName(ready)
        if names is not None:
            mine = names if none else names.join(crowded, "bucket", "left_anti")
            owners = mine if owners is None else owners.unionByName(mine)
        if none:
            return done, owners
        rest = open_.join(crowded, "bucket", "left_semi")
        parts, after = None, []
        for low, high in spans:
            some = rest.filter(F.col("span") == len(after) // 2).select(*PIECE, "left", "right", "bytes")
            middle = (low + high + 1) // 2
            cut = some.mapInArrow(_halve(low, high, length), "bucket long, piece long, piece2 int, side int, sub long, sub1 long, sub2 int, left int, right int, bytes binary")
            cut = cut.withColumn("span", F.col("side") + len(after))
            after += [(low, middle - 1), (middle, high)]
            parts = cut if parts is None else parts.unionByName(cut)
        parts = materialise(parts)
        copies = rest.select(*PIECE, "copies")
        open_ = parts.join(copies, PIECE).groupBy(F.col("sub").alias("bucket"), F.col("sub1").alias("piece"), F.col("sub2").alias("piece2")).agg(
            F.first("left").alias("left"), F.first("right").alias("right"), F.sum("copies").alias("copies"), F.first("bytes").alias("bytes"), F.first("span").alias("span")
        )
        open_, spans = materialise(open_), after
        mine = parts.select(F.col("sub").alias("bucket"), F.col("sub1").alias("piece"), F.col("sub2").alias("piece2"), *[F.col(c).alias(f"was_{c}") for c in PIECE])
        if names is None:
            names = materialise(mine.withColumnsRenamed({f"was_{c}": f"of_{c}" for c in PIECE}))
        else:
            before = names.withColumnsRenamed({c: f"was_{c}" for c in PIECE})
            names = materialise(mine.join(before, [f"was_{c}" for c in PIECE]).select(*PIECE, *[f"of_{c}" for c in PIECE]))


def repeated_columns(pieces: list[bytes], left: np.ndarray, right: np.ndarray, copies: np.ndarray, length: int, pick: int) -> np.ndarray:
    """For aligned pieces: a row for each, and for each of the `pick` columns whether the string of `length` that starts
    there also starts in another piece (or copy). Column pick - 1 is the anchor; piece i covers the starts from column
    pick - 1 - left[i] to pick - 1 - right[i]."""
    m, width = len(pieces), pick + length - 1
    symbols = np.zeros((width, m), np.uint8)
    begin, end = pick - 1 - left, pick - 1 - right + length
    for i, piece in enumerate(pieces):
        symbols[begin[i] : end[i], i] = np.frombuffer(piece, np.uint8)
    out = np.zeros((pick, m), bool)
    order, common = np.arange(m), np.zeros(m, np.int16)
    for column in range(width - 1, -1, -1):
        # One symbol of each piece is put before its suffix; pieces that do not reach this column sort last.
        inside = (column >= begin[order]) & (column < end[order])
        symbol = np.where(inside, symbols[column, order].astype(np.uint16), np.uint16(256))
        to = np.argsort(symbol, kind="stable")
        # Neighbours with one symbol share one more than the least common prefix that lay between them.
        a, b = to[:-1], to[1:]
        fresh = np.zeros(m, np.int16)
        same = (symbol[a] == symbol[b]) & (symbol[b] < 256)
        fresh[1:][same] = _least_between(common, a[same] + 1, b[same]) + np.int16(1)
        order, common = order[to], fresh
        if column < pick:
            reach = common >= length
            out[column, order] = reach | np.concatenate((reach[1:], [False]))
    starts = np.arange(pick)[:, None]
    return ((out | (copies > 1)) & (starts >= begin) & (starts <= end - length)).T


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low..high]) for each pair, by a sparse table as deep as the longest stretch asks."""
    out = values[high].copy()
    far = np.flatnonzero(high > low)
    if len(far):
        low, high = low[far], high[far]
        depth = np.floor(np.log2(high - low + 1)).astype(np.int64)
        level, found = values, np.empty(len(far), values.dtype)
        for k in range(int(depth.max()) + 1):
            at = depth == k
            found[at] = np.minimum(level[low[at]], level[high[at] - (1 << k) + 1])
            if len(level) > 1 << k:
                level = np.minimum(level[: -(1 << k)], level[1 << k :])
        out[far] = found
    return out


def _build(length: int, pick: int, most: int):
    """Rows sorted by bucket in; (bucket, piece, piece2, first, last) out: runs of repeated starts, as offsets from the anchor."""

    def work(rows: list[tuple]) -> pa.RecordBatch | None:
        bucket, piece, piece2, left, right, copies, data = zip(*rows, strict=True)
        hit = repeated_columns(list(data), np.array(left), np.array(right), np.array(copies), length, pick)
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, first = np.nonzero(edge == 1)
        _, after = np.nonzero(edge == -1)
        if not len(i):
            return None
        return pa.RecordBatch.from_arrays(
            [*[pa.array(np.array(x, t)[i]) for x, t in ((bucket, np.int64), (piece, np.int64), (piece2, np.int32))], pa.array((first - pick + 1).astype(np.int32)), pa.array((after - pick).astype(np.int32))],
            names=[*PIECE, "first", "last"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if len(rows) >= most and row[0] != rows[-1][0]:
                    if (out := work(rows)) is not None:
                        yield out
                    rows = []
                rows.append(row)
        if rows and (out := work(rows)) is not None:
            yield out

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data = text.as_py().encode()
            at = removed = runs = 0
            kept = hashlib.sha256()
            for first, after in sorted((x["first"], x["after"]) for x in spans.as_py() or ()):
                if first > at or not runs:
                    runs += 1
                    kept.update(data[at:first])
                    at = first
                if after > at:
                    removed += after - at
                    at = after
            kept.update(data[at:])
            out.append((len(data), removed, runs, kept.hexdigest()))
        n, r, s, k = zip(*out, strict=True) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(k, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def hot_buckets(docs: DataFrame, length: int, pick: int) -> DataFrame:
    """hot: the very common buckets of a sample of the documents, HOT_SHARE of them at most."""
    some = docs.filter(F.pmod(F.xxhash64(F.lit(41), "rid"), F.lit(SAMPLE_EVERY)) == 0).select(*ROW, "text")
    rows = some.mapInArrow(_anchors(length, pick), "rid long, tid int, bucket long, piece long, piece2 int, packed long")
    counts = materialise(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > 1))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return materialise(counts.filter(F.col("n") >= max(HOT_LEAST, total // HOT_SHARE)).orderBy(F.col("n").desc(), "bucket").limit(HOT_SHARE).select(F.col("bucket").alias("hot")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, pick: int = PICK, most_pieces: int = MOST_PIECES) -> DataFrame:
    """docs: rid, tid, doc_id, text. Returns rid, tid, spans (array of first, after: bytes that strings of `length` cover which
    also start elsewhere)."""
    if not GRAM <= length - pick + 1 or not 0 < pick < 256:
        raise ValueError("a string must hold a gram after its last possible anchor")
    anchors = docs.select(*ROW, "text").mapInArrow(_anchors(length, pick), "rid long, tid int, bucket long, piece long, piece2 int, packed long")
    # One shuffle of light rows. What a sample shows to be very common is counted in many parts, which are put together after;
    # which buckets these are moves work, not results.
    hot = hot_buckets(docs, length, pick)
    dealt = anchors.join(F.broadcast(hot), F.col("bucket") == F.col("hot"), "left")
    dealt = dealt.withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("rid", "packed"), F.lit(SALTS))).otherwise(0))
    same = Window.partitionBy("bucket", "salt")
    own = F.struct("piece", "piece2")
    counted = dealt.withColumn("places", F.count("*").over(same)).withColumn("low", F.min(own).over(same)).withColumn("high", F.max(own).over(same))
    kept = counted.filter(F.col("hot").isNotNull() | (F.col("places") > 1))
    shared = materialise(kept.select(*ROW, *PIECE, "packed", (F.col("low") == F.col("high")).alias("alike"), (F.col("hot").isNotNull()).alias("is_hot")))
    whole = shared.filter("is_hot").groupBy(F.col("bucket").alias("b")).agg(F.count("*").alias("n"), (F.min(own) == F.max(own)).alias("all_alike"))
    shared = shared.join(F.broadcast(whole), F.col("bucket") == F.col("b"), "left").filter("not is_hot or n > 1")
    shared = shared.withColumn("alike", F.coalesce("all_alike", "alike")).select(*ROW, *PIECE, "packed", "alike")

    distinct = shared.filter("not alike").groupBy(*PIECE).agg(F.min(F.struct(*ROW, "packed")).alias("one"), F.count("*").alias("copies"))
    wanted = distinct.select("one.rid", "one.tid", F.struct(*PIECE, "one.packed", "copies").alias("w")).groupBy(*ROW).agg(F.collect_list("w").alias("wanted"))
    cut = docs.join(wanted, ROW).select("text", "wanted")
    cut = materialise(cut.mapInArrow(_cut(length), "bucket long, piece long, piece2 int, left int, right int, copies long, bytes binary"))
    pieces, owners = small_buckets(cut, length, pick, most_pieces)
    pieces = pieces.select(*PIECE, "left", "right", "copies", "bytes").repartition("bucket").sortWithinPartitions("bucket")
    runs = pieces.mapInArrow(_build(length, pick, BATCH_PIECES), "bucket long, piece long, piece2 int, first int, last int")
    if owners is not None:
        runs = materialise(runs)
        theirs = runs.join(owners, PIECE).select(*[F.col(f"of_{c}").alias(c) for c in PIECE], "first", "last")
        runs = runs.join(owners.select(*PIECE), PIECE, "left_anti").unionByName(theirs)

    at = F.shiftright("packed", 16)
    left, right = F.shiftright("packed", 8).bitwiseAND(255), F.col("packed").bitwiseAND(255)
    whole = shared.filter("alike").select(*ROW, (at - left).alias("first"), (at - right + length).alias("after"))
    parts = shared.filter("not alike").select(*ROW, *PIECE, at.alias("at")).join(runs, PIECE)
    parts = parts.select(*ROW, (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last") + length).alias("after"))
    return whole.unionByName(parts).groupBy(*ROW).agg(F.collect_set(F.struct("first", "after")).alias("spans"))


def dedup(docs: DataFrame, length: int = LENGTH, pick: int = PICK, most_pieces: int = MOST_PIECES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    kind = dict(docs.dtypes)["doc_id"]
    text = no_text_as_empty(F.col("text"))
    # Rows of one id are told apart by their text; those without id by 96 bits of their text.
    number = F.col("doc_id").cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    rid = F.coalesce(number, F.xxhash64(F.lit(7), text))
    rows = docs.select(rid.alias("rid"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("tid"), "doc_id", text.alias("text"))
    spans = repeated_spans(rows, length, pick, most_pieces)
    joined = rows.join(spans, ROW, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
