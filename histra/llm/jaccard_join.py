r"""N-gram Jaccard self-join with a size-aware split into light and heavy sets.

A text's set holds its distinct five-word shingles. Two different sets link when 100 * intersection >= 80 * union. The
shingles have one global order: shingles of few texts first (by a sketch of bounded size that finds the very frequent
ones), then by hash. Linked sets of n and m shingles share at least l shingles among their first n - ceil(0.8 n) + l.

* Light sets (small ones) enumerate all subsets of two shingles of that prefix (l = 2) as keys: few keys, and selective.
* Heavy sets put each shingle of the prefix (l = 1) into an inverted list, and lists are scanned.
* The boundary is the size at which the summed cost (rows for subsets, rows and scanned postings for lists), over the
  histogram of the sizes of all sets, is least. Light sets within 0.8 of it go into the lists too, so they meet heavy ones.

Sets that are equal are one class before anything else, so copies are never expanded. A list is not expanded to all its
pairs either: first every member is held against one pivot of its lists, which is linear in the members; links join to components; then only pairs of a list whose components still
differ and that were not compared yet are compared. Every pair that shares a key is in the end either in one component
or was compared, so no link between different texts is lost to the components.

Pairs are first held against an upper bound that is never below the truth: hashes are counted in about n / 4 cells, and two
sets have at most the sum of the smaller counts in common. Cells take a thirtieth of a set's bytes and drop the pairs that
have a passage, but not 80 %, in common. What remains is compared exactly, on the sets of 64-bit shingle hashes. Words are
hashed with a mixing function and a key, not by a polynomial, and sets are one class only if two hashes of them agree, 128 bits;
of a single shingle, which is one word at the least, the second hash is of its words anew.

Defined results: null and empty texts and texts without words have no shingles and link with nothing (component_id is
their own doc_id); texts of one to four words have one shingle, the whole sequence; rows without doc_id link with nothing;
rows that repeat a doc_id are judged each by its own text. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textnum
from .common import materialise, table
from .components import connected_components

WIDTH = 5
#: What equal sets have in common: two hashes and the size.
CLASS = ["h", "h2", "n"]
#: Links need PART / WHOLE of the union in common.
PART, WHOLE = 4, 5
#: Cells of the frequency sketch; a shingle enters it with its count when so many sets of one task's stretch have it.
CELL_BITS = 20
FREQUENT = 4
HELD_SHINGLES = 2_000_000
#: Cost of scanning a posting, in rows.
SCAN_COST = 2.0
#: Sizes that the cost is worked out for. It does not bind: with k shingles in the prefix, subsets cost k (k + 1) / 2 and lists
#: k (1 + SCAN_COST), so from k = 6, a size of about 25, a set is dearer as a light one whatever the histogram.
MOST_LIGHT = 64
#: Lists up to this length make their open pairs by a join, others in blocks of so many members.
SHORT_LIST, BLOCK = 128, 2048
#: The filter for fetching sets: 4 MB.
BLOOM_BITS, BLOOM_HASHES = 1 << 25, 3


def _needed(n: int) -> int:
    """Least intersection of a set of n with any set that it links with."""
    return -(-PART * n // WHOLE)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def counted_cells(own: np.ndarray) -> bytes:
    """Counts of a set's hashes in 2^k cells, a byte each; nothing if a count doesn't fit."""
    k = max(0, (len(own) // 4).bit_length())
    counts = np.bincount((own >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k) if k else np.array([len(own)])
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def may_link(x: bytes, y: bytes) -> bool:
    """False only if two sets with these cells can't link."""
    if not x or not y:
        return True
    a, b = np.frombuffer(x, np.uint8).astype(np.int32), np.frombuffer(y, np.uint8).astype(np.int32)
    while len(a) > len(b):
        a = a[0::2] + a[1::2]
    while len(b) > len(a):
        b = b[0::2] + b[1::2]
    most = int(np.minimum(a, b).sum())
    return WHOLE * most >= PART * (int(a.sum() + b.sum()) - most)


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.array([may_link(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)


def plausible(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """pairs: a, b; cells: id, cells. The pairs that the bound leaves."""
    left = cells.select(F.col("id").alias("a"), F.col("cells").alias("x"))
    right = cells.select(F.col("id").alias("b"), F.col("cells").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_may_link, "a long, b long")


def _frequent(sets: list[np.ndarray]) -> np.ndarray:
    """Summed counts by cell of the shingles that several of these sets have."""
    values, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    often = counts >= FREQUENT
    return np.bincount(_cells(values[often]), weights=counts[often], minlength=1 << CELL_BITS).astype(np.int64)


def _within_bound(left: list[tuple], right: list[tuple], same: bool) -> Iterator[tuple[int, int]]:
    """Pairs (smaller id, larger id) of two blocks of one list that may link and lie in different components. Members are
    (id, component, cells)."""

    def by_depth(rows: list[tuple]) -> dict[int, tuple]:
        out: dict[int, list[tuple]] = {}
        for row in rows:
            out.setdefault(len(row[2]), []).append(row)
        return {d: (np.array([r[0] for r in x]), np.array([r[1] for r in x]), np.stack([np.frombuffer(r[2], np.uint8) for r in x]).astype(np.int16) if d else None) for d, x in out.items()}

    ls, rs = by_depth(left), by_depth(right)
    for d, (ids, comps, x) in ls.items():
        for e, (others, other_comps, y) in rs.items():
            if not d or not e:  # a set without cells may link with any
                ask = [(i, others[(other_comps != comps[i]) & ((others > ids[i]) if same else (others != ids[i]))]) for i in range(len(ids))]
            elif d > 4 * e or e > 4 * d:
                continue
            else:
                u, v = x, y
                while u.shape[1] > v.shape[1]:
                    u = u[:, 0::2] + u[:, 1::2]
                while v.shape[1] > u.shape[1]:
                    v = v[:, 0::2] + v[:, 1::2]
                total = v.sum(axis=1, dtype=np.int64)
                ask = []
                for i in range(len(ids)):
                    j = np.flatnonzero((other_comps != comps[i]) & ((others > ids[i]) if same else (others != ids[i])))
                    most = np.minimum(u[i], v[j]).sum(axis=1, dtype=np.int64)
                    ask.append((i, others[j[WHOLE * most >= PART * (int(u[i].sum()) + total[j] - most)]]))
            for i, found in ask:
                for o in found.tolist():
                    yield (min(int(ids[i]), o), max(int(ids[i]), o))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, block, id, c, cells, keys), sorted by key, i, j. A pair is left to the first list that both are in."""

    def work(group: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, i, j = group
        left, right = [r[1:4] for r in rows if r[0] == i], [r[1:4] for r in rows if r[0] == j]
        keys = {r[1]: frozenset(r[4]) for r in rows}
        pairs = [(a, b) for a, b in _within_bound(left, right, i == j) if min(keys[a] & keys[b]) == key]
        for lo in range(0, len(pairs), 50_000):
            a, b = zip(*pairs[lo : lo + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    now, rows = None, []
    for batch in batches:
        for key, i, j, *member in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (key, i, j) != now:
                if rows:
                    yield from work(now, rows)
                now, rows = (key, i, j), []
            rows.append(tuple(member))
    if rows:
        yield from work(now, rows)


def blocked_pairs(lists: DataFrame, cells: DataFrame) -> DataFrame:
    """lists: key, id, c, m (length of the list). Pairs of members in different components that the bound leaves, found block
    by block: a task holds two blocks of BLOCK members at most, about."""
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    own = lists.groupBy("id").agg(F.collect_list("key").alias("keys"))
    rows = lists.join(cells.join(own, "id"), "id").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "id", "c", "cells", "keys")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_blocks, "a long, b long")


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, row_hash) in. A row (0, doc_id, size, two hashes, row_hash, cells) for each text, and rows (1, cell, count) for the task's frequent cells."""
    names = ["kind", "a", "b", "c", "d", "row_hash", "cells"]
    counts, held, size, seen = np.zeros(1 << CELL_BITS, np.int64), [], 0, set()
    for batch in batches:
        for lo, hi, data, offsets in textnum.text_slices(batch.column(1)):
            second: list[int] = []
            sets = textnum.shingle_sets(data, offsets, WIDTH, second)
            hashes = [textnum.set_hash(x) for x in sets]
            for h, own in zip(hashes, sets, strict=True):
                if h not in seen:
                    seen.add(h)
                    held.append(own)
                    size += len(own)
            if size >= HELD_SHINGLES:
                counts += _frequent(held)
                held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(hi - lo, np.int32)),
                    batch.column(0).slice(lo, hi - lo).cast(pa.int64()),
                    pa.array(np.array([len(x) for x in sets], np.int64)),
                    pa.array(hashes, pa.int64()),
                    pa.array(second, pa.int64()),
                    batch.column(2).slice(lo, hi - lo),
                    pa.array([counted_cells(x) for x in sets], pa.binary()),
                ],
                names=names,
            )
    counts += _frequent(held)
    often = np.flatnonzero(counts)
    if len(often):
        m = len(often)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(often), pa.array(counts[often]), *[pa.array(np.zeros(m, np.int64))] * 3, pa.nulls(m, pa.binary())], names=names)


def light_boundary(sizes: dict[int, int]) -> int:
    """Largest size of a light set; sizes: number of sets by size, for sizes up to MOST_LIGHT."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, sets in sizes.items():
            prefix = n - _needed(n) + 1
            if n <= boundary:
                total += sets * (prefix + 1) * prefix / 2
            if n > boundary or PART * boundary < WHOLE * n:
                total += sets * prefix * (1 + SCAN_COST)
        return total

    return min(range(MOST_LIGHT + 1), key=cost)


def prefix_keys(own: np.ndarray, levels: np.ndarray, boundary: int) -> np.ndarray:
    """64-bit keys of a set (sorted hashes). Keys that collide cost a comparison, nothing else."""
    n = len(own)
    if n < PART:  # a set of fewer shingles links with its equals only
        return np.zeros(0, np.int64)
    level = levels[_cells(own)]
    if level.any():
        own = own[np.lexsort((own, level))]
    k, out = n - _needed(n) + 1, np.zeros(0, np.int64)
    if n <= boundary:
        first = textnum.mix(np.sort(own[: k + 1]))
        i, j = np.triu_indices(len(first), 1)
        out = textnum.signed(textnum.mix(first[i] * np.uint64(3) + first[j] * np.uint64(5)))
    if n > boundary or PART * boundary < WHOLE * n:
        out = np.concatenate((out, textnum.signed(own[:k])))
    return out


def _keys(levels: np.ndarray, boundary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # a task puts equal sets into the lists once
        for batch in batches:
            for lo, hi, data, offsets in textnum.text_slices(batch.column(1)):
                ids, keys, docs, sizes = batch.column(0).slice(lo, hi - lo).to_pylist(), [], [], []
                second: list[int] = []
                sets = textnum.shingle_sets(data, offsets, WIDTH, second)
                for doc, own, other in zip(ids, sets, second, strict=True):
                    if doc is None or len(own) < PART or (h := (textnum.set_hash(own), other)) in seen:
                        continue
                    seen.add(h)
                    keys.append(prefix_keys(own, levels, boundary))
                    docs.append(np.full(len(keys[-1]), doc, np.int64))
                    sizes.append(np.full(len(keys[-1]), len(own), np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, docs, sizes)], names=["key", "doc", "n"])

    return run


def _bits(ids: np.ndarray) -> np.ndarray:
    """Places of ids in the filter: BLOOM_HASHES for each."""
    h = ids.astype(np.int64).view(np.uint64)
    return np.concatenate([textnum.mix(h + np.uint64(0x632BE59BD9B4E019 * (j + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(BLOOM_BITS) for j in range(BLOOM_HASHES)])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = np.unique(_bits(np.asarray(batch.column(0))))
        masks = textnum.signed(np.uint64(1) << (bits & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array((bits >> np.uint64(6)).astype(np.int64)), pa.array(masks)], names=["word", "mask"])


def _sets(words: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if words is not None:
                ids = np.asarray(batch.column(0).fill_null(-1))
                bits = _bits(ids)
                hit = (words[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1)
                batch = batch.filter(pa.array(hit.reshape(BLOOM_HASHES, len(ids)).all(axis=0)))
            for lo, hi, data, offsets in textnum.text_slices(batch.column(1)):
                sets = [x.tobytes() for x in textnum.shingle_sets(data, offsets, WIDTH)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def fetch_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, shingles of the documents in ids (column need, distinct), maybe of some others.

    A Bloom filter of fixed size goes to the scan, which then emits wanted sets only, and no text is shuffled. When ids are
    too many for the filter, texts are joined with them instead; either way all wanted sets come.
    """
    if ids.count() > BLOOM_BITS // 16:
        kept = docs.join(ids, F.col("doc_id") == F.col("need"), "left_semi")
        return kept.mapInArrow(_sets(None), "id long, shingles binary")
    words = np.zeros(BLOOM_BITS // 64, np.uint64)
    for word, mask in ids.mapInArrow(_words, "word long, mask long").groupBy("word").agg(F.bit_or("mask")).collect():
        words[word] = np.uint64(mask & 0xFFFFFFFFFFFFFFFF)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sets(shared.value)(batches)

    return docs.mapInArrow(scan, "id long, shingles binary")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate((x, y)))
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            linked.append(WHOLE * common >= PART * (len(both) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def compare(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs: a, b (materialised, distinct). Adds linked."""
    need = pairs.select(F.col("a").alias("need")).union(pairs.select("b")).distinct()
    sets = fetch_sets(docs, need)
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")).join(pairs.select("a").distinct(), "a", "left_semi")
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(_compare, "a long, b long, linked boolean")


def sizes_can_link(n: Column, m: Column) -> Column:
    return (PART * n <= WHOLE * m) & (PART * m <= WHOLE * n)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return judged(docs).drop("row_hash")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash (of the text), n_shingles, component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = docs.withColumn("row_hash", F.xxhash64("text"))
    seen = materialise(hashed.mapInArrow(_profile, "kind int, a long, b long, c long, d long, row_hash long, cells binary"))
    rows = seen.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("h"), F.col("d").alias("h2"), "row_hash", "cells")
    # A row's number is its doc_id; of rows that repeat an id with other texts all but one get numbers of their own.
    first = rows.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("row_hash").alias("first"), F.max("row_hash").alias("last"))
    repeated = materialise(first.filter("first <> last").select(F.col("doc_id").alias("rep"), "first"))
    unique = repeated.isEmpty()

    def numbered(df: DataFrame) -> DataFrame:
        if unique:
            return df.withColumn("uid", F.col("doc_id"))
        own = F.when(F.col("rep").isNull() | (F.col("row_hash") == F.col("first")), F.col("doc_id")).otherwise(F.xxhash64(F.lit(5), "doc_id", "row_hash"))
        return df.join(repeated, F.col("doc_id") == F.col("rep"), "left").withColumn("uid", own).drop("rep", "first")

    rows = numbered(rows)
    docs = docs if unique else numbered(hashed).select(F.col("uid").alias("doc_id"), "text")
    # At most 2^CELL_BITS rows of two longs.
    frequent = seen.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).toArrow()
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    levels[np.asarray(frequent["a"])] = np.ceil(np.log2(np.asarray(frequent["n"]) + 1)).astype(np.uint8)
    histogram = {r.n: r.sets for r in rows.filter(f"n between {PART} and {MOST_LIGHT}").groupBy("n").agg(F.count("*").alias("sets")).collect()}
    shared_levels = spark.sparkContext.broadcast(levels)

    classes = rows.filter("n > 0 and doc_id is not null").groupBy(*CLASS).agg(F.min("uid").alias("id"), F.max("cells").alias("cells"))
    classes = materialise(classes)
    cells = classes.select("id", "cells")
    boundary = light_boundary(histogram)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _keys(shared_levels.value, boundary)(batches)

    listed = docs.mapInArrow(keys, "key long, doc long, n int")
    by_key = Window.partitionBy("key")
    listed = listed.withColumn("low", F.min("doc").over(by_key)).withColumn("high", F.max("doc").over(by_key)).filter("low <> high").select("key", "doc", "n")
    # Members of lists by the id of their class.
    names = rows.drop("cells", "row_hash").join(classes.drop("cells"), CLASS).select(F.col("uid").alias("doc"), F.col("n").cast("int").alias("n"), "id").distinct()
    lists = listed.join(names, ["doc", "n"]).select("key", "id", "n").distinct()
    several = Window.partitionBy("key")
    lists = lists.withColumn("low", F.min("id").over(several)).withColumn("high", F.max("id").over(several)).filter("low <> high").select("key", "id", "n")

    # Pivot round: each member against one pivot. A list has a pivot for each band of sizes; members look at their own band
    # and its neighbours, which between them hold all sizes that can link. Pivots are the members that stand in the longest
    # lists: an original has all shingles that its edited copies kept, so copies that don't link with each other meet in it.
    lists = materialise(lists)
    lengths = lists.groupBy("key").agg(F.count("*").alias("length"))
    weights = materialise(lists.join(lengths, "key").groupBy("id").agg(F.sum("length").alias("weight")))
    band = F.floor(F.log(F.col("n") / 1.0) / F.log(F.lit(WHOLE / PART))).cast("int")
    looks = lists.select("key", "id", "n", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    pivots = lists.join(weights, "id").groupBy("key", band.alias("band")).agg(F.max(F.struct("weight", "id", "n")).alias("p"))
    pairs = looks.join(pivots, ["key", "band"]).filter((F.col("p.id") != F.col("id")) & sizes_can_link(F.col("n"), F.col("p.n")))
    pairs = plausible(pairs.select(F.col("p.id").alias("a"), F.col("id").alias("b")).distinct(), cells)
    best = pairs.join(weights.withColumnRenamed("id", "a"), "a").groupBy("b").agg(F.max(F.struct("weight", "a")).alias("p"))
    first = materialise(best.select(F.least("p.a", "b").alias("a"), F.greatest("p.a", "b").alias("b")).distinct())
    held = materialise(compare(first, docs))
    links = held.filter("linked").select("a", "b")
    # Lists whose members are in one component are done.
    labels = connected_components(links)
    labelled = lists.join(labels, lists.id == labels.node, "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    mixed = labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m")).filter("low <> high").select("key", "m")
    open_lists = materialise(labelled.join(mixed, "key"))

    # Last round: all pairs of open lists that lie in different components and were not compared. Pairs of short lists come
    # from a join; long lists are gone through in blocks, and only pairs that the bound leaves are made into rows.
    short = open_lists.filter(F.col("m") <= SHORT_LIST)
    other = short.select("key", F.col("id").alias("b"), F.col("n").alias("n2"), F.col("c").alias("c2"))
    few = short.join(other, "key").filter((F.col("id") < F.col("b")) & (F.col("c") != F.col("c2")) & sizes_can_link(F.col("n"), F.col("n2")))
    few = plausible(few.select(F.col("id").alias("a"), "b").distinct(), cells)
    many = blocked_pairs(open_lists.filter(F.col("m") > SHORT_LIST), cells)
    rest = materialise(few.unionByName(many).distinct().join(held.select("a", "b"), ["a", "b"], "left_anti"))
    more = materialise(compare(rest, docs)).filter("linked").select("a", "b")
    labels = connected_components(links.union(more))

    found = classes.drop("cells").join(labels, classes.id == labels.node, "left").select(*CLASS, F.coalesce("component", "id").alias("component"))
    out = rows.drop("cells", "uid").join(found, CLASS, "left")
    if not unique:
        smallest = out.filter("component is not null and doc_id is not null").groupBy(F.col("component").alias("c")).agg(F.min("doc_id").alias("smallest"))
        out = out.join(smallest, F.col("component") == F.col("c"), "left").withColumn("component", F.col("smallest"))
    return out.select("doc_id", "row_hash", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of smallest doc_id (and, of equal ids, of the smaller hash of the text) of each component, and of equal rows one.
    Rows without id and rows without words stay."""
    found = materialise(judged(docs).filter("n_shingles > 0 and doc_id is not null"))
    row = F.struct("doc_id", "row_hash")
    kept = found.groupBy("component_id").agg(F.min(row).alias("kept"))
    gone = found.join(kept, "component_id").filter(row != F.col("kept")).select(F.col("doc_id").alias("_jj_id"), F.col("row_hash").alias("_jj_gone")).distinct()
    mine = docs.withColumn("_jj_hash", F.xxhash64("text"))
    rest = mine.join(gone, (F.col("doc_id") == F.col("_jj_id")) & (F.col("_jj_hash") == F.col("_jj_gone")), "left_anti")
    repeated = materialise(found.groupBy(F.col("doc_id").alias("_jj_id"), F.col("row_hash").alias("_jj_gone")).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    if not repeated.isEmpty():
        same = (F.col("doc_id") == F.col("_jj_id")) & (F.col("_jj_hash") == F.col("_jj_gone"))
        several = rest.join(repeated, same, "left_semi")
        one = several.withColumn("_jj_n", F.row_number().over(Window.partitionBy("doc_id", "_jj_hash").orderBy(F.lit(1)))).filter("_jj_n = 1").drop("_jj_n")
        rest = rest.join(repeated, same, "left_anti").unionByName(one)
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """Small tables only: the pairs that share a shingle are written out."""
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS gs FROM w),
c AS (SELECT min(doc_id) AS id, any_value(gs) AS gs, len(any_value(gs)) AS n FROM (SELECT doc_id, list_sort(gs) AS gs FROM g WHERE len(gs) > 0) GROUP BY gs),
f AS (SELECT id, n, unnest(gs) AS s FROM c),
p AS (SELECT x.id AS a, y.id AS b FROM f x JOIN f y ON x.s = y.s AND x.id < y.id AND 4 * x.n <= 5 * y.n AND 4 * y.n <= 5 * x.n GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(id, to_id) AS (SELECT id, id FROM c UNION SELECT r.id, e.b FROM r JOIN e ON r.to_id = e.a),
m AS (SELECT id, min(to_id) AS component FROM r GROUP BY id),
k AS (SELECT list_sort(c.gs) AS gs, component FROM c JOIN m USING (id))
SELECT g.doc_id, len(g.gs)::BIGINT AS n_shingles, coalesce(k.component, g.doc_id)::BIGINT AS component_id FROM g LEFT JOIN k ON list_sort(g.gs) = k.gs AND len(g.gs) > 0"""
