r"""Packing of tokenised documents into windows by lexical retrieval.

A document is its ids by a public tokenizer, then one end id. Document frequencies, the number of documents and their mean
length are taken over the whole table. Documents are ordered by their terms of greatest BM25 impact, and this order is cut
into shards of bounded size, so that documents with the same leading terms meet in one shard; those without a useful term
stand together in order of a hash. A shard has a BM25 inverted index over its documents' ids. The first unused document in
order of doc_id is the seed of a window; it asks with all its terms, the index ranks the unused documents, and these fill
the window greedily: the best that fits whole, or, if none of the best 24 fits, the best one cut. What is cut off leads the
next window, as its seed. So every window but a shard's last is full.

Documents of different shards do not meet: the index is not one, and how many nearest neighbours that costs depends on how
well leading terms tell them.

Tokens of a text are looked up part by part: the tokenizer splits there before anything else, so the ids of a text are the ids
of its parts in a row. Each Python worker keeps a bounded table of parts.

Defined results: a null text counts as empty and is a piece of one id, the end; an empty table gives no pieces; rows that
repeat a doc_id are documents of their own, told apart by their text's hash in the order, and equal rows are packed twice.
Only doc_id and text are read. The same table gives the same pieces again, however it is partitioned.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum
from .common import materialise, no_text_as_empty, table

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 512
SHARD_CHARS = 2_000_000
#: BM25.
K1, B = 1.2, 0.75
NEIGHBOURS = 24
#: Leading terms that order the documents, bits of each in the order's key, and documents a shard whose keys make the cuts.
LEADING, TERM_BITS = 3, 21
SAMPLE_DOCS = 32
#: Parts in a worker's table; how many stay when it is full, and after a task.
MOST_WORDS, KEPT_WORDS, LASTING_WORDS = 600_000, 300_000, 300_000
#: Bytes of text that are cut into parts at a time.
SLICE_BYTES = 1 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Kinds of bytes: between words, space inside a word, letter, digit, other sign, and what makes a word be left to the tokenizer.
GAP, SPACE, LETTER, DIGIT, SIGN, ASIDE = range(6)


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds of single bytes and of the second bytes after C2 and C3, by the pattern of the tokenizer's file."""
    one = np.full(256, SIGN, np.uint8)
    for c in range(128):
        one[c] = GAP if chr(c) in " \n" else SPACE if 9 <= c <= 13 else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SIGN
    one[0xC4:] = ASIDE
    after = np.full((2, 256), SIGN, np.uint8)
    for c in range(0x80, 0x100):
        kind = SPACE if c in (0x85, 0xA0) else LETTER if chr(c).isalpha() else DIGIT if chr(c).isnumeric() else SIGN
        after[c >> 6 & 1, 0x80 | c & 0x3F] = kind
    return one, after[0], after[1]


class WordTokenizer:
    """Ids of texts. Texts are cut into parts (runs of letters, single digits, runs of other signs) as the tokenizer's own first step
    cuts them, by their bytes and many texts at a time; the tokenizer sees each different part once. Words with anything else in
    them (contractions, special tokens, characters from U+0100) are kept whole and left to the tokenizer.

    A part is known by a hash of 64 bits and confirmed by a second one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the unit of work
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode_batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        #: Which ids end a word, by the vocabulary's mark.
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kind, self.after_c2, self.after_c3 = _kinds()
        #: Known parts by their hash; for each its second hash and where its ids stand.
        self.slots: dict[int, int] = {}
        self.check, self.first, self.n_ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def trim(self, keep: int) -> None:
        """Only the first parts, which came first because they come often."""
        if len(self.slots) > keep:
            self.slots = dict(islice(self.slots.items(), keep))
            self.check, self.first, self.n_ids = self.check[:keep].copy(), self.first[:keep].copy(), self.n_ids[:keep].copy()
            self.ids = self.ids[: int(self.first[-1] + self.n_ids[-1])].copy() if keep else self.ids[:0]

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes in small letters, starts, ends, whether the part is a whole word left to the tokenizer) of a slice's texts."""
        n, kind, small = len(data), self.kind[data], textnum.LOWER_TABLE[data]
        for lead, table in ((0xC2, self.after_c2), (0xC3, self.after_c3)):
            at = np.flatnonzero(data == lead)
            kind[at] = kind[at + 1] = table[data[at + 1]]
            if lead == 0xC3:
                upper = at[(data[at + 1] < 0x9F) & (data[at + 1] != 0x97)] + 1
                small[upper] += 0x20
        # Bytes of wide characters are aside, and so is what may begin a contraction or a special token.
        wide = np.flatnonzero(kind == ASIDE)
        aside = [wide]
        for sign, then in ((0x27, b"stmrvld"), (0x3C, b"|")):
            at = np.flatnonzero(data[:-1] == sign)
            aside.append(at[np.isin(small[at + 1], np.frombuffer(then, np.uint8))])
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        marks = np.concatenate(aside)
        if len(marks):
            ink = kind != GAP
            begins = ink.copy()
            begins[1:] &= ~ink[:-1] | edge[1:-1]
            word = np.cumsum(begins)
            whole = np.zeros(int(word[-1]) + 1, bool)
            whole[word[marks]] = True
            whole = whole[word] & ink
            kind[whole] = ASIDE
            small[whole] = data[whole]
        # A new part begins where the kind changes, at each digit, and at each text.
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= edge[:-1] | ((kind == DIGIT) & ((data < 0x80) | (data >= 0xC0)))
        starts = np.flatnonzero(new)
        ends = np.concatenate((starts[1:], [n]))
        kinds = kind[starts]
        kept = kinds >= LETTER
        return small, starts[kept], ends[kept], kinds[kept] == ASIDE

    def _learn(self, hashes: np.ndarray, check: np.ndarray, words: list[str], whole: np.ndarray) -> None:
        order = np.argsort(whole, kind="stable")
        n, m = len(self.slots), int((~whole).sum())
        words = [words[i] for i in order.tolist()]
        ids, sizes = self._parts_ids(words[:m])
        more, more_sizes = self._whole_ids(words[m:])
        sizes = np.concatenate((sizes, more_sizes))
        self.slots.update(zip(hashes[order].tolist(), range(n, n + len(hashes)), strict=True))
        self.check = np.concatenate((self.check, check[order]))
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(sizes) - sizes))
        self.n_ids = np.concatenate((self.n_ids, sizes))
        self.ids = np.concatenate((self.ids, ids, more))

    def _whole_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all in a row, how many each has)."""
        found = [np.array(e.ids, np.uint32) for lo in range(0, len(words), 5000) for e in self.encode_batch(words[lo : lo + 5000], add_special_tokens=False)]
        return np.concatenate((np.zeros(0, np.uint32), *found)), np.array([len(x) for x in found], np.int64)

    def _parts_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are one part each: encoded many at a time and told apart by the ids that end a word."""
        parts = [words[lo : lo + 500] for lo in range(0, len(words), 500)]
        found, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for part, e in zip(parts, self.encode_batch([" ".join(part) for part in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            own = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(own) != len(part):
                ids, own = self._whole_ids(part)
            found.append(ids)
            sizes.append(own)
        return np.concatenate(found), np.concatenate(sizes)

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, n + 1 offsets into them)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        small, starts, ends, whole = self.parts(data, offsets)
        hashes = textnum.word_hashes(small, starts, ends) ^ whole.astype(np.uint64)
        different, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        check = textnum.word_hashes(small, starts[one], ends[one], 1)
        if len(self.slots) + len(different) > MOST_WORDS:
            self.trim(KEPT_WORDS)
        get = self.slots.get
        slot = np.array([get(h, -1) for h in different.tolist()], np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            at, raw = one[new], small.tobytes()
            words = [raw[i:j].decode() for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self._learn(different[new], check[new], words, whole[at])
            slot[new] = [get(h) for h in different[new].tolist()]
        if not np.array_equal(self.check[slot], check):
            raise RuntimeError("two parts have one hash")  # 1 in 2^64 for a pair; the task fails rather than give wrong ids
        slot = slot[which]
        sizes = self.n_ids[slot]
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(after) else 0
        ids = self.ids[np.repeat(self.first[slot] - after + sizes, sizes) + np.arange(total)]
        return ids, np.concatenate(([0], after))[np.searchsorted(starts, offsets)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of texts as bytes (little-endian unsigned 32-bit)."""
        out = []
        for _, _, data, offsets in textnum.text_slices(pa.array(texts, pa.string())):
            ids, at = self.encode_slice(data, offsets)
            out += [ids[i:j].astype("<u4").tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    """The Python worker's own, which lives on from task to task with its table of words."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


@dataclass
class Statistics:
    """Of the whole table: documents, their mean length, and how many documents have each id."""

    n: int
    mean: float
    df: np.ndarray

    def idf(self, terms: np.ndarray) -> np.ndarray:
        return np.log1p((self.n - self.df[terms] + 0.5) / (self.df[terms] + 0.5))

    def useful(self, terms: np.ndarray) -> np.ndarray:
        """Terms of most documents say little, and terms of one lead nowhere."""
        return (self.df[terms] > 1) & (2 * self.df[terms] <= max(self.n, 4))

    def norm(self, sizes: np.ndarray) -> np.ndarray:
        return K1 * (1 - B + B * sizes / self.mean)


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, count), in order of term and document."""
    n = len(docs)
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate(docs)
    narrow = np.int32 if (int(ids.max()) + 1) * n < 1 << 31 else np.int64  # half the bytes to sort
    pairs = ids.astype(narrow) * narrow(n) + np.repeat(np.arange(n, dtype=narrow), sizes)
    pairs.sort()
    edge = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1], [True])))
    return *np.divmod(pairs[edge[:-1]], narrow(n)), np.diff(edge)


def statistics_of(docs: list[np.ndarray]) -> Statistics:
    return Statistics(len(docs), float(np.mean([len(d) for d in docs])), np.bincount(term_counts(docs)[0]))


def leading_terms(docs: list[np.ndarray], whole: Statistics) -> np.ndarray:
    """A key for each document: its LEADING useful terms of greatest impact, the greatest first; 0 without any."""
    term, doc, count = term_counts(docs)
    use = whole.useful(term)
    term, doc, count = term[use].astype(np.int64), doc[use], count[use]
    impact = whole.idf(term) * count * (K1 + 1) / (count + whole.norm(np.array([len(d) for d in docs]))[doc])
    order = np.lexsort((term, -impact, doc))
    term, doc = term[order], doc[order]
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    key = np.zeros(len(docs), np.int64)
    for k in range(LEADING):
        at = place == k
        key[doc[at]] |= (term[at] + 1) % (1 << TERM_BITS) << (TERM_BITS * (LEADING - 1 - k))
    return key


class Index:
    """BM25 over the ids of a shard's documents, with the statistics of the whole table."""

    def __init__(self, docs: list[np.ndarray], whole: Statistics):
        self.n = n = len(docs)
        term, doc, count = term_counts(docs)
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1], [True])))
        df = np.diff(first)
        terms = term[first[:-1]]
        # Terms that no other document of the shard has find nothing.
        use = np.repeat((df > 1) & whole.useful(terms), df)
        self.slot, self.doc = np.repeat(np.arange(len(df)), df)[use], doc[use]
        norm = whole.norm(np.array([len(d) for d in docs]))
        self.impact = np.repeat(whole.idf(terms), df)[use] * count[use] * (K1 + 1) / (count[use] + norm[self.doc])
        order = np.argsort(self.doc, kind="stable")
        edge = np.searchsorted(self.doc[order], np.arange(n + 1))
        self.asks = np.split(self.slot[order], edge[1:-1])
        self.asked = np.zeros(len(df), bool)

    def nearest(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents with a common term, best first; ties to the earlier."""
        self.asked[self.asks[seed]] = True
        hit = np.flatnonzero(self.asked[self.slot])
        self.asked[self.asks[seed]] = False
        score = np.bincount(self.doc[hit], self.impact[hit], self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.lexsort((found, -score[found]))]


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, whole: Statistics | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces; the order of docs is the order of seeds."""
    index, n = Index(docs, whole or statistics_of(docs)), len(docs)
    used, first, sequence, offset = np.zeros(n, bool), 0, 0, 0
    open_doc, start = -1, 0  # a document whose rest leads the next window
    near: list[int] = []
    while True:
        if offset == 0 or not near:
            if open_doc < 0:
                while first < n and used[first]:
                    first += 1
                if first == n:
                    return
                open_doc, start = first, 0
                used[first] = True
        room = window - offset
        if open_doc >= 0:
            doc, rest = open_doc, len(docs[open_doc]) - start
            length = min(rest, room)
            yield doc, start, length, sequence, offset
            offset += length
            open_doc, start = (doc, start + length) if rest > length else (-1, 0)
            if offset < window:
                near = index.nearest(doc, used).tolist()
        else:
            near = [d for d in near if not used[d]]
            if not near:
                continue
            fits = [d for d in near[:NEIGHBOURS] if len(docs[d]) <= room]
            open_doc, start = (fits or near)[0], 0
            used[open_doc] = True
            rest = len(docs[open_doc])
            length = min(rest, room)
            yield open_doc, 0, length, sequence, offset
            offset += length
            open_doc, start = (open_doc, length) if rest > length else (-1, 0)
        if offset == window:
            sequence, offset, near = sequence + 1, 0, []


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, shard long"


TOKENS = "doc_id long, text_hash long, octets long, size long, ids binary"


def _tokenise(path: str):
    """doc_id, text_hash, text to TOKENS; ids take two bytes each if the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from histra.llm import packing  # the module of the worker, not a copy that came with this function

        tokenizer = packing.worker_tokenizer(path)
        kind = "<u2" if len(tokenizer.ends) <= 1 << 16 else "<u4"
        end = np.array([END_ID], kind).tobytes()
        for batch in batches:
            for lo, hi, data, offsets in textnum.text_slices(batch.column(2), SLICE_BYTES):
                ids, at = tokenizer.encode_slice(data, offsets)
                ids = ids.astype(kind)
                raw = [ids[i:j].tobytes() + end for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                head = [batch.column(k).slice(lo, hi - lo) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(np.diff(offsets)), pa.array(np.diff(at) + 1), pa.array(raw, pa.binary())], names=[x.split()[0] for x in TOKENS.split(", ")])
        tokenizer.trim(LASTING_WORDS)

    return run


def _ids(sizes: pa.Array, raw: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, f"<u{len(x) // n}") for n, x in zip(sizes.to_pylist(), raw.to_pylist(), strict=True)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(0, np.int64)
    for part in (batch.slice(lo, 1024) for batch in batches for lo in range(0, batch.num_rows, 1024)):
        more = np.bincount(term_counts(_ids(part.column(0), part.column(1)))[0], minlength=len(df))
        more[: len(df)] += df
        df = more
    terms = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int64)), pa.array(df[terms])], names=["term", "df"])


def statistics(tokens: DataFrame) -> Statistics:
    n, total = tokens.agg(F.count("*"), F.sum("size")).first()
    # One row for each id of the vocabulary.
    found = tokens.select("size", "ids").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(int(found.term.max()) + 1, np.int64)
    df[found.term] = found.df
    return Statistics(n, total / n, df)


def _places(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Strings that sort by key, then by tie."""
    return np.stack((key.astype(">u8"), tie.astype(np.int64).view(np.uint64).astype(">u8")), axis=1).copy().view("S16").ravel()


def _key(whole: Statistics):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(lo, 1024) for batch in batches for lo in range(0, batch.num_rows, 1024)):
            key = leading_terms(_ids(part.column(2), part.column(3)), whole)
            yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0), part.column(1)], names=["key", "tie", "octets"])

    return run


def _route(whole: Statistics, cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(lo, 1024) for batch in batches for lo in range(0, batch.num_rows, 1024)):
            tie, size, raw, *ids = part.columns
            key = leading_terms(_ids(size, raw), whole)
            shard = np.searchsorted(cuts, _places(key, np.asarray(tie)), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), *ids, size, raw], names=["shard", "doc_id", "text_hash", "size", "ids"])

    return run


def routed(tokens: DataFrame, whole: Statistics) -> DataFrame:
    """shard, doc_id, text_hash, size, ids. Which documents make the cuts depends on their hash only."""
    least = SHARD_CHARS // SHARD_DOCS
    weight = F.greatest("octets", F.lit(least))
    shards = -(-tokens.agg(F.sum(weight)).first()[0] // (least * SHARD_DOCS))
    tie = F.xxhash64(F.lit(17), F.coalesce("doc_id", F.lit(-1)), "text_hash")
    cuts = np.zeros(0, "S16")
    if shards > 1:
        every = max(1, whole.n // (shards * SAMPLE_DOCS))
        some = tokens.filter(F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(29)), F.lit(every)) == 0)
        found = some.select(tie.alias("tie"), "octets", "size", "ids").mapInArrow(_key(whole), "key long, tie long, octets long").toPandas()
        places = _places(found.key.to_numpy(), found.tie.to_numpy())
        order = np.argsort(places)
        ahead = np.cumsum(np.maximum(found.octets.to_numpy()[order], least))
        number = (ahead - 1) * shards // max(1, int(ahead[-1])) if len(ahead) else ahead
        cuts = places[order][1:][number[1:] != number[:-1]]
    return tokens.select(tie.alias("tie"), "size", "ids", "doc_id", "text_hash").mapInArrow(_route(whole, cuts), "shard long, doc_id long, text_hash long, size long, ids binary")


def _pack(window: int, whole: Statistics):
    def work(shard: int, ids: list, docs: list[np.ndarray]) -> pa.RecordBatch:
        rows = list(pack_shard(docs, window, whole))
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        crc = [zlib.crc32(docs[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in rows]
        sizes = np.array([len(d) for d in docs], np.int64)
        columns = [pa.array([ids[d] for d in doc], pa.int64()), start, length, np.array(crc, np.int64), sizes[doc], (shard << 32) + sequence, offset, np.full(len(doc), shard)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, docs = None, [], []
        for part in (batch.slice(lo, 256) for batch in batches for lo in range(0, batch.num_rows, 256)):
            for shard, doc_id, doc in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _ids(part.column(2), part.column(3)), strict=True):
                if shard != now and ids:
                    yield work(now, ids, docs)
                    ids, docs = [], []
                now = shard
                ids.append(doc_id)
                docs.append(doc)
        if ids:
            yield work(now, ids, docs)

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row for each piece; see SCHEMA."""
    path = path or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_text_as_empty(F.col("text")).alias("text"))
    tokens = materialise(rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_tokenise(path), TOKENS))
    if tokens.isEmpty():
        return docs.sparkSession.createDataFrame([], SCHEMA)
    whole = statistics(tokens)
    dealt = routed(tokens, whole).repartition("shard").sortWithinPartitions("shard", "doc_id", "text_hash").select("shard", "doc_id", "size", "ids")
    return dealt.mapInArrow(_pack(window, whole), SCHEMA)


def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
