r"""Toxicity by a lexicon, found with its misspellings, and by the words around each find.

Learning (from labelled rows outside the held-out fold only, at most TRAIN_ROWS of them, taken in hash order):

1. Words of toxic and other texts are counted by text, equal texts once. Words that stand mainly in toxic texts are the
   lexicon. It has no cap of its own: the sample bounds it, as each word has to stand in LEAST_SHARE of its toxic texts.
2. The lexicon becomes a trie. Its intersection with Levenshtein automata (one edit; words of five letters or more) is
   made deterministic while it is used: a state is the set of (trie node, edits so far), and a word runs through it letter
   by letter until it is accepted or no term can follow any more.
3. Each find is put by its context window into one of three: quoted (quotation marks around it, or words of report before
   it), aimed (an address such as "you" in the window), or plain. Exact and misspelled finds of each kind are counted, and
   a logistic regression weighs these counts.

Scoring reads the text only. Labels, lang, source and doc_id take no part in a score.

Defined results: null and empty texts have no finds and get the score of a text without finds; without any label, or with
labels of one class, the score is the smoothed share of toxic labels; labels that are null are left out, and of several
labels of one document the toxic one counts; rows that repeat a doc_id are scored each by its text.

Memory: the sample, the lexicon and the model are bounded by parameters and go to the executors as such; each worker keeps a
bounded table of words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, no_text_as_empty, table

FOLDS = 5
TRAIN_ROWS = 20_000
#: A lexicon word stands in this many toxic texts at least, and in this share of them.
LEAST_TEXTS, LEAST_SHARE = 6, 0.005
#: And its odds in toxic texts are so many times those in others.
LEAST_ODDS = 12.0
LEAST_FUZZY = 5
AROUND = 6
MOST_WORDS = 100_000
#: Texts that are Python strings at a time.
STRETCH = 256

#: Signs put for letters, words of report and of address.
LEET = str.maketrans("0134578@$!", "oieastbasi")
REPORT = frozenset("said says say wrote writes quoted quote called calls word term slur dijo dice sagte sagt schrieb dit disait".split())
ADDRESS = frozenset("you your yours youre u ur tu du usted dein deine ton vous".split())
QUOTES = "\"“”«»„‘’"
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
N_FEATURES = 8


@dataclass
class Lexicon:
    """A trie with its one-edit automaton, determinised on demand."""

    terms: list[str]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[int] = field(default_factory=lambda: [-1])

    def __post_init__(self):
        for t, term in enumerate(self.terms):
            node = 0
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][letter]
            self.ends[node] = t
        self.states: list[frozenset[tuple[int, int]]] = []
        self.ids: dict[frozenset[tuple[int, int]], int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.start = self._state(self._with_insertions({(0, 0)}))

    def _with_insertions(self, state: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """Adds what a letter left out of the word leads to; keeps the least edits for each node."""
        least: dict[int, int] = {}
        for node, edits in state:
            least[node] = min(edits, least.get(node, 2))
        for node, edits in list(least.items()):
            if edits == 0:
                for child in self.children[node].values():
                    least[child] = min(1, least.get(child, 2))
        return frozenset(least.items())

    def _state(self, state: frozenset[tuple[int, int]]) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            found = [(edits, self.ends[node]) for node, edits in state if self.ends[node] >= 0 and (edits == 0 or len(self.terms[self.ends[node]]) >= LEAST_FUZZY)]
            self.accepts.append(0 if not found else 2 if min(found)[0] == 0 else 1)
        return self.ids[state]

    def _step(self, state: int, letter: str) -> int:
        after = set()
        for node, edits in self.states[state]:
            if letter in self.children[node]:
                after.add((self.children[node][letter], edits))
            if edits == 0:
                after.add((node, 1))  # a letter too many
                after.update((child, 1) for child in self.children[node].values())  # another letter
        to = self._state(self._with_insertions(after)) if after else -1
        self.steps[state][letter] = to
        return to

    def match(self, word: str) -> int:
        """2: a term; 1: one edit from a term of LEAST_FUZZY letters or more; 0: neither."""
        state = self.start
        for letter in word:
            to = self.steps[state].get(letter)
            if to is None:
                to = self._step(state, letter)
            if to < 0:
                return 0
            state = to
        found = self.accepts[state]
        return 0 if found == 1 and len(word) < LEAST_FUZZY - 1 else found


class Reader:
    """Features of texts; one for each task."""

    def __init__(self, terms: list[str]):
        self.lexicon = Lexicon(terms)
        self.known: dict[str, int] = {}

    def kind(self, raw: str) -> int:
        word = _EDGES.sub("", raw)
        found = self.lexicon.match(word)
        if found < 2 and not word.isalpha():
            plain = _EDGES.sub("", raw.translate(LEET))
            found = max(found, min(1, self.lexicon.match(plain)))
        if len(self.known) >= MOST_WORDS:
            self.known.clear()
        self.known[raw] = found
        return found

    def features(self, text: str) -> list[float]:
        words, known, kind = text.lower().split(), self.known, self.kind
        hits = [(i, f) for i, w in enumerate(words) if (f := known[w] if w in known else kind(w))]
        out = [0.0] * N_FEATURES
        if hits:
            counts = [0] * 6
            for i, found in hits:
                before, after = words[max(0, i - AROUND) : i], words[i + 1 : i + 1 + AROUND]
                bare = {_EDGES.sub("", w) for w in (*before, *after)}
                opened = sum(w.count(q) for w in (*before, words[i]) for q in QUOTES) and sum(w.count(q) for w in (words[i], *after) for q in QUOTES)
                where = 1 if opened or bare & REPORT else 2 if bare & ADDRESS else 0
                counts[where + 3 * (found == 1)] += 1
            out[:6] = [math.log1p(c) for c in counts]
            exact = sum(counts[:3])
            out[6] = 1.0 if exact else 0.0
            out[7] = math.log1p(1000 * exact / len(words))
        return out


def texts_of(column: pa.Array) -> Iterator[str | None]:
    for lo in range(0, len(column), STRETCH):
        yield from column.slice(lo, STRETCH).to_pylist()


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the constant last and without penalty (Newton steps)."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    # A pseudo-label of each class keeps the constant finite.
    x = np.vstack((x, np.eye(x.shape[1])[[-1, -1]]))
    y = np.concatenate((y, [0.0, 1.0]))
    keep = np.full(len(w), penalty)
    keep[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - keep * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), grad)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic: at most `rows` labelled texts outside the held-out fold, equal texts once."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # Bounded by `rows`, so it can be sent to every task; the texts are not shuffled to find it.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = docs.select("doc_id", no_text_as_empty(F.col("text")).alias("text")).join(F.broadcast(chosen.withColumnRenamed("doc_id", "d")), F.col("doc_id") == F.col("d"))
    return joined.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.max("toxic").alias("toxic")).select("text", "toxic")


def learn_lexicon(sample: DataFrame) -> list[str]:
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return []
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    counts = sample.select("toxic", F.explode(words).alias("word")).filter(F.length("word").between(3, 40)).groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1))
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * bad))
    chosen = counts.filter((F.col("bad") >= least) & (odds >= LEAST_ODDS)).orderBy((F.log(odds) * F.col("bad")).desc(), "word")
    return [r.word for r in chosen.collect()]


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    weights: tuple[float, ...]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sample = materialise(training_sample(docs, labels, rows))
    terms = learn_lexicon(sample)
    seen = sample.mapInArrow(_features(terms), "toxic int, f array<double>").collect()
    if not seen:
        return Model((), (0.0,) * N_FEATURES + (0.0,))
    x, y = np.array([r.f for r in seen], float), np.array([r.toxic for r in seen], float)
    order = np.lexsort((*x.T, y))  # the sums don't depend on the order of the rows
    return Model(tuple(terms), tuple(float(w) for w in fit(x[order], y[order])))


def _features(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms)
        for batch in batches:
            rows = [reader.features(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "f"])

    return run


class Scorer:
    """Scores of texts; one for each task."""

    def __init__(self, model: Model):
        self.reader, self.weights, self.memo = Reader(list(model.terms)), model.weights, {}

    def score(self, text: str) -> float:
        f = tuple(self.reader.features(text))
        if f not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            z = sum(a * b for a, b in zip(f, self.weights, strict=False)) + self.weights[-1]
            self.memo[f] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return self.memo[f]


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            out = [scorer.score(t) for t in texts_of(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, and score."""
    rows = docs.select(*keep, no_text_as_empty(F.col("text")).alias("_text"))
    schema = rows.drop("_text").schema.add("score", "double")
    return rows.mapInArrow(_scores(model), schema)


def _clean(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            keep = [scorer.score(t or "") < 0.5 for t in texts_of(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose text scores 0.5 or more. A model that has learnt no term rejects nothing."""
    if not model.terms:
        return docs
    return docs.mapInArrow(_clean(model, docs.columns.index("text")), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
