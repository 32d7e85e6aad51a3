r"""Nearest neighbours by largest inner product, with a vantage-point tree for each shard.

Inner products become distances by one more component: with R the largest norm, a vector x stands for
(x, sqrt(R^2 - |x|^2)) and a query q for (q, 0); then |q - x|^2 = |q|^2 + R^2 - 2 q.x, so the nearest point has the largest
product, and the triangle inequality holds. A tree node keeps a vantage point and the median distance of its points to it;
nearer points go to one child, farther ones to the other. A query at distance d from the vantage point is at least
|d - median| away from everything in the other child. That child is skipped when `factor` times this bound exceeds the
distance of the k-th best so far: factor 1, the default, is exact search. R is the largest norm of the shard, so one long
vector loosens the bounds of its own shard only. Larger factors skip more and lose neighbours wherever norms differ: with R
far above most norms every query is about R away from every point, and a multiple of that bound skips nearly all.

The rows are dealt to shards by a hash of their id, so equal vectors spread evenly, and a shard's size is bounded. Inside a
shard equal vectors are one point with all their ids. A task holds one shard's tree and one batch of queries; each query
passes over all shards, and its best k of every shard are merged by one window. A leaf's products are first taken by matrix
multiplication; those that its rounding leaves in doubt are computed again one by one, always in one order of summation, and
only these decide, so equal vectors tie exactly, at any scale of the components; ties go to the smaller id.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, neither do rows
without id. A query meets vectors of its own length only, and no row of its own id. Of rows that repeat a query's id the
largest vector asks; rows equal in id and vector are one candidate, rows that repeat an id with other vectors are candidates
of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

K = 20
FACTOR = 1.0
#: Room for rounding in the comparison of distances, in parts of the largest distance.
SLACK = 1e-7
LEAF = 128
QUERY_EVERY = 20
#: A shard's rows at most, about; small tables get more and smaller shards, for the sake of parallel work.
SHARD_ROWS, LEAST_ROWS, FEW_SHARDS = 65_536, 1024, 12
QUERY_BATCH = 512


@dataclass
class Node:
    rows: np.ndarray | None = None
    vantage: np.ndarray | None = None
    median: float = 0.0
    near: Node | None = None
    far: Node | None = None


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The measure: inner products of paired rows, each summed in the same order wherever it is computed."""
    return (q * x).sum(axis=1)


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        # Equal vectors are one point; points in order of their smallest id, ids ascending inside a point.
        raw = np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").ravel()
        _, first, point = np.unique(raw, return_index=True, return_inverse=True)
        order = np.lexsort((ids, point))
        same = (point[order][1:] == point[order][:-1]) & (ids[order][1:] == ids[order][:-1])
        order = order[np.concatenate(([True], ~same))] if len(order) else order
        cut = np.searchsorted(point[order], np.arange(len(first) + 1))
        by_id = np.argsort(ids[order][cut[:-1]], kind="stable")
        self.x, self.leaf = vectors[first][by_id], leaf
        self.ids = [ids[order[cut[p] : cut[p + 1]]] for p in by_id.tolist()]
        self.radius = float(np.sqrt(np.einsum("ij,ij->i", self.x, self.x).max())) * (1 + 1e-12)
        self.lift = np.sqrt(np.maximum(self.radius**2 - np.einsum("ij,ij->i", self.x, self.x), 0.0))
        self.root = self._build(np.arange(len(self.x)), np.random.Generator(np.random.PCG64(len(ids))))

    def _build(self, rows: np.ndarray, rng: np.random.Generator) -> Node:
        if len(rows) <= self.leaf:
            return Node(rows=rows)
        # Of a few points take the one whose distances spread most.
        best = (-1.0, rows[0], None)
        for v in rng.choice(rows, min(4, len(rows)), replace=False):
            d = self._between(v, rows)
            best = max(best, (float(d.std()), v, d), key=lambda t: t[0])
        _, v, d = best
        median = float(np.median(d))
        near = d <= median
        if near.all():  # many equal points
            near = d < median
            if not near.any():
                return Node(rows=rows)
        return Node(vantage=np.append(self.x[v], self.lift[v]), median=median, near=self._build(rows[near], rng), far=self._build(rows[~near], rng))

    def _between(self, v: int, rows: np.ndarray) -> np.ndarray:
        d = self.x[rows] - self.x[v]
        return np.sqrt(np.einsum("ij,ij->i", d, d) + (self.lift[rows] - self.lift[v]) ** 2)

    def search(self, own: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k nearest of each query, and how many points each was compared with; own: the queries' ids."""
        # One point more than k, as one may hold nothing but the query's own id.
        self.k = k + 1
        self.best = np.full((len(q), self.k), -1, np.int64)
        self.score = np.full((len(q), self.k), -np.inf)
        self.seen = np.zeros(len(q), np.int64)
        self.q, self.factor = q, factor
        norm = np.sqrt(np.einsum("ij,ij->i", q, q))
        self.square = norm**2 + self.radius**2
        self.doubt = 4 * (q.shape[1] + 4) * np.finfo(float).eps * norm * self.radius
        self._visit(self.root, np.arange(len(q)))
        who, ids, scores = [], [], []
        for i in range(len(q)):
            at = [p for p in self.best[i].tolist() if p >= 0]
            mine = [self.ids[p][: k + 1] for p in at]
            if not mine:
                continue
            found, score = np.concatenate(mine), np.repeat(self.score[i, : len(at)], [len(m) for m in mine])
            other = found != own[i]
            found, score = found[other], score[other]
            order = np.lexsort((found, -score))[:k]
            who.append(np.full(len(order), i))
            ids.append(found[order])
            scores.append(score[order])
        joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((who, np.int64), (ids, np.int64), (scores, np.float64))]
        return *joined, self.seen

    def _visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.rows is not None:
            self._scan(node.rows, who)
            return
        v = node.vantage
        d = np.sqrt(np.maximum(self.square[who] + (v @ v - self.radius**2) - 2 * (self.q[who] @ v[:-1]), 0.0))
        inner = d <= node.median
        bound = np.abs(d - node.median) * self.factor
        self._visit(node.near, who[inner])
        self._visit(node.far, who[~inner])
        kth = self.score[who, self.k - 1]
        tau = np.where(np.isfinite(kth), np.sqrt(np.maximum(self.square[who] - 2 * np.where(np.isfinite(kth), kth, 0.0), 0.0)), np.inf)
        again = bound <= tau + SLACK * np.sqrt(self.square[who])
        self._visit(node.far, who[inner & again])
        self._visit(node.near, who[~inner & again])

    def _scan(self, rows: np.ndarray, who: np.ndarray) -> None:
        self.seen[who] += len(rows)
        for lo in range(0, len(rows), 2048):
            part, k = rows[lo : lo + 2048], self.k
            rough = self.q[who] @ self.x[part].T
            both = np.concatenate((self.score[who], rough), axis=1)
            kth = np.partition(both, -k, axis=1)[:, -k]
            # Twice the doubt: the k-th itself is rough, too.
            i, j = np.nonzero(rough >= (kth - 2 * self.doubt[who])[:, None])
            exact = np.concatenate([products(self.q[who[i[at : at + 65_536]]], self.x[part[j[at : at + 65_536]]]) for at in range(0, len(i), 65_536)]) if len(i) else np.zeros(0)
            held_i, held_j = np.nonzero(self.best[who] >= 0)
            query = np.concatenate((held_i, i))
            point = np.concatenate((self.best[who][held_i, held_j], part[j]))
            score = np.concatenate((self.score[who][held_i, held_j], exact))
            order = np.lexsort((point, -score, query))
            query, point, score = query[order], point[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            keep = place < k
            best, kept = np.full((len(who), k), -1, np.int64), np.full((len(who), k), -np.inf)
            best[query[keep], place[keep]], kept[query[keep], place[keep]] = point[keep], score[keep]
            self.best[who], self.score[who] = best, kept


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


SCHEMA = "query_id long, vec_id long, score double, looked_at long"


def _search(k: int, factor: float):
    """Rows (group, kind, id, vector), sorted by group and kind: a shard's vectors (kind 0), then its queries (kind 1)."""

    def answer(tree: Tree, ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        who, found, score, seen = tree.search(ids, q, k, factor)
        return pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(found), pa.array(score), pa.array(seen[who])], names=["query_id", "vec_id", "score", "looked_at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, tree = None, [], None
        for batch in batches:
            groups, kinds, ids = (np.asarray(batch.column(i)) for i in range(3))
            cuts = np.flatnonzero((groups[1:] != groups[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if lo == hi:
                    continue
                if groups[lo] != group:
                    group, parts, tree = groups[lo], [], None
                x = _matrix(batch.column(3).slice(lo, hi - lo))
                if kinds[lo] == 0:
                    parts.append((ids[lo:hi], x))
                    continue
                if tree is None and parts:
                    tree = Tree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                    parts = []
                if tree is not None:
                    for at in range(0, hi - lo, QUERY_BATCH):
                        yield answer(tree, ids[lo + at : min(hi, lo + at + QUERY_BATCH)], x[at : at + QUERY_BATCH])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, query_every: int = QUERY_EVERY, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors: vec_id, embedding. Returns query_id, rank, vec_id, score, looked_at (rows compared in the neighbour's shard)."""
    rows = usable(vectors)
    n = rows.count()
    shards = max(1, -(-n // shard_rows), min(FEW_SHARDS, n // LEAST_ROWS))
    group = lambda shard: F.struct(F.size("v").alias("dim"), shard.alias("shard"))
    data = rows.select(group(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).alias("g"), F.lit(0).alias("kind"), "id", "v")
    asks = rows.filter(F.col("id") % query_every == 0).groupBy("id").agg(F.max("v").alias("v"))
    asks = asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(group(F.col("shard")).alias("g"), F.lit(1).alias("kind"), "id", "v")
    both = data.unionByName(asks).select((F.col("g.dim").cast("long") * 2**32 + F.col("g.shard")).alias("g"), "kind", "id", "v")
    dealt = both.repartition("g").sortWithinPartitions("g", "kind", "id")
    found = dealt.mapInArrow(_search(k, factor), SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "looked_at")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (query_id, vec_id) that were found."""
    total = exact.count()
    return found.join(exact, ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0


def op1_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")
