"""Dependency graphs of histories as edge tables: (history_id, src, dst, type, key)."""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .history import BOTTOM, History, all_rows, floor_mod
from .validate import with_source

#: Places whose bits a task holds at once for each place of a history.
REACHED = 1 << 14


def kept(h: History) -> History:
    """h with its derived tables written once, for work that reads them many times."""
    return History(checkpointed(h.txns), checkpointed(h.ops), checkpointed(h.pred_reads), checkpointed(h.pred_inputs), h.initial)


def _edge(src: str, dst: str, kind: str, key: str | None = "key") -> list[Column]:
    return ["history_id", F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), (F.col(key) if key else F.lit(None).cast("string")).alias("key")]


def session_order(h: History) -> DataFrame:
    by_session = Window.partitionBy("history_id", "session").orderBy("so_pos")
    return h.txns.withColumn("next", F.lead("txn").over(by_session)).filter("next is not null").select(*_edge("txn", "next", "SO", None))


def write_read(h: History) -> DataFrame:
    found = with_source(h, h.reads()).filter("n_sources = 1 and src_txn <> txn")
    return found.select(*_edge("src_txn", "txn", "WR")).distinct()


def predicate_write_read(h: History) -> DataFrame:
    found = with_source(h, h.pred_inputs).filter("n_sources = 1 and src_txn <> txn")
    return found.select(*_edge("src_txn", "txn", "PR_WR")).distinct()


def final_writes(h: History) -> DataFrame:
    """One row for each key that a transaction writes, with its last value."""
    return h.versions().groupBy("history_id", "txn", "key").agg(F.max_by("value", "op_index").alias("value"))


def predicate_classes(h: History, keys: DataFrame | None = None) -> DataFrame:
    """For each predicate read and key that it covers: internal if the transaction wrote the key, or an earlier predicate read
    of it covered the key; else external."""
    keys = keys if keys is not None else h.initial.select("history_id", "key").distinct()
    covered = h.pred_reads.select("history_id", "txn", "op_index").join(keys, "history_id")
    lines = covered.withColumn("p", F.lit(True)).unionByName(h.writes().select("history_id", "txn", "op_index", "key").withColumn("p", F.lit(False)))
    before = Window.partitionBy("history_id", "txn", "key").orderBy("op_index").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.when(F.count("*").over(before) > 0, "INTERNAL").otherwise("EXTERNAL")
    return lines.withColumn("kind", kind).filter("p").select("history_id", "txn", "op_index", "key", "kind")


def write_choices(h: History) -> DataFrame:
    """Pairs of client transactions that write a key in common, one row for each pair and key: a < c."""
    w = h.writes().select("history_id", "key", "txn").distinct()
    other = w.withColumnRenamed("txn", "c")
    return w.withColumnRenamed("txn", "a").join(other, ["history_id", "key"]).filter("a < c").select("history_id", "a", "c", "key")


def coalesced_choices(h: History) -> DataFrame:
    """One choice for each pair: the keys it decides."""
    return write_choices(h).groupBy("history_id", "a", "c").agg(F.count("*").alias("n_keys"), F.array_join(F.sort_array(F.collect_set("key")), ",").alias("keys"))


def conditional_anti_dependencies(h: History) -> DataFrame:
    """Choosing a before c implies reader before c, for each reader of a's version of a key that c writes too."""
    wr = write_read(h).select("history_id", F.col("src").alias("a"), F.col("dst").alias("reader"), "key")
    w = h.writes().select("history_id", "key", F.col("txn").alias("c")).distinct()
    return wr.join(w, ["history_id", "key"]).filter("c <> a and c <> reader").select("history_id", "a", "c", "reader", "key").distinct()


def initial_anti_dependencies(h: History) -> DataFrame:
    """The bottom transaction comes first, so its choices are decided: its readers precede all writers of the key."""
    return conditional_anti_dependencies(h).filter(F.col("a") == BOTTOM).select(*_edge("reader", "c", "RW"))


def bottom_order(h: History) -> DataFrame:
    """The bottom transaction precedes every first transaction of a session."""
    return h.txns.filter("so_pos = 0").withColumn("b", F.lit(BOTTOM).cast("long")).select(*_edge("b", "txn", "SO", None))


def known_edges(h: History) -> DataFrame:
    parts = [session_order(h), bottom_order(h), write_read(h), predicate_write_read(h), initial_anti_dependencies(h)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("history_id", "type").agg(F.count("*").alias("edges"))


def compose(d: DataFrame, a: DataFrame) -> DataFrame:
    """Boolean product of two graphs: d then a."""
    left = d.select("history_id", "src", F.col("dst").alias("mid")).distinct()
    right = a.select("history_id", F.col("src").alias("mid"), "dst").distinct()
    return left.join(right, ["history_id", "mid"]).select("history_id", "src", "dst").distinct()


def unite(*graphs: DataFrame) -> DataFrame:
    rows = graphs[0].select("history_id", "src", "dst")
    for g in graphs[1:]:
        rows = rows.unionByName(g.select("history_id", "src", "dst"))
    return rows.distinct()


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder; a session on one machine gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="histra-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop by a checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _components(nexts: list[list[int]]) -> list[list[int]]:
    """The strongly connected components of a graph; those that a component leads to stand before it."""
    n = len(nexts)
    at, low, inside, line, found = [0] * n, [0] * n, [False] * n, [], []
    count = 0
    for root in range(n):
        if at[root]:
            continue
        walk = [(root, iter(nexts[root]))]
        count += 1
        at[root] = low[root] = count
        line.append(root)
        inside[root] = True
        while walk:
            v, rest = walk[-1]
            for u in rest:
                if not at[u]:
                    count += 1
                    at[u] = low[u] = count
                    line.append(u)
                    inside[u] = True
                    walk.append((u, iter(nexts[u])))
                    break
                if inside[u]:
                    low[v] = min(low[v], at[u])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == at[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(line.pop())
                        inside[part[-1]] = False
                    found.append(part)
    return found


def _reached(nexts: list[list[int]], parts: list[list[int]], lo: int, hi: int) -> list[int]:
    """For each place the bit set of the places from lo to hi - 1 that it leads to."""
    reach = [0] * len(nexts)
    for part in parts:
        bits = 0
        for v in part:
            for u in nexts[v]:
                bits |= reach[u]
                if lo <= u < hi:
                    bits |= 1 << u - lo
        for v in part:
            reach[v] = bits
    return reach


def _numbered(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """The names of places, and where each leads to."""
    names, flat = np.unique(np.concatenate((src, dst)), return_inverse=True)
    nexts = [[] for _ in names]
    for a, b in zip(flat[: len(src)].tolist(), flat[len(src) :].tolist(), strict=True):
        nexts[a].append(b)
    return names, nexts


def closure(edges: DataFrame) -> DataFrame:
    """Transitive closure (history_id, src, dst), history by history with bit sets in one task each, as joins would pair all paths
    with all paths."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, nexts = _numbered(rows["src"].to_numpy(), rows["dst"].to_numpy())
        reach = _reached(nexts, _components(nexts), 0, len(names))
        width = -(-len(names) // 8)
        bits = np.unpackbits(np.frombuffer(b"".join(r.to_bytes(width, "little") for r in reach), np.uint8).reshape(len(names), -1), axis=1, bitorder="little")
        src, dst = np.nonzero(bits[:, : len(names)])
        return pd.DataFrame({"history_id": rows["history_id"].iloc[0], "src": names[src], "dst": names[dst]})

    return unite(edges).groupBy("history_id").applyInPandas(run, "history_id long, src long, dst long")


def closure_sizes(edges: DataFrame) -> DataFrame:
    """history_id, pairs: how many pairs the closure has. They are counted where they are found, for REACHED places at a time. Edges
    without a history are in none and lead nowhere, so they count as they are."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["history_id"].isna().any():
            return pd.DataFrame({"history_id": pd.array([None], "Int64"), "pairs": [len(rows[["src", "dst"]].drop_duplicates())]})
        names, nexts = _numbered(rows["src"].to_numpy(), rows["dst"].to_numpy())
        parts = _components(nexts)
        pairs = sum(r.bit_count() for lo in range(0, len(names), REACHED) for r in _reached(nexts, parts, lo, lo + REACHED))
        return pd.DataFrame({"history_id": rows["history_id"].iloc[:1], "pairs": [pairs]})

    return edges.select("history_id", "src", "dst").groupBy("history_id").applyInPandas(run, "history_id long, pairs long")


def cyclic_histories(edges: DataFrame) -> DataFrame:
    """Histories with a cycle, and how many transactions remain when sources and sinks are peeled off again and again."""
    rest = checkpointed(unite(edges))
    n = rest.count()
    while True:
        fed = rest.select("history_id", F.col("dst").alias("src")).distinct()
        feeds = rest.select("history_id", F.col("src").alias("dst")).distinct()
        rest = checkpointed(rest.join(fed, ["history_id", "src"], "left_semi").join(feeds, ["history_id", "dst"], "left_semi").select("history_id", "src", "dst"))
        before, n = n, rest.count()
        if n == before:
            return rest.groupBy("history_id").agg(F.countDistinct("src").alias("on_cycles"))


def reduced(edges: DataFrame, txns: DataFrame) -> DataFrame:
    """Of a transaction's edges into one session only the first is kept; session order implies the others."""
    place = txns.select("history_id", F.col("txn").alias("dst"), "session", "so_pos")
    order = Window.partitionBy("history_id", "src", "session").orderBy("so_pos")
    return unite(edges).join(place, ["history_id", "dst"]).withColumn("r", F.row_number().over(order)).filter("r = 1").select("history_id", "src", "dst")


def precedence(h: History) -> DataFrame:
    """Closure of what is known without anti-dependencies: session order, the bottom first, and what reads came from."""
    return closure(unite(session_order(h), bottom_order(h), write_read(h), predicate_write_read(h)))


def confirmed_write_orders(h: History, before: DataFrame) -> DataFrame:
    """history_id, key, txn, position: the writers of keys whose order is total in `before` (history_id, src, dst), the bottom
    first. Keys with any two unordered writers, or two that precede one another, are left out."""
    w = h.versions().select("history_id", "key", "txn").distinct()
    pairs = before.join(w.withColumnRenamed("txn", "src"), ["history_id", "src"]).join(w.withColumnRenamed("txn", "dst"), ["history_id", "key", "dst"]).filter("src <> dst")
    ahead = pairs.groupBy("history_id", "key", F.col("dst").alias("txn")).agg(F.count("*").alias("n"))
    placed = w.join(ahead, ["history_id", "key", "txn"], "left").withColumn("position", F.coalesce("n", F.lit(0)))
    # A total order without cycles has one writer at each position 0 to m - 1.
    keys = placed.groupBy("history_id", "key").agg(F.count("*").alias("m"), F.countDistinct("position").alias("d"), F.max("position").alias("top")).filter("d = m and top = m - 1")
    return placed.join(keys.select("history_id", "key"), ["history_id", "key"], "left_semi").select("history_id", "key", "txn", "position")


def _external(h: History) -> DataFrame:
    return predicate_classes(h).filter("kind = 'EXTERNAL'").join(h.pred_reads, ["history_id", "txn", "op_index"]).drop("kind")


def _derived(txns: list, versions: list, reads: list, asked: list, inputs: list) -> set[tuple[int, int, str, str]]:
    """derived_condition_edges of one history, whose closure stays in the task: txns (txn, session, so_pos), versions (txn, op_index,
    key, value) with the bottom's, reads and inputs likewise, asked (txn, op_index, modulus, residue)."""
    source, final, by_session = defaultdict(list), {}, defaultdict(list)
    for txn, at, key, value in versions:
        source[key, value].append(txn)
        final[key, txn] = max(final.get((key, txn), (at, value)), (at, value), key=lambda x: x[0])
    for txn, session, place in txns:
        by_session[session].append((place, txn))
    from_one = lambda key, value: who[0] if None not in (key, value) and len(who := source.get((key, value), ())) == 1 else None
    edges = {(BOTTOM, txn) for txn, _, place in txns if place == 0}
    for line in by_session.values():
        line = [txn for _, txn in sorted(line)]
        edges.update(zip(line, line[1:], strict=False))
    edges |= {(src, txn) for txn, _, key, value in [*reads, *inputs] if (src := from_one(key, value)) not in (None, txn)}
    names = sorted({t for t, _, _ in txns} | {t for t, *_ in versions} | {t for e in edges for t in e})
    at = {t: i for i, t in enumerate(names)}
    nexts = [[] for _ in names]
    for a, b in edges:
        nexts[at[a]].append(at[b])
    reach = _reached(nexts, _components(nexts), 0, len(names))
    precedes = lambda a, b: reach[at[a]] >> at[b] & 1

    writers = defaultdict(list)
    for key, txn in final:
        writers[key].append(txn)
    orders = {}
    for key, who in writers.items():
        if len(order := _total_order(who, precedes)) == len(who):
            orders[key] = order
    covered = {key for txn, _, key, _ in versions if txn == BOTTOM}
    recorded = defaultdict(set)
    for txn, index, key, value in inputs:
        if (src := from_one(key, value)) is not None:
            recorded[txn, index, key].add(src)
    first_asked, first_written = {}, {}
    for txn, index, *_ in asked:
        first_asked[txn] = min(index, first_asked.get(txn, index))
    for txn, index, key, _ in versions:
        first_written[txn, key] = min(index, first_written.get((txn, key), index))
    found = set()
    for txn, index, modulus, residue in asked:
        if first_asked[txn] < index:
            continue
        for key in covered & orders.keys():
            if first_written.get((txn, key), index) < index:
                continue
            line = [w for w in orders[key] if w != txn]
            seen = [i for i, w in enumerate(line) if w in recorded.get((txn, index, key), ())]
            if not seen:
                earlier = [precedes(w, txn) for w in line]
                if not all(e or precedes(txn, w) for e, w in zip(earlier, line, strict=True)):
                    continue
                seen = [i for i, e in enumerate(earlier) if e]
            if not seen:
                continue
            frontier = line[seen[-1]]
            value = final[key, frontier][1]
            inside = value % modulus == residue
            found.add((frontier, txn, "PR_WR", key))
            for w in line[seen[-1] + 1 :]:
                other = final[key, w][1]
                if (other % modulus == residue) != inside or (inside and other != value):
                    found.add((txn, w, "PR_RW", key))
    return found


def _total_order(who: list[int], precedes) -> list[int]:
    """The writers in order; empty if it is not total, or has two that precede one another."""
    ahead = {w: sum(1 for v in who if v != w and precedes(v, w)) for w in who}
    return sorted(who, key=ahead.get) if sorted(ahead.values()) == list(range(len(who))) else []


def derived_condition_edges(h: History) -> DataFrame:
    """Edges of condition reads over keys with a confirmed write order: PR_WR from the writer whose version the reader sees (the
    recorded source, or else the last writer that precedes the reader, if every writer of the key stands on one side of it), and
    PR_RW from the reader to each later writer whose version would change the result. One history is one group: its closure is
    never a table, which would have as many rows as its transactions squared."""

    def run(rows: pa.Table) -> pa.Table:
        of = defaultdict(list)
        for kind, *row in zip(*[rows.column(c).to_pylist() for c in ("kind", "a", "b", "c", "d", "key")], strict=True):
            of[kind].append(row)
        point = lambda kind: [(a, b, key, c) for a, b, c, _, key in of[kind]]
        bottom = [(BOTTOM, 0, key, a) for a, _, _, _, key in of["0"]]
        found = sorted(_derived([r[:3] for r in of["t"]], point("w") + bottom, point("r"), [r[:4] for r in of["p"]], point("i")))
        src, dst, kinds, keys = zip(*found, strict=True) if found else ((),) * 4
        history = [rows.column("history_id")[0].as_py()] * len(found)
        return pa.table({"history_id": pa.array(history, pa.int64()), "src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "type": pa.array(kinds, pa.string()), "key": pa.array(keys, pa.string())})

    return all_rows(h).filter("history_id is not null").groupBy("history_id").applyInArrow(run, "history_id long, src long, dst long, type string, key string")


def condition_candidates(h: History, before: DataFrame | None = None) -> DataFrame:
    """For keys without a confirmed order that can bear on a condition read's result (an input, or some version satisfies the
    condition): edges both ways between the reader and each other writer."""
    before = before if before is not None else checkpointed(precedence(h))
    versions = h.versions()
    keys = versions.select("history_id", "key").distinct().join(confirmed_write_orders(h, before).select("history_id", "key").distinct(), ["history_id", "key"], "left_anti")
    reads = _external(h).join(keys, ["history_id", "key"])
    lines = reads.join(versions.select("history_id", "key", F.col("txn").alias("w"), "value"), ["history_id", "key"])
    op = ["history_id", "txn", "op_index", "key"]
    satisfying = lines.filter(floor_mod(F.col("value"), F.col("modulus")) == F.col("residue")).select(*op).distinct()
    bears = satisfying.unionByName(h.pred_inputs.select(*op)).distinct()
    pairs = lines.join(bears, op, "left_semi").filter("w <> txn").select("history_id", "txn", "w", "key").distinct()
    wr = pairs.select("history_id", F.col("w").alias("src"), F.col("txn").alias("dst"), F.lit("PR_WR").alias("type"), "key")
    return wr.unionByName(pairs.select("history_id", F.col("txn").alias("src"), F.col("w").alias("dst"), F.lit("PR_RW").alias("type"), "key"))


def closed_choices(h: History, before: DataFrame) -> DataFrame:
    """One round of pruning: pairs of writers of a common key, and which sides would close a cycle with `before`. A pair with
    both sides closed has no order at all; with one, the other is forced."""
    pairs = write_choices(h).select("history_id", "a", "c").distinct()
    against = before.select("history_id", F.col("src").alias("c"), F.col("dst").alias("a"), F.lit(True).alias("no_ac"))
    along = before.select("history_id", F.col("src").alias("a"), F.col("dst").alias("c"), F.lit(True).alias("no_ca"))
    found = pairs.join(against, ["history_id", "a", "c"], "left").join(along, ["history_id", "a", "c"], "left")
    closed = F.coalesce("no_ac", F.lit(False)), F.coalesce("no_ca", F.lit(False))
    state = F.when(closed[0] & closed[1], "impossible").when(closed[1], "a first").when(closed[0], "c first").otherwise("open")
    return found.groupBy("history_id", state.alias("state")).agg(F.count("*").alias("pairs"))


def induced_edges(h: History) -> DataFrame:
    """What snapshot isolation asks to be without cycles: the known edges that are no anti-dependencies, and these followed by one."""
    known = checkpointed(known_edges(h).select("history_id", "src", "dst", "type"))
    d, a = known.filter("type <> 'RW'"), known.filter("type = 'RW'")
    return unite(d, compose(d, a))


def serial_form(h: History) -> tuple[DataFrame, DataFrame]:
    """A history that is serializable if and only if h is snapshot isolated: each transaction becomes a reading one (2 t) and a
    writing one (2 t + 1) after it, and two writers of a key get keys of their own that keep one's reading and writing together
    as seen by the other. Returns txns (history_id, session, so_pos, txn) and ops (history_id, txn, type, key, value)."""
    halves = F.explode(F.array(F.lit(0), F.lit(1))).alias("half")
    txns = h.txns.select("history_id", "session", "so_pos", "txn", halves).select("history_id", "session", (F.col("so_pos") * 2 + F.col("half")).alias("so_pos"), (F.col("txn") * 2 + F.col("half")).alias("txn"))
    own = h.writes().select("history_id", "txn", "key", "value", F.col("op_index").alias("written"))
    reads = h.reads().join(own, ["history_id", "txn", "key", "value"], "left").filter("written is null or written > op_index")
    reads = reads.select("history_id", (F.col("txn") * 2).alias("txn"), F.lit("r").alias("type"), "key", F.col("value").cast("string").alias("value"))
    writes = h.writes().select("history_id", (F.col("txn") * 2 + 1).alias("txn"), F.lit("w").alias("type"), "key", F.col("value").cast("string").alias("value"))
    w = h.writes().select("history_id", "key", "txn").distinct()
    pairs = w.withColumnRenamed("txn", "a").join(w.withColumnRenamed("txn", "b"), ["history_id", "key"]).filter("a <> b").select("history_id", "a", "b").distinct()
    mine, theirs = F.format_string("conflict:%d:%d", "a", "b"), F.format_string("conflict:%d:%d", "b", "a")
    op = lambda txn, kind, key, value: F.struct(txn.alias("txn"), F.lit(kind).alias("type"), key.alias("key"), F.lit(value).alias("value"))
    three = F.array(op(F.col("a") * 2, "w", mine, "1"), op(F.col("a") * 2 + 1, "r", mine, "1"), op(F.col("a") * 2 + 1, "w", theirs, "2"))
    extra = pairs.select("history_id", F.explode(three).alias("o")).select("history_id", "o.txn", "o.type", "o.key", "o.value")
    return txns, reads.unionByName(writes).unionByName(extra)


def unchanged(h: History) -> History:
    """The transform that changes nothing."""
    return h
