"""Verdicts for many histories at once: one history is one group, decided in one task."""

from __future__ import annotations

import json
from collections import Counter
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histra.functions import condition_rows
from histra.functions.condition_language import parse_query
from histra.functions.isolation import REJECT, Verdict, conflict_core, decide, pruned
from histra.sources import histories

from .history import History, all_rows

SCHEMA = "history_id long, level string, verdict string, reason string, witness string, nodes long"


def _plain(rows: pd.DataFrame) -> tuple[list, list, list, dict, dict]:
    """The history of a group, as isolation takes it."""
    of = {k: [tuple(None if pd.isna(x) else x for x in r) for r in g[["a", "b", "c", "d", "key"]].itertuples(index=False)] for k, g in rows.groupby("kind")}
    as_int = lambda *xs: tuple(int(x) for x in xs)
    txns = [as_int(a, b, c) for a, b, c, _, _ in of.get("t", [])]
    ops = [(int(a), int(b), k, key, int(c)) for k in "rw" for a, b, c, _, key in of.get(k, [])]
    preds = [(int(a), int(b), lambda v, m=int(c), r=int(d): v % m == r) for a, b, c, d, _ in of.get("p", [])]
    inputs: dict = {}
    for a, b, c, _, key in of.get("i", []):
        inputs.setdefault(as_int(a, b), {})[key] = int(c)
    initial = {key: int(a) for a, _, _, _, key in of.get("0", [])}
    return txns, ops, preds, inputs, initial


def _decide(level: str, budget: int | None):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v = decide(*_plain(rows), level, budget)
        witness = json.dumps([list(e) for e in v.cycle])
        return pd.DataFrame([[rows["history_id"].iloc[0], level, v.verdict, v.reason, witness, v.nodes]], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def verdicts(h: History, level: str = "SER", budget: int | None = None) -> DataFrame:
    """history_id, level, verdict, reason, witness (JSON list of labelled edges), nodes (search nodes)."""
    return all_rows(h).groupBy("history_id").applyInPandas(_decide(level, budget), SCHEMA)


def conflict_cores(h: History, budget: int = 200) -> DataFrame:
    """history_id, txn: for each rejected history, transactions that are enough for the rejection; none of them can be left out
    alone."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        core = conflict_core(*_plain(rows), budget=budget)
        return pd.DataFrame({"history_id": [rows["history_id"].iloc[0]] * len(core), "txn": core}).astype("int64")

    return all_rows(h).groupBy("history_id").applyInPandas(run, "history_id long, txn long")


def pruning(h: History) -> DataFrame:
    """history_id, pairs (of writers of a common key), known (ordered by sessions and reads), decided (after propagation)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        from histra.functions.isolation import Inconsistent, _Cycle

        try:
            found = pruned(*_plain(rows))
        except (Inconsistent, _Cycle):
            found = (-1, -1, -1)
        return pd.DataFrame([[rows["history_id"].iloc[0], *found]], columns=["history_id", "pairs", "known", "decided"]).astype("int64")

    return all_rows(h).groupBy("history_id").applyInPandas(run, "history_id long, pairs long, known long, decided long")


RECORDED = "case string, level string, verdict string, reason string, witness string, nodes long"


def _decide_recorded(level: str, budget: int | None, extended: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        of = {k: list(g[["a", "b", "c", "key", "text"]].itertuples(index=False, name=None)) for k, g in rows.groupby("kind")}
        same = lambda text: condition_rows.canonical(json.loads(text))
        number = lambda x: int(x)
        txns = [(number(a), number(b), number(c)) for a, b, c, _, _ in of.get("t", [])]
        ops = [(number(a), number(b), kind, key, same(text)) for kind in "rw" for a, b, _, key, text in of.get(kind, [])]
        inputs, values = {}, {}
        for a, b, _, key, text in of.get("i", []):
            inputs.setdefault((number(a), number(b)), {})[key] = same(text)
        for a, b, _, _, text in of.get("v", []):
            values.setdefault((number(a), number(b)), Counter())[same(text)] += 1
        initial = {key: same(text) for _, _, _, key, text in of.get("0", [])}
        queries, tests, broken = [], [], ""

        @cache
        def asked(text: str):
            """The query, and whether a version alone bears on its result: the same for all reads that ask it."""
            query = parse_query(json.loads(text), extended)

            @cache
            def bears(key: str, value: str) -> bool:
                alone = condition_rows.evaluate(query, {key: json.loads(value)})
                return alone is None or bool(alone[0])

            return query, bears

        for a, b, _, _, text in of.get("q", []):
            at, (query, bears) = (number(a), number(b)), asked(text)
            want = values.get(at, Counter()), inputs.get(at, {})
            if not query.joins and not query.distinct:
                # Each version bears on the result by itself: its inputs give the values, and no other version gives any.
                own = condition_rows.evaluate(query, {k: json.loads(v) for k, v in want[1].items()})
                if own is None or own[0] != want[0] or set(own[1]) != set(want[1]):
                    broken = "a condition read's values are not those of its inputs"
                tests.append((*at, bears))
                continue

            def matches(state: dict, query=query, want=want) -> bool:
                got = condition_rows.evaluate(query, {k: json.loads(v) for k, v in state.items()})
                return got is not None and got[0] == want[0] and {k: condition_rows.canonical(v) for k, v in got[1].items()} == want[1]

            queries.append((*at, lambda key, scope=query.relations(): condition_rows.relation_of(key) in scope, matches))
        v = Verdict(REJECT, broken) if broken else decide(txns, ops, [], inputs, initial, level, budget, queries, tests)
        witness = json.dumps([list(e) for e in v.cycle])
        return pd.DataFrame([[rows["case"].iloc[0], level, v.verdict, v.reason, witness, v.nodes]], columns=[c.split()[0] for c in RECORDED.split(", ")])

    return run


def recorded_verdicts(lines: DataFrame, initial: DataFrame, level: str = "SER", budget: int | None = None, extended: bool = False) -> DataFrame:
    """Verdicts on recorded histories, whatever queries their condition reads ask: lines as read_transactions gives them, initial
    as read_initial does. One case is one group. extended: the comparators >=, <= and <> are read, too."""
    none = lambda t: F.lit(None).cast(t)
    shape = lambda df, kind, a, b, c, key, text: df.select("case", F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"), key.alias("key"), text.alias("text"))
    col, long, string = F.col, none("long"), none("string")
    ops = histories.operations(lines)
    rows = shape(histories.transactions(lines), "t", col("txn"), col("session"), col("so_pos"), string, string)
    for part in (
        shape(ops.filter("type = 'r'"), "r", col("txn"), col("op_index"), long, col("key"), col("value")),
        shape(ops.filter("type = 'w'"), "w", col("txn"), col("op_index"), long, col("key"), col("value")),
        shape(ops.filter("type = 'pr'"), "q", col("txn"), col("op_index"), long, string, col("query")),
        shape(histories.predicate_inputs(lines), "i", col("txn"), col("op_index"), long, col("key"), col("value")),
        shape(histories.predicate_values(lines), "v", col("txn"), col("op_index"), long, string, col("value")),
        shape(initial, "0", long, long, long, col("key"), col("value")),
    ):
        rows = rows.unionByName(part)
    return rows.groupBy("case").applyInPandas(_decide_recorded(level, budget, extended), RECORDED)


def recorded_lines(h: History) -> tuple[DataFrame, DataFrame]:
    """A history as lines and initial state of recorded cases, one for each history_id (its number as text): the columns of
    read_transactions (ops as JSON text, `text`) and of read_initial."""
    case = F.col("history_id").cast("string")
    points = h.ops.select("history_id", "txn", "op_index", F.to_json(F.struct("type", "key", "value")).alias("op"))
    found = h.pred_inputs.groupBy("history_id", "txn", "op_index").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("inputs"))
    asked = h.pred_reads.join(found, ["history_id", "txn", "op_index"], "left").withColumn("inputs", F.coalesce("inputs", F.array().cast("array<struct<key: string, value: bigint>>")))
    where = F.concat(F.lit("value % "), F.col("modulus").cast("string"), F.lit(" = "), F.col("residue").cast("string"))
    query = F.struct(F.struct(F.lit("kv").alias("relation")).alias("from"), F.array(where).alias("where"), F.struct(F.array(F.lit("canonical_key AS key"), F.lit("value")).alias("columns")).alias("select"))
    op = F.struct(F.lit("pr").alias("type"), query.alias("query"), F.struct(F.col("inputs").alias("values"), F.col("inputs").alias("inputs")).alias("result"))
    reads = asked.select("history_id", "txn", "op_index", F.to_json(op).alias("op"))
    listed = points.unionByName(reads).groupBy("history_id", "txn").agg(F.array_sort(F.collect_list(F.struct("op_index", "op"))).alias("ops"))
    text = F.concat(F.lit("["), F.array_join(F.transform("ops", lambda o: o["op"]), ","), F.lit("]"))
    txns = h.txns.join(listed, ["history_id", "txn"]).select(case.alias("case"), F.struct("session", "so_pos").alias("line_no"), "session", F.col("so_pos").alias("session_seq"), "txn", "status", text.alias("text"))
    initial = h.initial.select(case.alias("case"), "key", F.col("value").cast("string").alias("value"), F.lit(False).alias("absent"))
    return txns, initial


def parsed(lines: DataFrame) -> DataFrame:
    """Lines whose ops are JSON text, with the ops parsed."""
    return lines.withColumn("ops", F.from_json("text", f"array<{histories.OP_SCHEMA}>", {"mode": "FAILFAST"})).drop("text")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("level", "verdict").agg(F.count("*").alias("histories"))


def witness_edges(found: DataFrame) -> DataFrame:
    """One row for each edge of each witness."""
    steps = F.from_json("witness", "array<array<string>>")
    edges = found.select("history_id", "level", F.posexplode(steps).alias("step", "e"))
    return edges.select("history_id", "level", "step", F.col("e")[0].cast("long").alias("src"), F.col("e")[1].cast("long").alias("dst"), F.col("e")[2].alias("type"), F.col("e")[3].alias("key"))


def dot(found: DataFrame) -> DataFrame:
    """A digraph text for each rejected history."""
    lines = witness_edges(found).select("history_id", "level", F.format_string('  "%d" -> "%d" [label="%s %s"];', "src", "dst", "type", F.coalesce("key", F.lit(""))).alias("line"), "step")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("history_id", "level").agg(F.concat(F.lit("digraph conflict {\n"), body, F.lit("\n}")).alias("dot"))
