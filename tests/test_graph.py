"""Closures of histories against plain walks, and at sizes that pairs of paths would not fit."""

from __future__ import annotations

import random

import duckdb
import pytest

from histra import catalog
from histra.operators import graph


def reached(edges: set) -> set:
    found = set()
    for start in {a for a, _ in edges}:
        line = [start]
        while line:
            a = line.pop()
            for x, y in edges:
                if x == a and (start, y) not in found:
                    found.add((start, y))
                    line.append(y)
    return found


def test_closure_matches_walks(spark, monkeypatch):
    """Cycles, loops of one, repeated edges, places with large names; counted for few places at a time, too."""
    rng = random.Random(5)
    of = {h: {(rng.randint(-1, 9) * 10**15, rng.randint(-1, 9) * 10**15) for _ in range(rng.randint(1, 14))} for h in range(60)}
    rows = [(h, a, b) for h, edges in of.items() for a, b in [*edges, next(iter(edges))]]
    edges = spark.createDataFrame(rows, "history_id long, src long, dst long")
    expected = {h: reached(e) for h, e in of.items()}
    got = {h: set() for h in of}
    for r in graph.closure(edges).collect():
        got[r.history_id].add((r.src, r.dst))
    assert got == expected
    names = {h: sorted({x for e in edges for x in e}) for h, edges in of.items()}
    for h, e in of.items():
        nexts = [[names[h].index(b) for a, b in e if a == x] for x in names[h]]
        parts = graph._components(nexts)
        assert sum(r.bit_count() for lo in range(0, len(nexts), 3) for r in graph._reached(nexts, parts, lo, lo + 3)) == len(expected[h])
    assert {r.history_id: r.pairs for r in graph.closure_sizes(edges).collect()} == {h: len(e) for h, e in expected.items()}


def test_long_chains_are_counted(spark):
    """20,000 transactions in a row have 199,990,000 pairs, which a table of paths would hold one by one."""
    edges = spark.range(19_999).selectExpr("0L AS history_id", "id AS src", "id + 1 AS dst")
    assert [tuple(r) for r in graph.closure_sizes(edges).collect()] == [(0, 199_990_000)]


@pytest.mark.parametrize("name", ["g9_derived_edges", "g15_reachability"])
def test_no_closure_is_stored(spark, tmp_path, monkeypatch, name):
    """Histories are worked on in their tasks, so nothing is written on the way; events without user, number or type as in the SQL."""

    def written(df):
        raise AssertionError("a table is written on the way")

    monkeypatch.setattr(graph, "checkpointed", written)
    odd = "CASE WHEN event_id % 37 = 5 THEN NULL ELSE event_id END AS event_id, CASE WHEN event_id % 11 = 3 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 41 = 1 THEN NULL ELSE event_type END AS event_type"
    duckdb.sql(f"COPY (SELECT * REPLACE ({odd}) FROM '/root/testdata/sf0.01/events.parquet' WHERE user_id < 30) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = catalog.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    expected = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert expected and sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, expected))
