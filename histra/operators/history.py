"""Recorded transaction histories as DataFrames, and histories derived from an event table.

A history is five tables, each with a history_id, so that many histories are worked on at once and history_id is the unit of
distribution:

* txns(history_id, session, so_pos, txn, status)
* ops(history_id, txn, op_index, type, key, value)          type: r or w
* pred_reads(history_id, txn, op_index, modulus, residue)    the predicate value % modulus = residue, over all keys
* pred_inputs(history_id, txn, op_index, key, value)         the row versions a predicate read returned
* initial(history_id, key, value)                            written by the bottom transaction, -1
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BOTTOM = -1
#: Users of a history, so that histories grow in number with the table and not in size.
N_USERS, N_KEYS, MODULUS = 5, 20, 4


@dataclass(frozen=True)
class History:
    txns: DataFrame
    ops: DataFrame
    pred_reads: DataFrame
    pred_inputs: DataFrame
    initial: DataFrame

    def writes(self) -> DataFrame:
        return self.ops.filter("type = 'w'").drop("type")

    def reads(self) -> DataFrame:
        return self.ops.filter("type = 'r'").drop("type")

    def versions(self) -> DataFrame:
        """All row versions, those of the bottom transaction included."""
        bottom = self.initial.select("history_id", F.lit(BOTTOM).cast("long").alias("txn"), F.lit(0).cast("long").alias("op_index"), "key", "value")
        return self.writes().unionByName(bottom)


def floor_mod(a: Column, n: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return ((a % n) + n) % n


def all_rows(h: History) -> DataFrame:
    """All rows of a history in one table: kind, four longs and two texts."""
    none = lambda t: F.lit(None).cast(t)
    shape = lambda df, kind, a, b, c, d, key: df.select(F.col("history_id").cast("long").alias("history_id"), F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"), d.cast("long").alias("d"), key.alias("key"))
    col = F.col
    parts = [
        shape(h.txns, "t", col("txn"), col("session"), col("so_pos"), none("long"), none("string")),
        shape(h.reads(), "r", col("txn"), col("op_index"), col("value"), none("long"), col("key")),
        shape(h.writes(), "w", col("txn"), col("op_index"), col("value"), none("long"), col("key")),
        shape(h.pred_reads, "p", col("txn"), col("op_index"), col("modulus"), col("residue"), none("string")),
        shape(h.pred_inputs, "i", col("txn"), col("op_index"), col("value"), none("long"), col("key")),
        shape(h.initial, "0", col("value"), none("long"), none("long"), none("long"), col("key")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def from_events(events: DataFrame, users: int = N_USERS, keys: int = N_KEYS, modulus: int = MODULUS) -> History:
    """One session for each user, one operation for each event: purchase and signup write, view and click read the version that
    was latest then, error reads all latest versions that satisfy a predicate. A transaction is an event, a day or an hour of a
    user, in turn by history: the first are serial by construction, the second mostly are not, the third may be either."""
    history, stamp = F.floor(F.col("user_id") / users), F.col("ts").cast("string")
    e = events.select(
        history.alias("history_id"),
        F.col("user_id").alias("session"),
        F.when(history % 3 == 0, stamp).when(history % 3 == 1, F.substring(stamp, 1, 10)).otherwise(F.substring(stamp, 1, 13)).alias("slot"),
        "ts",
        "event_id",
        F.concat(F.lit("kv:"), (F.col("event_id") % keys).cast("string")).alias("key"),
        F.when(F.col("event_type").isin("purchase", "signup"), "w").when(F.col("event_type").isin("view", "click"), "r").otherwise("pr").alias("type"),
    )
    by_txn = Window.partitionBy("history_id").orderBy("session", "slot")
    inside = Window.partitionBy("history_id", "session", "slot").orderBy("ts", "event_id")
    e = e.withColumn("txn", F.dense_rank().over(by_txn).cast("long")).withColumn("op_index", (F.row_number().over(inside) - 1).cast("long"))
    session = Window.partitionBy("history_id", "session").orderBy("txn")
    txns = e.select("history_id", "session", "txn").distinct()
    txns = txns.select("history_id", "session", (F.row_number().over(session) - 1).cast("long").alias("so_pos"), "txn", F.lit("commit").alias("status"))

    first = lambda key: -(1 + F.substring_index(key, ":", -1).cast("long"))
    point = e.filter("type <> 'pr'")
    before = Window.partitionBy("history_id", "key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(F.when(F.col("type") == "w", F.col("event_id")), ignorenulls=True).over(before)
    ops = point.withColumn("latest", latest).select(
        "history_id", "txn", "op_index", "type", "key", F.when(F.col("type") == "w", F.col("event_id")).otherwise(F.coalesce("latest", first("key"))).alias("value")
    )
    asked = e.filter("type = 'pr'")
    pred_reads = asked.select("history_id", "txn", "op_index", F.lit(modulus).cast("long").alias("modulus"), (F.col("event_id") % modulus).alias("residue"))
    every = F.explode(F.array(*[F.lit(f"kv:{k}") for k in range(keys)]))
    points = asked.select("history_id", "ts", "event_id", "txn", "op_index", F.lit("pr").alias("type"), every.alias("key"))
    lines = points.unionByName(e.filter("type = 'w'").select("history_id", "ts", "event_id", "txn", "op_index", "type", "key"))
    seen = lines.withColumn("value", F.coalesce(latest, first("key"))).filter("type = 'pr'")
    pred_inputs = seen.filter(floor_mod(F.col("value"), F.lit(modulus)) == F.col("event_id") % modulus).select("history_id", "txn", "op_index", "key", "value")
    initial = e.select("history_id").distinct().select("history_id", every.alias("key")).withColumn("value", first("key"))
    return History(txns, ops, pred_reads, pred_inputs, initial)


#: The same derivation for an independent engine.
EVENTS_SQL = f"""
e AS (SELECT user_id // {N_USERS} AS history_id, user_id AS session, ts, event_id,
             CASE (user_id // {N_USERS}) % 3 WHEN 0 THEN ts::VARCHAR WHEN 1 THEN substr(ts::VARCHAR, 1, 10) ELSE substr(ts::VARCHAR, 1, 13) END AS slot, 'kv:' || (event_id % {N_KEYS}) AS key,
             CASE WHEN event_type IN ('purchase', 'signup') THEN 'w' WHEN event_type IN ('view', 'click') THEN 'r' ELSE 'pr' END AS type FROM events),
x AS (SELECT *, dense_rank() OVER (PARTITION BY history_id ORDER BY session, slot)::BIGINT AS txn,
             (row_number() OVER (PARTITION BY history_id, session, slot ORDER BY ts, event_id) - 1)::BIGINT AS op_index FROM e),
txns AS (SELECT history_id, session, (row_number() OVER (PARTITION BY history_id, session ORDER BY txn) - 1)::BIGINT AS so_pos, txn, 'commit' AS status
         FROM (SELECT DISTINCT history_id, session, txn FROM x)),
ops AS (SELECT history_id, txn, op_index, type, key,
               CASE WHEN type = 'w' THEN event_id ELSE coalesce(last_value(CASE WHEN type = 'w' THEN event_id END IGNORE NULLS)
                 OVER (PARTITION BY history_id, key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -(1 + split_part(key, ':', 2)::BIGINT)) END AS value
        FROM x WHERE type <> 'pr'),
pred_reads AS (SELECT history_id, txn, op_index, {MODULUS}::BIGINT AS modulus, event_id % {MODULUS} AS residue FROM x WHERE type = 'pr'),
lines AS (SELECT history_id, ts, event_id, txn, op_index, 'pr' AS type, 'kv:' || k AS key FROM x, range({N_KEYS}) t(k) WHERE type = 'pr'
          UNION ALL SELECT history_id, ts, event_id, txn, op_index, type, key FROM x WHERE type = 'w'),
seen AS (SELECT *, coalesce(last_value(CASE WHEN type = 'w' THEN event_id END IGNORE NULLS)
                 OVER (PARTITION BY history_id, key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -(1 + split_part(key, ':', 2)::BIGINT)) AS value FROM lines),
pred_inputs AS (SELECT history_id, txn, op_index, key, value FROM seen WHERE type = 'pr' AND ((value % {MODULUS}) + {MODULUS}) % {MODULUS} = event_id % {MODULUS}),
initial AS (SELECT history_id, 'kv:' || k AS key, (-(1 + k))::BIGINT AS value FROM (SELECT DISTINCT history_id FROM x), range({N_KEYS}) t(k)),
writes AS (SELECT history_id, txn, op_index, key, value FROM ops WHERE type = 'w'),
reads AS (SELECT history_id, txn, op_index, key, value FROM ops WHERE type = 'r'),
versions AS (SELECT * FROM writes UNION ALL SELECT history_id, -1, 0, key, value FROM initial)"""
