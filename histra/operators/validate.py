"""Checks of a history's internal consistency. Each returns the rows that break its rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .history import BOTTOM, History, floor_mod

OP = ["history_id", "txn", "op_index"]


def duplicate_versions(h: History) -> DataFrame:
    """(key, value) pairs written more than once: reads can't be told apart."""
    return h.versions().groupBy("history_id", "key", "value").agg(F.count("*").alias("writers")).filter("writers > 1")


def duplicate_transactions(h: History) -> DataFrame:
    return h.txns.groupBy("history_id", "txn").agg(F.count("*").alias("copies")).filter("copies > 1")


def with_source(h: History, reads: DataFrame) -> DataFrame:
    """reads and the write each comes from: src_txn, src_index, is_final (the writer's last write of the key), n_sources."""
    last = Window.partitionBy("history_id", "txn", "key")
    written = h.versions().withColumn("is_final", F.col("op_index") == F.max("op_index").over(last))
    source = written.groupBy("history_id", "key", "value").agg(
        F.min("txn").alias("src_txn"), F.min("op_index").alias("src_index"), F.bool_and("is_final").alias("is_final"), F.count("*").alias("n_sources")
    )
    return reads.join(source, ["history_id", "key", "value"], "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0).cast("long")))


def with_own_write(h: History, reads: DataFrame) -> DataFrame:
    """Adds own_index and own_value: the latest write of the key by the same transaction before the read (an as-of join by
    operation index, as a window over reads and writes together)."""
    kinds = reads.withColumn("_w", F.lit(False)).unionByName(h.writes().withColumn("_w", F.lit(True)), allowMissingColumns=True)
    before = Window.partitionBy("history_id", "txn", "key").orderBy("op_index").rowsBetween(Window.unboundedPreceding, -1)
    own = F.last(F.when(F.col("_w"), F.struct("op_index", "value")), ignorenulls=True).over(before)
    return kinds.withColumn("_own", own).filter("not _w").withColumn("own_index", F.col("_own.op_index")).withColumn("own_value", F.col("_own.value")).drop("_w", "_own")


def read_violations(h: History) -> DataFrame:
    """Point reads that break a rule, with the rule:

    unresolved: no write, or several, has this key and value; ignores_own_write: the transaction wrote the key before and reads
    another's version; intermediate: another's write that is not its last of the key; future_own: its own later write;
    stale_own: an own write that is not the latest before the read.
    """
    rows = with_own_write(h, with_source(h, h.reads()))
    own = F.col("src_txn") == F.col("txn")
    rule = (
        F.when(F.col("n_sources") != 1, "unresolved")
        .when(own & (F.col("src_index") > F.col("op_index")), "future_own")
        .when(own & (F.col("own_value") != F.col("value")), "stale_own")
        .when(~own & F.col("own_index").isNotNull(), "ignores_own_write")
        .when(~own & ~F.col("is_final"), "intermediate")
    )
    return rows.withColumn("rule", rule).filter("rule is not null").select(*OP, "key", "value", "rule")


def predicate_violations(h: History) -> DataFrame:
    """Inputs of predicate reads that break a rule: duplicate_input, unresolved, and the rules of point reads; unsatisfied: the
    version does not satisfy the predicate."""
    copies = Window.partitionBy(*OP, "key")
    rows = h.pred_inputs.withColumn("copies", F.count("*").over(copies))
    rows = with_own_write(h, with_source(h, rows)).join(h.pred_reads, OP)
    own = F.col("src_txn") == F.col("txn")
    rule = (
        F.when(F.col("copies") > 1, "duplicate_input")
        .when(F.col("n_sources") != 1, "unresolved")
        .when(floor_mod(F.col("value"), F.col("modulus")) != F.col("residue"), "unsatisfied")
        .when(own & (F.col("src_index") > F.col("op_index")), "future_own")
        .when(own & (F.col("own_value") != F.col("value")), "stale_own")
        .when(~own & F.col("own_index").isNotNull(), "ignores_own_write")
        .when(~own & ~F.col("is_final"), "intermediate")
    )
    return rows.withColumn("rule", rule).filter("rule is not null").select(*OP, "key", "value", "rule")


def predicate_reevaluation(h: History) -> DataFrame:
    """Predicate reads that miss an own write: keys whose latest own write before the read satisfies the predicate, but which
    are not among its inputs with that value."""
    asked = h.pred_reads.join(h.writes().select("history_id", "txn", F.col("op_index").alias("w"), "key", "value"), ["history_id", "txn"]).filter(F.col("w") < F.col("op_index"))
    latest = asked.groupBy(*OP, "modulus", "residue", "key").agg(F.max_by("value", "w").alias("value"))
    due = latest.filter(floor_mod(F.col("value"), F.col("modulus")) == F.col("residue"))
    return due.join(h.pred_inputs, [*OP, "key", "value"], "left_anti").select(*OP, "key", "value")


def verdicts_of_structure(h: History) -> DataFrame:
    """history_id and the number of broken rules by kind; zero everywhere means internally consistent."""
    parts = [
        h.txns.select("history_id").distinct().select("history_id", F.lit("none").alias("rule"), F.lit(0).alias("n")),
        duplicate_versions(h).select("history_id", F.lit("duplicate_version").alias("rule"), F.lit(1).alias("n")),
        duplicate_transactions(h).select("history_id", F.lit("duplicate_transaction").alias("rule"), F.lit(1).alias("n")),
        read_violations(h).select("history_id", "rule", F.lit(1).alias("n")),
        predicate_violations(h).select("history_id", "rule", F.lit(1).alias("n")),
        predicate_reevaluation(h).select("history_id", F.lit("missing_own_write").alias("rule"), F.lit(1).alias("n")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("history_id").agg(F.sum("n").alias("n_violations"), F.countDistinct(F.when(F.col("n") > 0, F.col("rule"))).alias("n_rules"))


def statistics(h: History) -> DataFrame:
    """Per history: sessions, transactions, read-only, write-only and mixed ones, operations, variables."""
    kinds = h.ops.select("history_id", "txn", "key", (F.col("type") == "w").alias("w"), F.lit(1).alias("o")).unionByName(
        h.pred_reads.select("history_id", "txn", F.lit(None).cast("string").alias("key"), F.lit(False).alias("w"), F.lit(1).alias("o"))
    )
    by_txn = kinds.groupBy("history_id", "txn").agg(F.bool_or("w").alias("writes"), F.bool_or(~F.col("w")).alias("reads"), F.sum("o").alias("events"))
    totals = by_txn.groupBy("history_id").agg(
        F.count("*").alias("txns"),
        F.count_if(~F.col("writes")).alias("read_only"),
        F.count_if(~F.col("reads")).alias("write_only"),
        F.count_if(F.col("reads") & F.col("writes")).alias("mixed"),
        F.sum("events").alias("events"),
    )
    sessions = h.txns.groupBy("history_id").agg(F.countDistinct("session").alias("sessions"))
    variables = h.ops.groupBy("history_id").agg(F.countDistinct("key").alias("variables"))
    return sessions.join(totals, "history_id").join(variables, "history_id", "left")


def writes_per_key(h: History, buckets: int = 8) -> DataFrame:
    """Histogram of the number of writes of a key: up to `buckets` buckets of equal width."""
    counts = h.writes().groupBy("history_id", "key").agg(F.count("*").alias("n"))
    span = Window.partitionBy("history_id")
    low, high = F.min("n").over(span), F.max("n").over(span)
    step = F.greatest(F.ceil((high - low + 1) / buckets), F.lit(1))
    return counts.withColumn("bucket", F.floor((F.col("n") - low) / step)).withColumn("from_writes", low + F.col("bucket") * step).groupBy("history_id", "bucket", "from_writes").agg(F.count("*").alias("keys"))


def replay(h: History) -> DataFrame:
    """Point reads that a serial replay in order of (session, position) answers otherwise: read value and replayed value."""
    order = h.txns.select("history_id", "txn", F.struct("session", "so_pos").alias("at"))
    bottom = h.initial.select("history_id", F.lit(None).cast("struct<session:bigint,so_pos:bigint>").alias("at"), F.lit(0).cast("long").alias("op_index"), F.lit("w").alias("type"), "key", "value", F.lit(BOTTOM).cast("long").alias("txn"))
    lines = h.ops.join(order, ["history_id", "txn"]).unionByName(bottom)
    before = Window.partitionBy("history_id", "key").orderBy(F.col("at").asc_nulls_first(), "op_index").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col("type") == "w", F.col("value")), ignorenulls=True).over(before)
    return lines.withColumn("replayed", state).filter("type = 'r' and replayed <> value").select("history_id", "txn", "op_index", "key", "value", "replayed")


def input_mismatches(h: History) -> DataFrame:
    """Recorded inputs of condition reads that are not what their sources wrote, as multisets: key, value, copies too many."""
    resolved = with_source(h, h.pred_inputs.distinct()).filter("n_sources = 1").select(*OP, "key", "value")
    return h.pred_inputs.select(*OP, "key", "value").exceptAll(resolved).groupBy(*OP, "key", "value").agg(F.count("*").alias("surplus"))


def _known_versions(h: History) -> DataFrame:
    """For each condition read and key that its transaction knows of by then: mine (own latest write and its index), current and
    previous (inputs of this read, and of the one before with the same condition), previous_index."""
    again = Window.partitionBy("history_id", "txn", "modulus", "residue").orderBy("op_index")
    reads = h.pred_reads.withColumn("previous_index", F.lag("op_index").over(again))
    current = h.pred_inputs.select(*OP, "key", F.col("value").alias("current"))
    previous = h.pred_inputs.select("history_id", "txn", F.col("op_index").alias("previous_index"), "key", F.col("value").alias("previous"))
    writes = h.writes().select("history_id", "txn", "key", F.col("op_index").alias("w"), F.col("value").alias("v"))
    mine = reads.join(writes, ["history_id", "txn"]).filter(F.col("w") < F.col("op_index")).groupBy(*OP, "key").agg(F.max_by("v", "w").alias("mine"), F.max("w").alias("mine_index"))
    before = reads.select(*OP, "previous_index").join(previous, ["history_id", "txn", "previous_index"]).drop("previous_index")
    keys = current.select(*OP, "key").unionByName(before.select(*OP, "key")).unionByName(mine.select(*OP, "key")).distinct()
    rows = keys.join(reads, OP)
    for side in (current, before, mine):
        rows = rows.join(side, [*OP, "key"], "left")
    return rows


def local_reevaluation(h: History) -> DataFrame:
    """Condition reads whose result differs from what the transaction itself knows: the inputs of its previous read with the same
    condition, this read's inputs, and its own writes since then, evaluated again. One row for each key that differs: expected
    and recorded value, null where the key is not in the result."""
    rows = _known_versions(h)
    since = F.col("mine_index") > F.coalesce("previous_index", F.lit(-1))
    known = F.when(since, F.col("mine")).otherwise(F.coalesce("current", "previous"))
    expected = F.when(floor_mod(known, F.col("modulus")) == F.col("residue"), known)
    return rows.withColumn("expected", expected).filter(~F.col("expected").eqNullSafe(F.col("current"))).select(*OP, "key", "expected", F.col("current").alias("recorded"))


def snapshot_reevaluation(h: History) -> DataFrame:
    """The same for one snapshot in a transaction, key by key, with the rule that is broken: unsatisfied, missing_own (an own write
    satisfies the condition and is not in the result), hidden_own (an own write stands before it and another version is in the
    result), not_repeated (without an own write, the previous read with the same condition saw otherwise)."""
    rows = _known_versions(h)
    satisfied = lambda c: floor_mod(F.col(c), F.col("modulus")) == F.col("residue")
    own = F.col("mine").isNotNull()
    rule = (
        F.when(F.col("current").isNotNull() & ~satisfied("current"), "unsatisfied")
        .when(own & satisfied("mine") & ~F.col("current").eqNullSafe(F.col("mine")), "missing_own")
        .when(own & ~satisfied("mine") & F.col("current").isNotNull(), "hidden_own")
        .when(~own & F.col("previous_index").isNotNull() & ~F.col("current").eqNullSafe(F.col("previous")), "not_repeated")
    )
    return rows.withColumn("rule", rule).filter("rule is not null").select(*OP, "key", "rule")


def session_sequence_violations(lines: DataFrame) -> DataFrame:
    """Transactions whose session_seq does not rise along their session's lines: case, session, txn."""
    order = Window.partitionBy("case", "session").orderBy("line_no")
    return lines.withColumn("last", F.lag("session_seq").over(order)).filter("session_seq <= last").select("case", "session", "txn")
