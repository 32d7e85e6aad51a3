"""Predicate queries over row versions, as DataFrames with lineage.

A state is a table (key, value) of row versions, and may have more columns that number the snapshots, given as `by`; value is
JSON text and the relation is the key's part before the first ":" ("kv" without one). A query gives one row for each result:
its output object as canonical JSON, and the versions that it comes from. An error (a field that is missing, a comparison of
unlike kinds, a remainder by zero, a condition that is no boolean) makes the whole result of its snapshot invalid; these
snapshots are returned apart.

Every expression is a tagged value: its kind and a column for each kind. There is no coercion; NULL equals NULL. Conditions of a
join that concern one side only, as far as they come first, filter that side before the join; an equality between the two sides
that follows them is planned as an equi-join on the tagged values, so Catalyst can hash or sort; the rest is a filter over the
joined rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .condition_language import Binary, Field, Literal, Query, fields_of



def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


@dataclass(frozen=True)
class Tagged:
    """kind: int, text, bool, null, other (objects, arrays, fractions; canonical JSON in text) or error."""

    kind: Column
    number: Column
    text: Column
    truth: Column

    def canonical(self) -> Column:
        return F.concat_ws(":", self.kind, self.number.cast("string"), self.text, self.truth.cast("string"))

    def json(self) -> Column:
        quoted = F.to_json(F.array(self.text))
        return (
            F.when(self.kind == "int", self.number.cast("string"))
            .when(self.kind == "text", F.substr(quoted, F.lit(2), F.length(quoted) - 2))
            .when(self.kind == "bool", self.truth.cast("string"))
            .when(self.kind == "null", "null")
            .otherwise(self.text)
        )


def _of_variant(v: Column) -> Tagged:
    schema = F.schema_of_variant(v)
    kind = (
        F.when(v.isNull(), "error").when(schema == "BIGINT", "int").when(schema == "STRING", "text").when(schema == "BOOLEAN", "bool").when(schema == "VOID", "null").otherwise("other")
    )
    return Tagged(
        kind,
        F.when(kind == "int", F.try_variant_get(v, "$", "bigint")),
        F.when(kind == "text", F.try_variant_get(v, "$", "string")).when(kind == "other", F.to_json(v)),
        F.when(kind == "bool", F.try_variant_get(v, "$", "boolean")),
    )


def _bool(error: Column, truth: Column) -> Tagged:
    return Tagged(F.when(error, "error").otherwise("bool"), _none("long"), _none("string"), F.when(~error, truth))


def _is_error(*xs: Tagged) -> Column:
    return reduce(lambda a, b: a | b, [x.kind == "error" for x in xs])


def compile_expression(tree, aliases: list[str]) -> Tagged:
    if isinstance(tree, Literal):
        v = tree.value
        kind = "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "text"
        return Tagged(F.lit(kind), F.lit(v if kind == "int" else None).cast("long"), F.lit(v if kind == "text" else None).cast("string"), F.lit(v if kind == "bool" else None).cast("boolean"))
    if isinstance(tree, Field):
        path = list(tree.path)
        alias = path.pop(0) if path[0] in aliases else aliases[0]
        row = F.col(f"`{alias}`")
        if path == ["canonical_key"]:
            return Tagged(F.lit("text"), _none("long"), row["key"], _none("boolean"))
        if path in (["k"], ["key"]):
            local = F.when(F.instr(row["key"], ":") > 0, F.expr(f"substring(`{alias}`.key, instr(`{alias}`.key, ':') + 1)")).otherwise(row["key"])
            return Tagged(F.lit("text"), _none("long"), local, _none("boolean"))
        if not path or path == ["value"]:
            return _of_variant(row["value"])
        if path[0] == "value":
            path = path[1:]
        return _of_variant(F.try_variant_get(row["value"], "$" + "".join(f".{p}" for p in path), "variant"))
    a, b = compile_expression(tree.left, aliases), compile_expression(tree.right, aliases)
    error = _is_error(a, b)
    if tree.op == "AND":
        # Left to right: the right side counts only where the left is true.
        left_bad, right_bad = a.kind != "bool", b.kind != "bool"
        return _bool(left_bad | (a.truth & right_bad), a.truth & F.coalesce(b.truth, F.lit(False)))
    if tree.op in ("=", "<>"):
        same = (a.kind == b.kind) & a.number.eqNullSafe(b.number) & a.text.eqNullSafe(b.text) & a.truth.eqNullSafe(b.truth)
        return _bool(error, same if tree.op == "=" else ~same)
    if tree.op == "%":
        bad = error | (a.kind != "int") | (b.kind != "int") | F.coalesce(b.number == 0, F.lit(False))
        n = F.when(b.number != 0, b.number)
        return Tagged(F.when(bad, "error").otherwise("int"), F.when(~bad, ((a.number % n) + n) % n), _none("string"), _none("boolean"))
    bad = error | (a.kind != b.kind) | ~a.kind.isin("int", "text", "bool")
    sign = F.when(a.kind == "int", F.signum((a.number > b.number).cast("int") - (a.number < b.number).cast("int")))
    sign = sign.when(a.kind == "text", (a.text > b.text).cast("int") - (a.text < b.text).cast("int")).when(a.kind == "bool", a.truth.cast("int") - b.truth.cast("int"))
    test = {">": sign > 0, "<": sign < 0, ">=": sign >= 0, "<=": sign <= 0}[tree.op]
    return _bool(bad, test)


def relation_of(key: Column) -> Column:
    return F.when(F.instr(key, ":") > 0, F.substring_index(key, ":", 1)).otherwise("kv")


@dataclass(frozen=True)
class Evaluation:
    rows: DataFrame  # by..., out, lineage array<struct<key, value>>
    errors: DataFrame  # by... (distinct); without by, one row if the evaluation failed


def _conjuncts(trees) -> list:
    out = []
    for t in trees:
        out += _conjuncts([t.left, t.right]) if isinstance(t, Binary) and t.op == "AND" else [t]
    return out


def evaluate(query: Query, state: DataFrame, by: list[str] | None = None) -> Evaluation:
    by = by or []
    known = state.select(*by, "key", F.parse_json("value").alias("value"), relation_of(F.col("key")).alias("relation"))

    def scan(relation: str, alias: str) -> DataFrame:
        return known.filter(F.col("relation") == relation).select(*by, F.struct("key", "value").alias(alias))

    errors: list[DataFrame] = []

    def keep(rows: DataFrame, trees, aliases: list[str]) -> DataFrame:
        for tree in _conjuncts(trees):
            x = compile_expression(tree, aliases)
            errors.append(rows.filter(x.kind != "bool").select(*by))
            rows = rows.filter((x.kind == "bool") & x.truth)
        return rows

    rows, aliases = scan(query.relation, query.alias), [query.alias]
    for join in query.joins:
        other, parts = scan(join.relation, join.alias), _conjuncts(join.on)

        def meets(bad: DataFrame, some: DataFrame) -> DataFrame:
            """Errors of one side's rows, which count if the other side has a row at all."""
            if by:
                return bad.select(*by).join(some.select(*by).distinct(), by, "left_semi")
            return bad.select(F.lit(1).alias("_e")).limit(1).join(some.select(F.lit(1).alias("_e")).limit(1), "_e", "left_semi").select()

        names = lambda t, aliases=aliases: {f.path[0] if f.path[0] in [*aliases, join.alias] else aliases[0] for f in fields_of(t)}  # noqa: E731, B023
        while parts and names(parts[0]) and (names(parts[0]) <= set(aliases) or names(parts[0]) == {join.alias}):
            mine = names(parts[0]) <= set(aliases)
            x = compile_expression(parts[0], aliases if mine else [join.alias])
            side, facing = (rows, other) if mine else (other, rows)
            errors.append(meets(side.filter(x.kind != "bool"), facing))
            side = side.filter((x.kind == "bool") & x.truth)
            rows, other = (side, other) if mine else (rows, side)
            parts = parts[1:]
        first = parts[0] if parts else None
        sides = [names(t) for t in (first.left, first.right)] if isinstance(first, Binary) and first.op == "=" else []
        hashable = len(sides) == 2 and {join.alias} in sides and all(sides) and any(s <= set(aliases) for s in sides)
        if hashable:
            mine, theirs = (first.left, first.right) if sides[1] == {join.alias} else (first.right, first.left)
            a, b = compile_expression(mine, aliases), compile_expression(theirs, [join.alias])
            for bad, some in ((rows.filter(a.kind == "error"), other), (other.filter(b.kind == "error"), rows)):
                errors.append(meets(bad, some))
            rows = rows.withColumn("_j", a.canonical()).join(other.withColumn("_j", b.canonical()), [*by, "_j"]).drop("_j")
            parts = parts[1:]
        else:
            rows = rows.join(other, by) if by else rows.crossJoin(other)
        aliases.append(join.alias)
        rows = keep(rows, parts, aliases)
    rows = keep(rows, query.where, aliases)
    columns = [(name, compile_expression(tree, aliases)) for name, tree in query.columns]
    for _, x in columns:
        errors.append(rows.filter(x.kind == "error").select(*by))
    parts = [F.concat(F.lit(f'"{name}":'), x.json()) for name, x in sorted(columns, key=lambda c: c[0])]
    out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    lineage = F.array(*[F.struct(F.col(f"`{a}`.key").alias("key"), F.to_json(F.col(f"`{a}`.value")).alias("value")) for a in aliases])
    result = rows.select(*by, out.alias("out"), lineage.alias("lineage"))
    if query.distinct:
        result = result.groupBy(*by, "out").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lineage")))).alias("lineage"))
    failed = reduce(DataFrame.union, [e.select(*(by or [F.lit(1).alias("failed")])) for e in errors]) if errors else state.limit(0).select(*(by or [F.lit(1).alias("failed")]))
    return Evaluation(result, failed.distinct())


def bag(evaluation: Evaluation, by: list[str] | None = None) -> DataFrame:
    """The result as a multiset: out and n."""
    return evaluation.rows.groupBy(*(by or []), "out").agg(F.count("*").alias("n"))


def inputs(evaluation: Evaluation, by: list[str] | None = None) -> DataFrame:
    """The versions that contribute to any row: key, value."""
    return evaluation.rows.select(*(by or []), F.explode("lineage").alias("v")).select(*(by or []), "v.key", "v.value").distinct()


def difference(a: Evaluation, b: Evaluation, by: list[str] | None = None) -> DataFrame:
    """Output rows with different counts in two results: out, n_a, n_b. Empty if they match as multisets."""
    key = [*(by or []), "out"]
    left, right = bag(a, by).withColumnRenamed("n", "n_a"), bag(b, by).withColumnRenamed("n", "n_b")
    both = left.join(right, key, "full").select(*key, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return both.filter("n_a <> n_b")


def lineage_difference(a: Evaluation, b: Evaluation, by: list[str] | None = None) -> DataFrame:
    """Versions (key, value) that one of two results comes from and the other does not, with that side: a or b."""
    left, right = inputs(a, by), inputs(b, by)
    return left.exceptAll(right).withColumn("side", F.lit("a")).unionByName(right.exceptAll(left).withColumn("side", F.lit("b")))


def mismatches(query: Query, state: DataFrame, values: DataFrame, read: DataFrame) -> DataFrame:
    """What keeps a recorded result (values: out; read: key, value) from being that of the query over the state: what (value, input
    or error), item, and on which side it stands alone. Empty if they match."""
    now = evaluate(query, state)
    out, mine = now.rows.select("out"), inputs(now)
    item = lambda df, what, side: df.select(F.lit(what).alias("what"), (F.col("out") if what == "value" else F.concat_ws("=", "key", "value")).alias("item"), F.lit(side).alias("side"))
    rows = item(out.exceptAll(values.select("out")), "value", "evaluated").unionByName(item(values.select("out").exceptAll(out), "value", "recorded"))
    rows = rows.unionByName(item(mine.exceptAll(read.select("key", "value")), "input", "evaluated")).unionByName(item(read.select("key", "value").exceptAll(mine), "input", "recorded"))
    return rows.unionByName(now.errors.select(F.lit("error").alias("what"), F.lit(None).cast("string").alias("item"), F.lit("evaluated").alias("side")))


def rows_in_result(query: Query, versions: DataFrame, by: list[str]) -> DataFrame:
    """versions: by..., key, value, each a state of its own. Whether the query's result over that one row comes from it: by...,
    in_result. Errors give false, joins of different relations too; a self-join may find the row twice."""
    found = evaluate(query, versions.select(*by, "key", "value"), by)
    hit = found.rows.filter(F.size("lineage") > 0).select(*by).distinct().join(found.errors, by, "left_anti").withColumn("in_result", F.lit(True))
    return versions.select(*by).distinct().join(hit, by, "left").withColumn("in_result", F.coalesce("in_result", F.lit(False)))


def transition_delta(query: Query, before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after: key, value, one version of each key. Keys whose change can change the result: the row comes in or goes out,
    or is in both times with another value."""
    in_before = rows_in_result(query, before, ["key"]).withColumnRenamed("in_result", "was_in")
    in_after = rows_in_result(query, after, ["key"]).withColumnRenamed("in_result", "is_in")
    rows = before.select("key", F.col("value").alias("old")).join(after.select("key", F.col("value").alias("new")), "key").join(in_before, "key").join(in_after, "key")
    same = F.to_json(F.parse_json("old")) == F.to_json(F.parse_json("new"))
    return rows.filter((F.col("was_in") != F.col("is_in")) | (F.col("was_in") & ~same)).select("key", "was_in", "is_in")


def uncovered(query: Query, state: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys (column key) that the query can't read: their relation is not among its own."""
    return keys.filter(~relation_of(F.col("key")).isin(*sorted(query.relations()))).select("key")
