"""The condition language over one small state, row by row: what the search of a single history asks again and again.

The same rules as the column form in condition_engine: no coercion, NULL equals NULL, remainders have the divisor's sign, and
an error anywhere makes the whole result invalid (None).
"""

from __future__ import annotations

import json
from collections import Counter

from .condition_language import Binary, Field, Literal, Query


class _Error(Exception):
    pass


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _kind(v) -> str:
    return "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "text" if isinstance(v, str) else "other"


def _field(path: tuple[str, ...], row: dict, first: str):
    names = list(path)
    alias = names.pop(0) if names[0] in row else first
    key, value = row[alias]
    if names == ["canonical_key"]:
        return key
    if names in (["k"], ["key"]):
        return key.split(":", 1)[1] if ":" in key else key
    if names and names[0] == "value":
        names = names[1:]
    for name in names:
        if not isinstance(value, dict) or name not in value:
            raise _Error(".".join(path))
        value = value[name]
    return value


def value_of(tree, row: dict, first: str):
    if isinstance(tree, Literal):
        return tree.value
    if isinstance(tree, Field):
        return _field(tree.path, row, first)
    a = value_of(tree.left, row, first)
    if tree.op == "AND":
        if not isinstance(a, bool):
            raise _Error("AND")
        b = value_of(tree.right, row, first) if a else False
        if not isinstance(b, bool):
            raise _Error("AND")
        return b
    b = value_of(tree.right, row, first)
    kinds = _kind(a), _kind(b)
    if tree.op in ("=", "<>"):
        same = kinds[0] == kinds[1] and canonical(a) == canonical(b)
        return same if tree.op == "=" else not same
    if tree.op == "%":
        if kinds != ("int", "int") or b == 0:
            raise _Error("%")
        return a % b
    if kinds[0] != kinds[1] or kinds[0] not in ("int", "text", "bool"):
        raise _Error(tree.op)
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[tree.op]


def relation_of(key: str) -> str:
    return key.split(":", 1)[0] if ":" in key else "kv"


def evaluate(query: Query, state: dict[str, object]) -> tuple[Counter, dict[str, object]] | None:
    """(multiset of output objects as JSON, versions that they come from); None if an error makes the result invalid."""
    of: dict[str, list] = {}
    for key, value in sorted(state.items()):
        of.setdefault(relation_of(key), []).append((key, value))

    def kept(rows: list[dict], trees) -> list[dict]:
        for tree in trees:
            after = []
            for row in rows:
                truth = value_of(tree, row, query.alias)
                if not isinstance(truth, bool):
                    raise _Error("no boolean")
                if truth:
                    after.append(row)
            rows = after
        return rows

    try:
        rows = [{query.alias: r} for r in of.get(query.relation, [])]
        for join in query.joins:
            rows = kept([{**row, join.alias: r} for row in rows for r in of.get(join.relation, [])], join.on)
        rows = kept(rows, query.where)
        out, seen, lineage = Counter(), set(), {}
        for row in rows:
            text = canonical({name: value_of(tree, row, query.alias) for name, tree in query.columns})
            if not (query.distinct and text in seen):
                out[text] += 1
            seen.add(text)
            lineage.update(row.values())
    except _Error:
        return None
    return out, lineage


def conjuncts(tree) -> list:
    return conjuncts(tree.left) + conjuncts(tree.right) if isinstance(tree, Binary) and tree.op == "AND" else [tree]
