"""Clauses over boolean variables: the connectives, unit propagation with undo, and a complete search for small sets.

A literal is a variable's number (from 1) or its negative. This is what the order search asks for when choices are coupled by
conditions that are no edges.
"""

from __future__ import annotations

from collections.abc import Iterable


def at_least_one(*literals: int) -> list[tuple[int, ...]]:
    return [tuple(literals)]


def implies(a: int, b: int) -> list[tuple[int, ...]]:
    return [(-a, b)]


def exactly_one(a: int, b: int) -> list[tuple[int, ...]]:
    """Either, not both."""
    return [(a, b), (-a, -b)]


def equals_and(c: int, *literals: int) -> list[tuple[int, ...]]:
    return [(-c, x) for x in literals] + [(c, *[-x for x in literals])]


def equals_or(c: int, *literals: int) -> list[tuple[int, ...]]:
    return [(c, -x) for x in literals] + [(-c, *literals)]


class Clauses:
    def __init__(self, clauses: Iterable[tuple[int, ...]] = ()):
        self.clauses: list[tuple[int, ...]] = []
        self.where: dict[int, list[int]] = {}
        self.values: dict[int, bool] = {}
        self.trail: list[int] = []
        for c in clauses:
            self.add(c)

    def add(self, clause: tuple[int, ...]) -> None:
        for literal in set(clause):
            self.where.setdefault(-literal, []).append(len(self.clauses))
        self.clauses.append(tuple(clause))

    def truth(self, literal: int) -> bool | None:
        value = self.values.get(abs(literal))
        return None if value is None else value == (literal > 0)

    def assign(self, *literals: int) -> bool:
        """Sets literals and whatever follows; False on a conflict (undo the trail then)."""
        line = list(literals)
        while line:
            literal = line.pop()
            if self.truth(literal) is not None:
                if not self.truth(literal):
                    return False
                continue
            self.values[abs(literal)] = literal > 0
            self.trail.append(abs(literal))
            for at in self.where.get(literal, ()):
                open_, satisfied = [], False
                for x in self.clauses[at]:
                    known = self.truth(x)
                    satisfied = satisfied or known is True
                    if known is None:
                        open_.append(x)
                if satisfied:
                    continue
                if not open_:
                    return False
                if len(set(open_)) == 1:
                    line.append(open_[0])
        return True

    def undo(self, length: int) -> None:
        while len(self.trail) > length:
            del self.values[self.trail.pop()]

    def solve(self) -> dict[int, bool] | None:
        """An assignment of all variables, or None. Clauses added later are met by solving again from here."""
        if any(not c for c in self.clauses):
            return None
        if not self.assign(*[c[0] for c in self.clauses if len(set(c)) == 1]):
            return None
        variables = sorted({abs(x) for c in self.clauses for x in c})

        def search() -> bool:
            free = next((v for v in variables if v not in self.values), None)
            if free is None:
                return True
            length = len(self.trail)
            for literal in (free, -free):
                if self.assign(literal) and search():
                    return True
                self.undo(length)
            return False

        return dict(self.values) if search() else None
