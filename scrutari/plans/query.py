"""Query trees and their compilation to weighted terms.

A query is a ``Term`` or a ``Boolean`` of clauses, or an object of one's own with
a method ``compiled``. A boolean of one clause is
that clause, however it occurs. Of several, all are required or none is, and
each is a term. A term that occurs in several clauses counts once for each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from enum import Enum
from typing import Protocol, runtime_checkable

from ..functions import analysis


class QueryError(ValueError):
    """A query that can't be run."""


class FieldType(Enum):
    TEXT = "text"
    KEYWORD = "keyword"


class Occur(Enum):
    SHOULD = 0
    MUST = 1


@dataclass(frozen=True)
class Schema:
    """Which columns are indexed, and how: text is cut into tokens, a keyword is one term.

    ``analyzers`` names the analyzer of text fields that don't have the standard one.
    """

    text: tuple[str, ...] = ()
    keyword: tuple[str, ...] = ()
    analyzers: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        names = [*self.text, *self.keyword]
        for n in names:
            if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", n):
                raise QueryError(f"not a name for a field: {n!r}")
        if len({n.lower() for n in names}) < len(names):
            raise QueryError("a field occurs twice")
        if {n.lower() for n in names} & {"segment_id", "local_id"}:
            raise QueryError("segment_id and local_id are the index's own")
        if not {f for f, _ in self.analyzers} <= set(self.text) or len({f for f, _ in self.analyzers}) < len(self.analyzers):
            raise QueryError("only text fields have an analyzer, and one at most")

    @property
    def fields(self) -> tuple[str, ...]:
        return (*self.text, *self.keyword)

    def type_of(self, field: str) -> FieldType:
        if field in self.text:
            return FieldType.TEXT
        if field in self.keyword:
            return FieldType.KEYWORD
        raise QueryError(f"no such field: {field!r}")

    def analyzer_of(self, field: str) -> str:
        return dict(self.analyzers).get(field, analysis.STANDARD)


@dataclass(frozen=True)
class Term:
    """Documents of which ``field`` holds exactly ``term``, which isn't analysed."""

    field: str
    term: str


@dataclass(frozen=True)
class Clause:
    node: Term | Boolean
    occur: Occur = Occur.SHOULD


@dataclass(frozen=True)
class Boolean:
    clauses: tuple[Clause, ...] = ()


@runtime_checkable
class Node(Protocol):
    """A query of one's own: whatever says which terms it weighs, and how many of them a document must have."""

    def compiled(self, schema: Schema) -> Compiled: ...


Query = Term | Boolean | Node


def should(*terms: Term) -> Boolean:
    return Boolean(tuple(Clause(t) for t in terms))


def must(*terms: Term) -> Boolean:
    return Boolean(tuple(Clause(t, Occur.MUST) for t in terms))


def match(field: str, text: str, occur: Occur = Occur.SHOULD, schema: Schema | None = None) -> Boolean:
    """All tokens of a text that a user typed, cut by the field's analyzer in ``schema``."""
    cut = analysis.analyzer(schema.analyzer_of(field) if schema else analysis.STANDARD).text
    return Boolean(tuple(Clause(Term(field, t), occur) for t in cut(text)))


@dataclass(frozen=True)
class Compiled:
    """Distinct terms with how often each counts, and how many of them a document must have."""

    terms: tuple[tuple[str, str, float], ...]
    required: int


def compile_query(query: Query, schema: Schema) -> Compiled:
    while isinstance(query, Boolean) and len(query.clauses) == 1:
        query = query.clauses[0].node
    if isinstance(query, Node):
        own = query.compiled(schema)
        for f, _, w in own.terms:
            schema.type_of(f)
            if not w > 0:
                raise QueryError("a term's weight must be above 0")
        if len({t[:2] for t in own.terms}) < len(own.terms) or own.required < 1:
            raise QueryError("a node's terms must be distinct, and at least one required")
        return own
    if isinstance(query, Term):
        nodes, every = [query], False
    else:
        nodes = [c.node for c in query.clauses]
        if any(not isinstance(n, Term) for n in nodes):
            raise QueryError("not supported: a boolean among several clauses")
        kinds = {c.occur for c in query.clauses}
        if len(kinds) > 1:
            raise QueryError("must be either all should or all must")
        every = kinds == {Occur.MUST}
    for n in nodes:
        schema.type_of(n.field)
    count = Counter((n.field, n.term) for n in nodes)
    return Compiled(tuple((f, t, w) for (f, t), w in count.items()), len(count) if every else 1)
