"""The text form of tree queries and graph models.

    f IS A PYTHON FUNCTION IMPORTED FROM a.b.f;
    QUERY q IS SELECT x.key AS out, f(y.key) AS other FROM obj START AT TOP AS x GO DOWN UNTIL HAS KEY key AS y;
    IN QUERY q out IS A UNIQUE PROPERTY p OF ENTITY e;
    IN QUERY q other IS A PROPERTY p OF ENTITY e NAMED BY out;
    IN QUERY q e NAMED BY out IS RELATED TO d NAMED BY other AS r;
    IN QUERY q a AND b COREFER;

Conditions: TOP, HAS KEY k, NOT c, (c AND c), (c OR c). START AT TOP is the root, START AT any other condition every node
below the root that meets it. Identifiers are letters, digits and underscores, other than the upper-case keywords.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import REGISTRY, load_function
from .graph import Edges, Graph, Vertices, merged
from .tree import Chain, Condition, HasKey, IsRoot, Relation, Step, go_down, go_up, stay_here

KEYWORDS = frozenset("SELECT TOP HAS DATA FILE LOCAL JSON KEY QUERY UNIQUE PROPERTY OF NAMED BY IS IN A ENTITY RELATED AND AS CSV COREFER OR TO NOT PYTHON FUNCTION IMPORTED FROM SOURCE START AN AT GO UP DOWN UNTIL".split())
_TOKEN = re.compile(r"\s*(?:(?P<word>[A-Za-z_]\w*)|(?P<mark>[;,.()])|(?P<bad>\S))")


class QuerySyntaxError(ValueError):
    """Where the text isn't of the grammar."""


@dataclass(frozen=True)
class Keypath:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Application:
    function: str
    args: tuple[Keypath | Application, ...]


@dataclass(frozen=True)
class Select:
    selections: tuple[tuple[str, Keypath | Application], ...]
    source: str
    chain: Chain | None


@dataclass(frozen=True)
class Query:
    name: str
    select: Select


@dataclass(frozen=True)
class Function:
    name: str
    path: str


@dataclass(frozen=True)
class Property:
    query: str
    selection: str
    name: str
    entity: str
    named_by: str | None = None

    @property
    def unique(self) -> bool:
        return self.named_by is None


@dataclass(frozen=True)
class Relationship:
    query: str
    entity_1: str
    selection_1: str
    entity_2: str
    selection_2: str
    name: str


@dataclass(frozen=True)
class Coreference:
    query: str
    first: str
    second: str


def tokenize(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, position): kind is the keyword, the mark, or 'label'."""
    out, at = [], 0
    while m := _TOKEN.match(text, at):
        if m["bad"]:
            raise QuerySyntaxError(f"unexpected {m['bad']!r} at {m.start('bad')}")
        word = m["word"] or m["mark"]
        out.append((word if word in KEYWORDS or m["mark"] else "label", word, m.start(m.lastgroup)))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokenize(text), 0

    def sees(self, *kinds: str) -> bool:
        return [k for k, *_ in self.tokens[self.at : self.at + len(kinds)]] == list(kinds)

    def take(self, *kinds: str) -> str:
        for kind in kinds:
            if not self.sees(kind):
                found = self.tokens[self.at][1:] if self.at < len(self.tokens) else ("the end", "")
                raise QuerySyntaxError(f"expected {kind}, found {found[0]} {found[1]}")
            self.at += 1
        return self.tokens[self.at - 1][1]

    def program(self) -> list:
        out = []
        while self.at < len(self.tokens):
            out.append(self.statement())
            self.take(";")
        if not out:
            raise QuerySyntaxError("there is no statement")
        return out

    def statement(self) -> Any:
        if self.sees("QUERY"):
            self.take("QUERY")
            name = self.take("label")
            self.take("IS")
            return Query(name, self.select())
        if self.sees("SELECT"):
            return self.select()
        if self.sees("IN"):
            return self.assertion()
        if self.sees("START") or self.sees("GO"):
            return self.chain()
        if self.sees("TOP") or self.sees("HAS") or self.sees("NOT") or self.sees("("):
            return self.condition()
        if self.sees("label", "IS"):
            name = self.take("label")
            self.take("IS", "A", "PYTHON", "FUNCTION", "IMPORTED", "FROM")
            return Function(name, ".".join(self.keypath().parts))
        if self.sees("label", "("):
            applied = self.value()
            return applied if not self.sees("AS") else self.selections(applied)
        return self.selections()

    def select(self) -> Select:
        self.take("SELECT")
        chosen = self.selections()
        self.take("FROM")
        source = self.take("label")
        return Select(chosen, source, self.chain() if self.sees("START") or self.sees("GO") else None)

    def selections(self, first: Keypath | Application | None = None) -> tuple:
        out = []
        while True:
            value = first if first is not None and not out else self.value()
            self.take("AS")
            out.append((self.take("label"), value))
            if not self.sees(","):
                return tuple(out)
            self.take(",")

    def value(self) -> Keypath | Application:
        if not self.sees("label", "("):
            return self.keypath()
        name = self.take("label")
        self.take("(")
        args = [self.value()]
        while self.sees(","):
            self.take(",")
            args.append(self.value())
        self.take(")")
        return Application(name, tuple(args))

    def keypath(self) -> Keypath:
        parts = [self.take("label")]
        while self.sees("."):
            self.take(".")
            parts.append(self.take("label"))
        return Keypath(tuple(parts))

    def chain(self) -> Chain:
        steps = []
        while self.sees("START") or self.sees("GO"):
            step = self.step()
            if self.sees("AS"):
                self.take("AS")
                step = step.named(self.take("label"))
            steps.append(step)
        return Chain(tuple(steps))

    def step(self) -> Step:
        if self.sees("START"):
            self.take("START", "AT")
            condition = self.condition()
            return stay_here() if condition == IsRoot() else go_down(condition)
        self.take("GO")
        down = self.sees("DOWN")
        self.take("DOWN" if down else "UP", "UNTIL")
        return (go_down if down else go_up)(self.condition())

    def condition(self) -> Condition:
        if self.sees("TOP"):
            self.take("TOP")
            return IsRoot()
        if self.sees("NOT"):
            self.take("NOT")
            return ~self.condition()
        if self.sees("HAS"):
            self.take("HAS", "KEY")
            return HasKey(self.take("label"))
        self.take("(")
        a = self.condition()
        both = self.sees("AND")
        self.take("AND" if both else "OR")
        b = self.condition()
        self.take(")")
        return a & b if both else a | b

    def assertion(self) -> Property | Relationship | Coreference:
        self.take("IN", "QUERY")
        query = self.take("label")
        first = self.take("label")
        if self.sees("AND"):
            self.take("AND")
            second = self.take("label")
            self.take("COREFER")
            return Coreference(query, first, second)
        if self.sees("NAMED"):
            self.take("NAMED", "BY")
            one = self.take("label")
            self.take("IS", "RELATED", "TO")
            entity = self.take("label")
            self.take("NAMED", "BY")
            two = self.take("label")
            self.take("AS")
            return Relationship(query, first, one, entity, two, self.take("label"))
        self.take("IS", "A")
        unique = self.sees("UNIQUE")
        if unique:
            self.take("UNIQUE")
        self.take("PROPERTY")
        name = self.take("label")
        self.take("OF", "ENTITY")
        entity = self.take("label")
        if unique:
            return Property(query, first, name, entity)
        self.take("NAMED", "BY")
        return Property(query, first, name, entity, self.take("label"))


def parse(text: str) -> list:
    """The statements of a program."""
    return _Parser(text).program()


class Model:
    """The facts that a program states, and what follows from them."""

    def __init__(self, text: str) -> None:
        self.statements = parse(text)
        self.queries = {s.name: s.select for s in self.statements if isinstance(s, Query)}
        self.functions = {s.name: s.path for s in self.statements if isinstance(s, Function)}
        self.properties = [s for s in self.statements if isinstance(s, Property)]
        self.relationships = [s for s in self.statements if isinstance(s, Relationship)]
        self.coreferences = [s for s in self.statements if isinstance(s, Coreference)]

    def query_has_relationship(self) -> set[tuple[str, str]]:
        return {(r.query, r.name) for r in self.relationships if r.query in self.queries}

    def relationship_between_entities(self) -> set[tuple[str, str, str]]:
        known = {p.entity for p in self.properties}
        return {(r.name, r.entity_1, r.entity_2) for r in self.relationships if {r.entity_1, r.entity_2} <= known}

    def unique_property_of(self) -> set[tuple[str, str]]:
        return {(p.name, p.entity) for p in self.properties if p.unique}

    def non_unique_property_of(self) -> set[tuple[str, str]]:
        return {(p.name, p.entity) for p in self.properties} - self.unique_property_of()

    def property_in_select_clause(self) -> set[tuple[str, str]]:
        return {(p.name, p.query) for p in self.properties if p.query in self.queries}

    def entity_in_select_clause(self) -> set[tuple[str, str]]:
        return {(p.entity, p.query) for p in self.properties if p.query in self.queries}

    def entity_in_data_source(self) -> set[tuple[str, str]]:
        return {(e, self.queries[q].source) for e, q in self.entity_in_select_clause()}

    def selection_has_label(self) -> set[tuple[str, str]]:
        return {(q, label) for q, s in self.queries.items() for label, _ in s.selections}

    def _end(self, k: int) -> set[tuple[str, str]]:
        ends = {(r.query, getattr(r, f"entity_{k}"), getattr(r, f"selection_{k}")): r.name for r in self.relationships}
        return {(name, p.name) for (q, e, s), name in ends.items() for p in self.properties if p.unique and (p.query, p.entity, p.selection) == (q, e, s)}

    def relationship_source_entity_property(self) -> set[tuple[str, str]]:
        return self._end(1)

    def relationship_target_entity_property(self) -> set[tuple[str, str]]:
        return self._end(2)

    def relationship_source_target_properties(self) -> set[tuple[str, str, str]]:
        return {(r, a, b) for r, a in self._end(1) for s, b in self._end(2) if r == s}

    def unique_property(self, query: str, entity: str, selection: str) -> str:
        found = {p.name for p in self.properties if p.unique and (p.query, p.entity, p.selection) == (query, entity, selection)} or {p.name for p in self.properties if p.unique and p.entity == entity}
        if len(found) != 1:
            raise ValueError(f"{entity} has {len(found)} unique properties that {selection} may name")
        return found.pop()


class TreeQuery:
    """A program bound to documents: each query as a DataFrame, and the graph that its assertions make."""

    def __init__(self, text: str, functions: dict[str, Callable] | None = None) -> None:
        self.model = Model(text)
        self.functions = dict(functions or {})

    def _function(self, name: str) -> Callable[..., Column]:
        if name in self.functions:
            return self.functions[name]
        if name in self.model.functions and name not in REGISTRY:
            return load_function(self.model.functions[name])
        return load_function(name)

    def _select(self, name: str | None) -> Select:
        if name is not None:
            return self.model.queries[name]
        found = [*self.model.queries.values(), *(s for s in self.model.statements if isinstance(s, Select))]
        if len(found) != 1:
            raise ValueError(f"there are {len(found)} queries; name one")
        return found[0]

    def to_df(self, df: DataFrame, key: str, name: str | None = None, keep: list[str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
        """A named query (or the only one) over the documents of a column; columns are the selections."""
        select = self._select(name)
        if select.chain is None:
            raise QuerySyntaxError("the query has no traversal")
        paths: dict[Keypath, str] = {}
        for _, value in select.selections:
            for k in _keypaths(value):
                paths.setdefault(k, f"__k{len(paths)}")
        given = {paths[v]: (types or {})[label] for label, v in select.selections if isinstance(v, Keypath) and label in (types or {})}
        raw = Relation(name or "query", select.chain, {out: (k.parts[0], k.parts[1:]) for k, out in paths.items()}, given).to_df(df, key, keep)

        def column(v: Keypath | Application) -> Column:
            return F.col(paths[v]) if isinstance(v, Keypath) else self._function(v.function)(*map(column, v.args))

        return raw.select(*(f"`{c}`" for c in keep or []), *(column(v).alias(label) for label, v in select.selections))

    def create_views(self, df: DataFrame, key: str) -> list[str]:
        for name in self.model.queries:
            self.to_df(df, key, name).createOrReplaceTempView(name)
        return list(self.model.queries)

    def to_graph(self, df: DataFrame, key: str) -> Graph:
        """Vertices by unique properties, edges by relationships, other properties set on the vertices that their names name;
        coreferring selections become SAME_AS edges between the vertices that they name."""
        m, vertices, edges = self.model, Vertices(), Edges()
        results = {q: self.to_df(df, key, q) for q in m.queries}
        for p in m.properties:
            rows = results[p.query]
            if p.unique:
                vertices.add(rows, p.entity, p.name, F.col(p.selection))
            else:
                vertices.add(rows, p.entity, m.unique_property(p.query, p.entity, p.named_by), F.col(p.named_by), {p.name: F.col(p.selection)})
        for r in m.relationships:
            one, two = m.unique_property(r.query, r.entity_1, r.selection_1), m.unique_property(r.query, r.entity_2, r.selection_2)
            vertices.add(results[r.query], r.entity_1, one, F.col(r.selection_1))
            vertices.add(results[r.query], r.entity_2, two, F.col(r.selection_2))
            edges.add(results[r.query], r.name, (r.entity_1, one, F.col(r.selection_1)), (r.entity_2, two, F.col(r.selection_2)))
        named = {(p.query, p.selection): (p.entity, p.name) for p in m.properties if p.unique}
        for c in m.coreferences:
            (e1, p1), (e2, p2) = named[c.query, c.first], named[c.query, c.second]
            edges.add(results[c.query], "SAME_AS", (e1, p1, F.col(c.first)), (e2, p2, F.col(c.second)))
        return merged(df.sparkSession, vertices, edges)


def _keypaths(v: Keypath | Application) -> list[Keypath]:
    return [v] if isinstance(v, Keypath) else [k for a in v.args for k in _keypaths(a)]


def read(spark: SparkSession, path: str) -> TreeQuery:
    with open(path, encoding="utf-8") as f:
        return TreeQuery(f.read())
