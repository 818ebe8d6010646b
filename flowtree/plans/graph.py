"""Property graphs from tables: declarative assertions, what can be inferred from them, and vertex and edge tables.

A vertex is one (entity_type, key_property, key_value), an edge one (relationship_type, source, target). However often
they are asserted they are there once; a property set more than once holds the value of the last row by the table's
order column, or without one the greatest value. Rows with a null key name nothing and make nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from functools import reduce
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import REGISTRY
from ..types import NAMED

VERTICES = "entity_type string, key_property string, key_value string, properties map<string,string>"
EDGES = "relationship_type string, source_type string, source_property string, source_value string, target_type string, target_property string, target_value string, properties map<string,string>"
_V = ["entity_type", "key_property", "key_value"]
_E = ["relationship_type", "source_type", "source_property", "source_value", "target_type", "target_property", "target_value"]


class AmbiguityError(ValueError):
    """More than one value can be inferred."""


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame

    def match(self, source: str, relationship: str, target: str) -> DataFrame:
        """(source_value, source_properties, target_value, target_properties, properties) of one kind of edge with its ends."""
        return master_table(self, [(source, relationship, target)])


@dataclass
class _Part:
    """The assertions that name the same things by the same rows: their values, where these name anything, and the properties set
    (name, value and place in the order). ``once``: each row names something, and no two the same."""

    df: DataFrame
    values: dict[str, Column]
    where: Column | None
    once: bool
    properties: list[tuple[str, Column, str | None]] = field(default_factory=list)

    def is_of(self, df: DataFrame, values: dict[str, Column], where: Column | None, bare: bool) -> bool:
        return self.df is df and bare != bool(self.properties) and all(_same(x, values[k]) for k, x in self.values.items()) and _same(self.where, where)


def _same(a: Column | None, b: Column | None) -> bool:
    return a is b or a is not None and b is not None and bool(a._jc.equals(b._jc))


class _Assertions:
    """Assertions by the kind of what they assert. Each kind is merged by itself, so that rows hold values alone, without the kind's
    names, and kinds that a query filters out aren't read. A table is read once for each kind's bare assertions and once for its properties,
    however many there are."""

    def __init__(self) -> None:
        self.kinds: dict[tuple[tuple[str, str], ...], list[_Part]] = {}

    def _add(self, df: DataFrame, kind: dict[str, str], values: dict[str, Column], properties: dict[str, Column] | None, order: str | None, where: Column | None, once: bool = False) -> None:
        parts = self.kinds.setdefault(tuple(kind.items()), [])
        part = next((p for p in parts if p.is_of(df, values, where, not properties)), None)
        if part is None:
            parts.append(part := _Part(df, values, where, once))
        part.once &= once
        part.properties += [(n, x, order) for n, x in (properties or {}).items()]

    def merged(self, key: list[str]) -> DataFrame | None:
        """A row for each thing: ``key`` and the map of its properties."""
        made: list[DataFrame] = []
        lone: list[list[tuple[dict[str, str], _Part]]] = []
        for kind, parts in self.kinds.items():
            if len(parts) == 1 and parts[0].once:
                same = next((x for x in lone if x[0][1].df is parts[0].df), None)
                if same is None:
                    lone.append(same := [])
                same.append((dict(kind), parts[0]))
            else:
                made.append(_merged(parts).select(*(F.lit(dict(kind)[k]).alias(k) if k in dict(kind) else k for k in key), "properties"))
        made += [_unmerged(x, key) for x in lone]
        return reduce(DataFrame.unionByName, made) if made else None


def _properties(values: dict[str, Column]) -> Column:
    none = F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*(c for n in sorted(values) for c in (F.lit(n), values[n]))), lambda _, x: x.isNotNull()) if values else none


def _unmerged(made: list[tuple[dict[str, str], _Part]], key: list[str]) -> DataFrame:
    """The things of several kinds that the rows of one table name once. Values that these share stay columns, so that rows stay partitioned by them.
    A kind's names come from conditions on its number, which a filter on them folds, so that rows of kinds filtered out aren't read."""
    first = made[0][1]
    shared = [k for k, x in first.values.items() if all(_same(x, p.values[k]) for _, p in made)]
    own = [F.struct(F.lit(n).alias("kind"), *(x.cast("string").alias(k) for k, x in p.values.items() if k not in shared), _properties({n: x.cast("string") for n, x, _ in p.properties}).alias("properties")) for n, (_, p) in enumerate(made)]
    rows = first.df.select(*(first.values[k].cast("string").alias(k) for k in shared), F.explode(F.array(*own)).alias("a"))

    def named(k: str) -> Column:
        names = [kind[k] for kind, _ in made]
        out = F.lit(names[-1])
        for n, x in list(enumerate(names[:-1]))[::-1]:
            out = F.when(F.col("a.kind") == n, x).otherwise(out) if x != names[-1] else out
        return out

    return rows.select(*(k if k in shared else F.col(f"a.{k}") if k in first.values else named(k).alias(k) for k in key), "a.properties")


def _merged(parts: list[_Part]) -> DataFrame:
    """The things of one kind: values, and properties."""
    key, names = list(parts[0].values), sorted({n for p in parts for n, *_ in p.properties})
    whole = lambda v: all(isinstance(p.df.select(p.values[v]).schema[0].dataType, T.IntegralType) for p in parts)
    kinds = {v: "bigint" if len(key) > 1 and whole(v) else "string" for v in key}  # pairs of numbers take less memory; single names stay partitioned for joins
    ordered = {n for p in parts for n, _, order in p.properties if order is not None}  # without an order the greatest value is the last

    def named(p: _Part) -> Column:
        """What a row of the part's table names, with what it sets each property to; null if it names nothing."""
        there = reduce(lambda x, y: x & y, [c.isNotNull() for c in p.values.values()] + ([] if p.where is None else [p.where]))
        sets = []
        for k, n in enumerate(names):
            mine = [F.struct(_rank(p.df, order).alias("seq"), x.cast("string").alias("x")) if n in ordered else x.cast("string") for m, x, order in p.properties if m == n]
            none = F.lit(None).cast("struct<seq:struct<d:double,n:decimal(38,9),s:string>,x:string>" if n in ordered else "string")
            sets.append((none if not mine else mine[0] if len(mine) == 1 else F.greatest(*mine) if n not in ordered else F.array_max(F.array(*mine))).alias(f"p{k}"))
        return F.when(there, F.struct(*(c.cast(kinds[v]).alias(v) for v, c in p.values.items()), *sets))

    tables: list[tuple[DataFrame, bool, list[Column]]] = []
    for p in parts:
        same = next((made for df, bare, made in tables if df is p.df and bare != bool(p.properties)), None)
        if same is None:
            tables.append((p.df, not p.properties, same := []))
        same.append(named(p))
    read = [df.select((F.explode(F.array_compact(F.array(*made))) if len(made) > 1 else made[0]).alias("a")).where("a IS NOT NULL").select("a.*") for df, _, made in tables]
    rows = reduce(DataFrame.unionByName, read)
    if not ordered:
        rows = rows.distinct()  # by a hash; the greatest are found by a sort, which would hold every row that repeats what others say
    if names:  # max_by, as Catalyst drops a distinct() below max
        rows = rows.groupBy(*key).agg(*(F.max(f"p{k}").alias(f"p{k}") if ordered else F.max_by(f"p{k}", f"p{k}").alias(f"p{k}") for k in range(len(names))))
    properties = _properties({n: F.col(f"p{k}.x" if n in ordered else f"p{k}") for k, n in enumerate(names)})
    return rows.select(*(F.col(k).cast("string").alias(k) for k in key), properties.alias("properties"))


def _rank(df: DataFrame, order: str | None) -> Column:
    """What rows are ordered by, alike for all tables: numbers by value (as doubles, then with all their digits), anything else as text, which dates and timestamps sort by too."""
    c = F.lit(None).cast("string") if order is None else F.col(f"`{order}`")
    number = order is not None and isinstance(df.schema[order].dataType, T.NumericType)
    return F.struct((c if number else F.lit(None)).cast("double").alias("d"), (c if number else F.lit(None)).try_cast("decimal(38,9)").alias("n"), (F.lit(None) if number else c).cast("string").alias("s"))


class Vertices(_Assertions):
    """Assertions of vertices; ``order`` is the column by which the last row wins, ``where`` says which rows make any, ``once`` that no two make the same."""

    def add(self, df: DataFrame, entity: str, key: str, value: Column, properties: dict[str, Column] | None = None, order: str | None = None, where: Column | None = None, once: bool = False) -> None:
        self._add(df, {"entity_type": entity, "key_property": key}, {"key_value": value}, properties, order, where, once)


class Edges(_Assertions):
    def add(self, df: DataFrame, kind: str, source: tuple[str, str, Column], target: tuple[str, str, Column], properties: dict[str, Column] | None = None, order: str | None = None, where: Column | None = None, once: bool = False) -> None:
        kinds = {f"{side}_{what}": x for side, end in (("source", source), ("target", target)) for what, x in zip(("type", "property"), end)}
        self._add(df, {"relationship_type": kind} | kinds, {"source_value": source[2], "target_value": target[2]}, properties, order, where, once)


def merged(spark: SparkSession, vertices: Vertices, edges: Edges) -> Graph:
    made = [a.merged(key) for a, key in ((vertices, _V), (edges, _E))]
    return Graph(*(spark.createDataFrame([], schema) if m is None else m for m, schema in zip(made, (VERTICES, EDGES))))


@dataclass(frozen=True)
class Assertion:
    """Any assertion; attributes that its kind has no use for are None. ``explicit`` are those that were written down."""

    kind: str
    table: str
    entity_type: str | None = None
    property_column: str | None = None
    property_type: str | None = None
    entity_name_column: str | None = None
    entity_name_property: str | None = None
    relationship_type: str | None = None
    relationship_alias: str | None = None
    relationship_property_column: str | None = None
    relationship_property_type: str | None = None
    source_entity_type: str | None = None
    target_entity_type: str | None = None
    source_entity_name_column: str | None = None
    target_entity_name_column: str | None = None
    source_name_property: str | None = None
    target_name_property: str | None = None
    source_entity_alias: str | None = None
    target_entity_alias: str | None = None
    components: tuple[dict, ...] = ()
    function: str | None = None
    alias: str | None = None
    explicit: frozenset[str] = field(default_factory=frozenset)

    def inferred(self, attribute: str) -> bool:
        return attribute not in self.explicit and getattr(self, attribute) is not None


_RENAMED = {"source_entity_name_property": "source_name_property", "target_entity_name_property": "target_name_property", "property_name": "property_type", "source_column": "source_entity_name_column", "target_column": "target_entity_name_column", "source_entity_property": "source_name_property", "target_entity_property": "target_name_property"}
_NAMES = {f.name for f in fields(Assertion)} - {"kind", "table", "explicit"}
KINDS = ("name", "property", "relationship", "relationship_property", "compound_name", "coreference")


class TableModel:
    """The assertions of tables, with what is missing inferred where there is one way to."""

    def __init__(self, assertions: list[Assertion], infer: bool = True) -> None:
        self.assertions = assertions
        if infer:
            self.assertions = [self._completed(a) for a in assertions]

    @classmethod
    def from_config(cls, config: dict[str, Any]) -> TableModel:
        out = []
        for table, spec in config.items():
            for item in spec["data_config"]:
                ((kind, given),) = item.items()
                if kind not in KINDS:
                    raise ValueError(f"{table}: unknown assertion {kind!r}")
                given = {_RENAMED.get(k, k): v for k, v in (given or {}).items()}
                if kind == "name" and "entity_name_column" in given:
                    given.setdefault("property_column", given["entity_name_column"])
                unknown = set(given) - _NAMES - {"data_type"}
                if unknown:
                    raise ValueError(f"{table}, {kind}: unknown attributes {sorted(unknown)}")
                if "components" in given:
                    given["components"] = tuple(given["components"])
                out.append(Assertion(kind=kind, table=table, explicit=frozenset(given), **given))
        return cls(out)

    @classmethod
    def from_yaml(cls, *files: str) -> TableModel:
        config: dict[str, Any] = {}
        for name in files:
            with open(name, encoding="utf-8") as f:
                config |= yaml.safe_load(f)
        return cls.from_config(config)

    def of(self, kind: str, table: str | None = None) -> list[Assertion]:
        return [a for a in self.assertions if a.kind == kind and table in (None, a.table)]

    def _names_on(self, table: str, column: str | None) -> list[Assertion]:
        return [a for a in self.of("name") if column is not None and a.property_column == column and a.table == table] or [a for a in self.of("name") if column is not None and a.property_column == column]

    def _one(self, a: Assertion, what: str, found: set) -> Any:
        found = {x for x in found if x is not None}
        if len(found) > 1:
            raise AmbiguityError(f"{a.table}, {a.kind}: {what} may be any of {sorted(found)}")
        return found.pop() if found else None

    def _completed(self, a: Assertion) -> Assertion:
        new: dict[str, Any] = {}
        for column, kind, prop in (("entity_name_column", "entity_type", "entity_name_property"), ("source_entity_name_column", "source_entity_type", "source_name_property"), ("target_entity_name_column", "target_entity_type", "target_name_property")):
            on = self._names_on(a.table, getattr(a, column))
            if getattr(a, kind) is None:
                new[kind] = self._one(a, kind, {n.entity_type for n in on})
            if getattr(a, prop) is None and column in a.explicit:
                new[prop] = self._one(a, prop, {n.property_type for n in on})
        return replace(a, **new)

    # what follows from the assertions
    def assertion_has_entity_type(self) -> set[tuple[str, str, str]]:
        return {(a.table, a.kind, a.entity_type) for a in self.assertions if a.entity_type}

    def entity_has_property(self) -> set[tuple[str, str]]:
        return {(a.entity_type, a.property_type) for a in self.of("property") if a.entity_type}

    def assertion_has_column(self) -> set[tuple[str, str, str]]:
        return {(a.table, a.kind, c) for a in self.assertions for c in columns_of(a)}

    def table_has_column(self) -> set[tuple[str, str]]:
        return {(t, c) for t, _, c in self.assertion_has_column()}

    def assertion_has_parent_table(self) -> set[tuple[str, str, str]]:
        return {(t, k, owner) for t, k, c in self.assertion_has_column() for owner, d in self.table_has_column() if c == d and owner == t}

    def assertion_has_property_type(self) -> set[tuple[str, str, str]]:
        return {(a.table, a.property_column, a.property_type) for a in self.assertions if a.property_column and a.property_type}

    def is_assertion(self) -> set[tuple[str, str]]:
        return {(a.table, a.kind) for a in self.assertions}

    def assertion_without_column(self) -> set[tuple[str, str]]:
        return self.is_assertion() - {(t, k) for t, k, _ in self.assertion_has_column()}

    def assertion_without_entity_type(self) -> set[tuple[str, str]]:
        return self.is_assertion() - {(t, k) for t, k, _ in self.assertion_has_entity_type()}

    def relationship_has_source_name_property(self) -> set[tuple[str, str]]:
        return {(a.relationship_type, n.property_type) for a in self.of("relationship") for n in self._names_on(a.table, a.source_entity_name_column)}

    def to_graph(self, tables: dict[str, DataFrame], order: dict[str, str] | None = None) -> Graph:
        """The graph of all assertions over their tables."""
        vertices, edges = Vertices(), Edges()
        spark = next(iter(tables.values())).sparkSession
        for a in self.assertions:
            if a.table in tables:
                _assert(a, tables[a.table], (order or {}).get(a.table), vertices, edges)
        return merged(spark, vertices, edges)


def columns_of(a: Assertion) -> list[str]:
    own = [a.property_column, a.entity_name_column, a.source_entity_name_column, a.target_entity_name_column, a.relationship_property_column]
    return [c for c in [*own, *(x["column_name"] for x in a.components)] if c]


def _value(a: Assertion, column: str, types: dict[str, str] | None = None) -> Column:
    c = F.col(f"`{column}`")
    f = REGISTRY.get(a.function) if a.function else None
    return f(c) if f else c


def _assert(a: Assertion, df: DataFrame, order: str | None, vertices: Vertices, edges: Edges) -> None:
    col = lambda name: F.col(f"`{name}`")
    if a.kind == "name":
        vertices.add(df, a.entity_type, a.property_type, _value(a, a.property_column))
    elif a.kind == "property":
        vertices.add(df, a.entity_type, a.entity_name_property, col(a.entity_name_column), {a.property_type: _value(a, a.property_column)}, order)
    elif a.kind in ("relationship", "relationship_property"):
        ends = [(getattr(a, f"{side}_entity_type"), getattr(a, f"{side}_name_property"), col(getattr(a, f"{side}_entity_name_column"))) for side in ("source", "target")]
        both = ends[0][2].isNotNull() & ends[1][2].isNotNull()
        for end in ends:
            vertices.add(df, *end, where=both)
        extra = {a.relationship_property_type: _value(a, a.relationship_property_column)} if a.kind == "relationship_property" else None
        edges.add(df, a.relationship_type, *ends, extra, order)
    elif a.kind == "compound_name":
        there = reduce(lambda x, y: x & y, (col(x["column_name"]).isNotNull() for x in a.components))
        each = df.where(there).select(*(col(x["column_name"]).cast("string").alias(f"c{k}") for k, x in enumerate(a.components))).distinct()  # narrow rows, before they get a hash
        parts = [(x["entity_type"], x["entity_name_property"], F.col(f"c{k}")) for k, x in enumerate(a.components)]
        each = each.withColumn("uuid", F.sha2(F.to_json(F.array(*(p[2] for p in parts))), 256)).repartition("uuid")  # all that is of a compound is in one place
        ident = F.col("uuid")
        vertices.add(each, a.entity_type, "uuid", ident, once=True)
        for k, (x, part) in enumerate(zip(a.components, parts)):
            vertices.add(df, *part[:2], col(x["column_name"]), where=there)
            edges.add(each, f"R{k}", part, (a.entity_type, "uuid", ident), {"component": F.lit(x.get("type"))} if x.get("type") else None, once=True)
    elif a.kind == "coreference":
        ends = [(getattr(a, f"{side}_entity_type"), getattr(a, f"{side}_name_property"), col(getattr(a, f"{side}_entity_name_column"))) for side in ("source", "target")]
        edges.add(df, "SAME_AS", *ends)


def typed_properties(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Properties as columns of their declared types (Integer, String, DateTime, Float, Boolean), null where absent or unreadable."""
    got = {p: F.try_element_at("properties", F.lit(p)).try_cast(NAMED[t]) for p, t in types.items()}
    return df.withColumns(got).drop("properties")


def master_table(graph: Graph, pattern: list[tuple[str, str, str]]) -> DataFrame:
    """Matches of a connected pattern of (source type, relationship, target type): one row for each way through all of it.

    Each type is one column ``<type>`` (its key) with ``<type>_properties``; each relationship has ``<rel>_properties``.
    A chain of equi-joins on keys, which Catalyst orders; each edge and vertex kind is read by its own filter.
    """
    out: DataFrame | None = None
    bound: list[str] = []
    left = list(pattern)
    while left:
        k = next((i for i, (s, _, t) in enumerate(left) if out is None or s in bound or t in bound), None)
        if k is None:
            raise ValueError(f"{left[0]} isn't connected with the rest of the pattern")
        s, r, t = left.pop(k)
        e = graph.edges.where((F.col("relationship_type") == r) & (F.col("source_type") == s) & (F.col("target_type") == t))
        e = e.select(F.col("source_value").alias(s), F.col("target_value").alias(t), F.col("properties").alias(f"{r}_properties"))
        out = e if out is None else out.join(e, [c for c in (s, t) if c in bound])
        for end in (s, t):
            if end not in bound:
                v = graph.vertices.where(F.col("entity_type") == end).select(F.col("key_value").alias(end), F.col("properties").alias(f"{end}_properties"))
                out = out.join(v, end)
                bound.append(end)
    return out


def extrapolated(model: TableModel) -> list[tuple[str, str, str]]:
    """The pattern of all relationships between different types that the model states."""
    found = {(a.source_entity_type, a.relationship_type, a.target_entity_type) for a in model.of("relationship") if a.source_entity_type != a.target_entity_type}
    return sorted(found)


def statements(graph: Graph) -> DataFrame:
    """(cypher, parameters): one idempotent statement for each vertex and edge, vertices first by ``step``; for graph databases."""
    quoted = lambda c: F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))
    v = graph.vertices.select(
        F.lit(0).alias("step"), F.concat(F.lit("MERGE (v:"), quoted(F.col("entity_type")), F.lit(" {"), quoted(F.col("key_property")), F.lit(": $key}) SET v += $properties")).alias("cypher"),
        F.to_json(F.struct(F.col("key_value").alias("key"), F.col("properties"))).alias("parameters"),
    )
    end = lambda n, side: F.concat(F.lit(f"MERGE ({n}:"), quoted(F.col(f"{side}_type")), F.lit(" {"), quoted(F.col(f"{side}_property")), F.lit(f": ${side}}}) "))
    e = graph.edges.select(
        F.lit(1).alias("step"), F.concat(end("a", "source"), end("b", "target"), F.lit("MERGE (a)-[r:"), quoted(F.col("relationship_type")), F.lit("]->(b) SET r += $properties")).alias("cypher"),
        F.to_json(F.struct(F.col("source_value").alias("source"), F.col("target_value").alias("target"), F.col("properties"))).alias("parameters"),
    )
    return v.union(e)
