"""Tree queries over nested documents.

A relation is a chain of steps; each goes from a node to all nodes below it (go_down), to those above it, nearest first
(go_up), or stays (stay_here), and binds those that meet a condition to a label. The result is a bag: one row for each
path of matches, with the values that are retrieved below the labelled nodes; a missing value is null.

A query is one expression of nested higher-order functions with one generator at its end. Documents never meet, so
nothing is shuffled, and what leaves the generator is the retrieved values alone. There are two forms of it:

- columns of structs and arrays are expanded over the schema when the plan is made, and read within the JVM;
- JSON text (and variants, maps) is read in one Arrow pass, in which the chain is followed too, over nodes in pre-order, so
  that a node's descendants are a slice; what leaves the pass is the retrieved values. With conditions of other modules the
  pass gives all nodes of a document, as an array, and expressions follow the chain.

In the first form a field that is null counts as a present key, as the schema says it is there.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = "array<struct<nid:int,last:int,parent:int,depth:int,key:string,pos:int,kind:string,path:array<string>,keys:array<string>,v:string>>"


_STRINGS = pa.list_(pa.string())


def _walk(value: object, into: tuple[list, ...], with_paths: bool = True) -> int:
    """Appends a document's nodes in pre-order, column by column, and returns their number; ``last`` is the greatest nid below.

    Values are kept in a stack, not by recursion, so a document may be nested as deep as the parser reads it.
    """
    nids, lasts, parents, depths, names, positions, kinds, paths, keys, texts = into
    base, dumps = len(nids), json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
    left: list[tuple] = [(value, -1, 0, None, None, [] if with_paths else None)]
    while left:
        x, parent, depth, name, pos, path = left.pop()
        nid = len(nids) - base
        kind = _KINDS.get(type(x), "number")
        nids.append(nid)
        lasts.append(nid)
        parents.append(parent)
        depths.append(depth)
        names.append(name)
        positions.append(pos)
        kinds.append(kind)
        paths.append(path)
        keys.append(list(x) if kind == "dict" else [])
        texts.append(x if kind == "string" else None if kind == "null" else int.__repr__(x) if type(x) is int else dumps(x))
        if kind == "dict":
            left += [(v, nid, depth + 1, k, None, [*path, k] if with_paths else None) for k, v in reversed(x.items())]
        elif kind == "list":
            left += [(x[i], nid, depth + 1, None, i, [*path, str(i)] if with_paths else None) for i in reversed(range(len(x)))]
    for at in range(len(nids) - 1, base, -1):  # each node's last goes up before its parent's does
        up = base + parents[at]
        if lasts[at] > lasts[up]:
            lasts[up] = lasts[at]
    return len(nids) - base


def _read(text: str) -> object:
    """The value of JSON text; a half of a surrogate pair, which no text may hold, is replaced."""
    return json.loads(_SURROGATE.sub(r"\1\\ufffd", text) if "\\u" in text else text)


#: A \u escape (not of an escaped backslash) of a half that has no other half beside it.
_SURROGATE = re.compile(r"((?<!\\)(?:\\\\)*)\\u(?:[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2}\\u)[dD][c-fC-F][0-9a-fA-F]{2})")


_KINDS = {dict: "dict", list: "list", str: "string", bool: "bool", type(None): "null"}
_TYPES = {"nid": pa.int32(), "last": pa.int32(), "parent": pa.int32(), "depth": pa.int32(), "key": pa.string(), "pos": pa.int32(), "kind": pa.string(), "path": _STRINGS, "keys": _STRINGS, "v": pa.string()}


def _nodes_of(texts: pa.Array, with_paths: bool) -> pa.Array:
    into = tuple([] for _ in _TYPES)
    sizes, missing = [0], []
    for text in texts.to_pylist():
        try:
            value = None if text is None else _read(text)
            missing.append(text is None)
        except (ValueError, RecursionError):
            missing.append(True)
        try:
            sizes.append(sizes[-1] + (0 if missing[-1] else _walk(value, into, with_paths)))
        except RecursionError:  # nested beyond what the encoder writes
            missing[-1] = True
            sizes.append(sizes[-1])
            for column in into:
                del column[sizes[-1] :]
    flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(into, _TYPES.values())], list(_TYPES))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat, mask=pa.array(missing))


def _parse(texts: pa.Array) -> pa.Array:
    return _nodes_of(texts, True)


def _parse_without_paths(texts: pa.Array) -> pa.Array:
    return _nodes_of(texts, False)


def nodes(text: Column, with_paths: bool = True) -> Column:
    """The nodes of a JSON document in pre-order, the root first; null if it isn't JSON. Paths are null unless asked for."""
    return F.arrow_udf(_parse if with_paths else _parse_without_paths, NODES)(text)


class _Doc:
    """A document's nodes in pre-order; the greatest number below each, its depth, what is above it and its path from there. ``all_kinds``: scalars too."""

    def __init__(self, root: object, all_kinds: bool) -> None:
        self.values, self.parents, self.steps, self.lasts = [], [], [], []
        left: list[tuple] = [(root, -1, None)]
        while left:
            x, parent, step = left.pop()
            nid = len(self.values)
            self.values.append(x)
            self.parents.append(parent)
            self.steps.append(step)
            self.lasts.append(nid)
            if type(x) is dict:
                left += [(v, nid, k) for k, v in reversed(x.items()) if all_kinds or type(v) in _INNER]
            elif type(x) is list:
                left += [(x[i], nid, i) for i in range(len(x) - 1, -1, -1) if all_kinds or type(x[i]) in _INNER]
        for nid in range(len(self.values) - 1, 0, -1):
            up = self.parents[nid]
            if self.lasts[nid] > self.lasts[up]:
                self.lasts[up] = self.lasts[nid]

    def above(self, nid: int) -> list[int]:
        """Nearest first."""
        out = []
        while (nid := self.parents[nid]) >= 0:
            out.append(nid)
        return out

    def path(self, nid: int) -> list[str]:
        return [str(self.steps[i]) for i in reversed([nid, *self.above(nid)][:-1])]


_INNER = (dict, list)


def _text(x: object) -> str | None:
    """A value as the text that _walk gives it."""
    kind = type(x)
    return x if kind is str or x is None else int.__repr__(x) if kind is int else json.dumps(x, ensure_ascii=False, separators=(",", ":"))


class _Follower:
    """Follows a chain through documents: of each the rows of retrieved values, as texts; null if it isn't JSON."""

    def __init__(self, steps: tuple[Step, ...], out: Outputs) -> None:
        self.steps = [(s.direction, s.wanted()) for s in steps]
        at = {s.label: k for k, s in enumerate(steps)}
        self.gets = [[(j, path) for j, (label, path) in enumerate(out.values()) if at[label] == k] for k in range(len(steps))]
        self.width = len(out)
        self.all_kinds = any(d != "up" and c.of_scalars() for d, c in self.steps) or any(c.looks_at_scalars() for _, c in self.steps)

    def of(self, root: object, columns: list[list]) -> int:
        """Appends the rows of a document, column by column, and returns their number."""
        doc, before = _Doc(root, self.all_kinds), len(columns[0])
        found: list[list[int] | None] = [None] * len(self.steps)
        row: list[str | None] = [None] * self.width

        def follow(k: int, at: int) -> None:
            direction, condition = self.steps[k]
            if direction == "down":
                if found[k] is None:
                    found[k] = [n for n in range(len(doc.values)) if condition.holds(doc, n)]
                among = found[k][bisect.bisect_right(found[k], at) : bisect.bisect_right(found[k], doc.lasts[at])]
            else:
                among = [n for n in (doc.above(at) if direction == "up" else [at]) if condition.holds(doc, n)]
            for n in among:
                for j, path in self.gets[k]:
                    x = doc.values[n]
                    for key in path:
                        x = x.get(key) if type(x) is dict else None
                    row[j] = _text(x)
                if k + 1 < len(self.steps):
                    follow(k + 1, n)
                else:
                    for column, x in zip(columns, row):
                        column.append(x)

        follow(0, 0)
        return len(columns[0]) - before

    def __call__(self, texts: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in range(self.width)]
        sizes, missing = [0], []
        for text in texts.to_pylist():
            n = None
            try:
                n = None if text is None else self.of(_read(text), columns)
            except (ValueError, RecursionError):  # not JSON, or nested beyond what the parser reads or the encoder writes
                for column in columns:
                    del column[sizes[-1] :]
            missing.append(n is None)
            sizes.append(sizes[-1] + (n or 0))
        flat = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], [f"c{j}" for j in range(self.width)])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat, mask=pa.array(missing, pa.bool_()))


def _followed(f: _Follower) -> Callable[[pa.Array], pa.Array]:
    def rows(texts: pa.Array) -> pa.Array:
        return f(texts)

    return rows


def _own(x: object) -> bool:
    """Whether all conditions in steps are of this module, which can be followed in Python."""
    if isinstance(x, Condition) and type(x).__module__ != __name__:
        return False
    if isinstance(x, (list, tuple)):
        return all(map(_own, x))
    return not hasattr(x, "__dict__") or isinstance(x, Column) or all(map(_own, vars(x).values()))


def splitter(df: DataFrame, key: str) -> DataFrame:
    """A row for each node of each row's document, with its id, kind, path and value, beside the other columns."""
    text = _as_text(df, key)
    rest = [f"`{c}`" for c in df.columns if c != key]
    return df.select(*rest, F.inline(nodes(text)))


def leaves(df: DataFrame, key: str) -> DataFrame:
    """The nodes that aren't dicts: path and value of each; lists are leaves, and what is below them isn't listed."""
    got = F.filter(nodes(_as_text(df, key)), lambda n: n.kind != "dict")
    listless = F.transform(got, lambda n: F.struct(n.path.alias("path"), n.v.alias("v"), n.nid.alias("nid"), n.last.alias("last"), n.kind.alias("kind")))
    outer = df.select(*(f"`{c}`" for c in df.columns if c != key), listless.alias("__n"))
    kept = F.filter("__n", lambda n: ~F.exists(F.col("__n"), lambda a: (a.kind == "list") & (a.nid < n.nid) & (a.last >= n.nid)))
    return outer.withColumn("__n", F.explode(kept)).select("*", F.col("__n.path").alias("path"), F.col("__n.v").alias("value")).drop("__n")


def _as_text(df: DataFrame, key: str) -> Column:
    kind = df.schema[key].dataType
    return df[f"`{key}`"] if isinstance(kind, T.StringType) else F.to_json(df[f"`{key}`"])


def _reads_paths(x: object) -> bool:
    """Whether a condition anywhere in steps looks at paths; one that isn't of this module may."""
    if isinstance(x, Condition) and type(x).__module__ != __name__:
        return True
    if isinstance(x, (list, tuple)):
        return any(map(_reads_paths, x))
    return isinstance(x, PathEndsIn) or hasattr(x, "__dict__") and not isinstance(x, Column) and any(map(_reads_paths, vars(x).values()))


@dataclass(frozen=True)
class Place:
    """A place in a schema: its column, type, keys from the root, and the places above it, nearest first."""

    col: Column
    kind: T.DataType
    keys: tuple = ()
    above: tuple[Place, ...] = ()

    def below(self) -> list[tuple]:
        """Paths of the places below in pre-order, ``...`` for the elements of an array."""

        def walk(kind: T.DataType, at: tuple) -> Iterator[tuple]:
            for step, inner in [(f.name, f.dataType) for f in kind.fields] if isinstance(kind, T.StructType) else [(..., kind.elementType)] if isinstance(kind, T.ArrayType) else []:
                yield (*at, step)
                yield from walk(inner, (*at, step))

        return list(walk(self.kind, ()))

    def each(self, path: tuple, f: Callable[[Place], Column], empty: Column) -> Column:
        """The concatenation of f, an array, over all instances of a path below here."""
        if not path:
            return f(self)
        if path[0] is ...:
            inner = lambda x: Place(x, self.kind.elementType, (*self.keys, "#"), (self, *self.above)).each(path[1:], f, empty)
            return F.coalesce(F.flatten(F.transform(self.col, inner)), empty)
        child = Place(self.col.getField(path[0]), self.kind[path[0]].dataType, (*self.keys, path[0]), (self, *self.above))
        return F.when(self.col.isNull(), empty).otherwise(child.each(path[1:], f, empty))

    def at(self, path: tuple) -> Place:
        """The place alone, for questions that its schema answers; its column must not be read across arrays."""
        here = self
        for step in path:
            kind = here.kind.elementType if step is ... else here.kind[step].dataType
            col = F.get(here.col, F.lit(0)) if step is ... else here.col.getField(step)
            here = Place(col, kind, (*here.keys, "#" if step is ... else step), (here, *here.above))
        return here


class Condition:
    """Of a node; two-valued. Combines by & | ~, ``iff`` and ``xor``."""

    def of_node(self, n: Column, all_nodes: Column) -> Column:
        raise NotImplementedError

    def of_place(self, p: Place) -> Column | bool:
        """A column, or a boolean where the schema decides."""
        raise NotImplementedError

    def holds(self, doc: _Doc, n: int) -> bool:
        """Of a node of a document that is read in Python."""
        raise NotImplementedError

    def of_scalars(self) -> bool:
        """Whether it may hold for a scalar."""
        return True

    def looks_at_scalars(self) -> bool:
        """Whether it depends on scalars among other nodes."""
        return any(c.looks_at_scalars() for c in vars(self).values() if isinstance(c, Condition))

    def __and__(self, other: Condition) -> Condition:
        return And(self, other)

    def __or__(self, other: Condition) -> Condition:
        return ~(~self & ~other)

    def __invert__(self) -> Condition:
        return Not(self)

    def iff(self, other: Condition) -> Condition:
        return (self & other) | (~self & ~other)

    def xor(self, other: Condition) -> Condition:
        return ~self.iff(other)


def _both(a: Column | bool, b: Column | bool) -> Column | bool:
    if a is False or b is False:
        return False
    return b if a is True else a if b is True else a & b


@dataclass(frozen=True)
class And(Condition):
    a: Condition
    b: Condition

    def of_node(self, n, all_nodes):
        return self.a.of_node(n, all_nodes) & self.b.of_node(n, all_nodes)

    def of_place(self, p):
        return _both(self.a.of_place(p), self.b.of_place(p))

    def holds(self, doc, n):
        return self.a.holds(doc, n) and self.b.holds(doc, n)

    def of_scalars(self):
        return self.a.of_scalars() and self.b.of_scalars()


@dataclass(frozen=True)
class Not(Condition):
    a: Condition

    def of_node(self, n, all_nodes):
        return ~self.a.of_node(n, all_nodes)

    def of_place(self, p):
        x = self.a.of_place(p)
        return (not x) if isinstance(x, bool) else ~x

    def holds(self, doc, n):
        return not self.a.holds(doc, n)


@dataclass(frozen=True)
class Yes(Condition):
    def of_node(self, n, all_nodes):
        return F.lit(True)

    def of_place(self, p):
        return True

    def holds(self, doc, n):
        return True


@dataclass(frozen=True)
class HasKey(Condition):
    """A dict with that key, whatever its value."""

    key: str

    def of_node(self, n, all_nodes):
        return F.array_contains(n.keys, self.key)

    def of_place(self, p):
        return p.col.isNotNull() if isinstance(p.kind, T.StructType) and self.key in p.kind.names else False

    def holds(self, doc, n):
        return type(doc.values[n]) is dict and self.key in doc.values[n]

    def of_scalars(self):
        return False


@dataclass(frozen=True)
class _Kind(Condition):
    def of_node(self, n, all_nodes):
        return n.kind == self.kind

    def of_place(self, p):
        return p.col.isNotNull() if isinstance(p.kind, self.spark) else False

    def holds(self, doc, n):
        return _KINDS.get(type(doc.values[n])) == self.kind

    def of_scalars(self):
        return False


@dataclass(frozen=True)
class IsList(_Kind):
    kind, spark = "list", T.ArrayType


@dataclass(frozen=True)
class IsDictionary(_Kind):
    kind, spark = "dict", T.StructType


@dataclass(frozen=True)
class IsRoot(Condition):
    def of_node(self, n, all_nodes):
        return n.depth == 0

    def of_place(self, p):
        return not p.above

    def holds(self, doc, n):
        return n == 0


@dataclass(frozen=True)
class PathEndsIn(Condition):
    """The keys from the root (list indexes as text, '#' in the typed form) end with these; none at all: the root."""

    path: tuple[str, ...]

    def of_node(self, n, all_nodes):
        k = len(self.path)
        if not k:
            return n.depth == 0
        return F.when(F.size(n.path) >= k, F.slice(n.path, -k, k) == F.array(*(F.lit(str(x)) for x in self.path))).otherwise(F.lit(False))

    def of_place(self, p):
        return p.keys[-len(self.path) :] == tuple(self.path) if self.path else not p.above

    def holds(self, doc, n):
        return doc.path(n)[-len(self.path) :] == [str(x) for x in self.path] if self.path else n == 0


@dataclass(frozen=True)
class HasDescendant(Condition):
    condition: Condition

    def of_node(self, n, all_nodes):
        return F.exists(F.slice(all_nodes, n.nid + 2, n.last - n.nid), lambda x: self.condition.of_node(x, all_nodes))

    def of_place(self, p):
        none = F.array().cast("array<boolean>")
        found = False
        for path in p.below():
            seen = self.condition.of_place(p.at(path))
            if seen is False:
                continue
            some = p.each(path, lambda q: F.array(_column(self.condition.of_place(q))), none)
            one = F.array_contains(some, True)
            found = one if found is False else found | one
        return found

    def holds(self, doc, n):
        return any(self.condition.holds(doc, x) for x in range(n + 1, doc.lasts[n] + 1))

    def of_scalars(self):
        return False

    def looks_at_scalars(self):
        return self.condition.of_scalars() or self.condition.looks_at_scalars()


@dataclass(frozen=True)
class HasAncestor(Condition):
    condition: Condition

    def of_node(self, n, all_nodes):
        return F.exists(F.slice(all_nodes, F.lit(1), n.nid), lambda x: (x.last >= n.nid) & self.condition.of_node(x, all_nodes))

    def of_place(self, p):
        found: Column | bool = False
        for a in p.above:
            x = self.condition.of_place(a)
            if x is True:
                return True
            if x is not False:
                found = x if found is False else found | x
        return found

    def holds(self, doc, n):
        return any(self.condition.holds(doc, x) for x in doc.above(n))


def _column(x: Column | bool) -> Column:
    return F.lit(x) if isinstance(x, bool) else F.coalesce(x, F.lit(False))


@dataclass(frozen=True)
class Step:
    direction: str
    condition: Condition = Yes()
    label: str | None = None
    truth_value: bool = True
    get: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def named(self, label: str) -> Step:
        return replace(self, label=label)

    __add__ = named

    def retrieving(self, **outputs: str | list[str]) -> Step:
        """Output columns by name: keypaths below the node ('' is the node itself)."""
        return replace(self, get={k: tuple(v.split(".") if isinstance(v, str) and v else v or ()) for k, v in outputs.items()})

    def __getitem__(self, key: str) -> Step:
        return replace(self, get={**self.get, key: (key,)})

    def wanted(self) -> Condition:
        return self.condition if self.truth_value else ~self.condition

    def then(self, other: Step | Chain) -> Chain:
        return Chain((self,)).then(other)

    @property
    def head(self) -> Step:
        return self

    def all_traversals(self) -> tuple[Step, ...]:
        return (self,)


@dataclass(frozen=True)
class Chain:
    steps: tuple[Step, ...]

    def then(self, other: Step | Chain) -> Chain:
        return Chain((*self.steps, *other.all_traversals()))

    @property
    def head(self) -> Step:
        return self.steps[0]

    @property
    def tail(self) -> Chain:
        return Chain(self.steps[1:])

    def all_traversals(self) -> tuple[Step, ...]:
        return self.steps


def go_down(condition: Condition = Yes(), label: str | None = None, truth_value: bool = True) -> Step:
    return Step("down", condition, label, truth_value)


def go_up(condition: Condition = Yes(), label: str | None = None, truth_value: bool = True) -> Step:
    return Step("up", condition, label, truth_value)


def stay_here(label: str | None = None, condition: Condition = Yes()) -> Step:
    return Step("stay", condition, label)


Outputs = dict[str, tuple[str, tuple[str, ...]]]


def _unpacked(df: DataFrame, kept: list[str], rows: Column) -> DataFrame:
    """A row for each struct of an array. By explode: Spark 4.1 can lose the rows of an inline() over pruned nested columns."""
    return df.select(*kept, F.explode(rows).alias("__row")).select(*kept, "__row.*")


@dataclass
class Relation:
    """Retrieved values, by row of matches: {output: (label, keypath)}; steps' own ``get`` adds to it."""

    name: str
    chain: Step | Chain
    outputs: Outputs = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)

    def _wanted(self) -> tuple[tuple[Step, ...], Outputs]:
        steps, out = [], dict(self.outputs)
        for k, s in enumerate(self.chain.all_traversals()):
            label = s.label or f"__{k}"
            steps.append(replace(s, label=label))
            out |= {o: (label, p) for o, p in s.get.items()}
        for o, (label, _) in out.items():
            if label not in {s.label for s in steps}:
                raise ValueError(f"{self.name}: {o} is of {label!r}, which labels no step")
        return tuple(steps), out

    def to_df(self, df: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
        """The relation of each document in a column, beside the columns to ``keep``. Values are text unless ``types`` or a schema says more."""
        steps, out = self._wanted()
        kind = df.schema[key].dataType
        kept = [f"`{c}`" for c in keep or []]
        if isinstance(kind, (T.StructType, T.ArrayType)):
            return _unpacked(df, kept, self._typed(Place(df[f"`{key}`"], kind), steps, out))
        if out and _own(steps):
            rows = F.arrow_udf(_followed(_Follower(steps, out)), "array<struct<" + ",".join(f"c{j}:string" for j in range(len(out))) + ">>")(_as_text(df, key))
            each = df.select(*kept, F.explode(rows).alias("__row"))
            return each.select(*kept, *(F.col(f"__row.c{j}").try_cast(self.types.get(o, "string")).alias(o) for j, o in enumerate(out)))
        parsed = df.select(*kept, nodes(_as_text(df, key), _reads_paths(steps)).alias("__nodes"))
        rows = self._parsed(F.col("__nodes"), steps, out)
        return _unpacked(parsed, kept, F.when(F.col("__nodes").isNotNull(), rows))

    def _parsed(self, all_nodes: Column, steps: tuple[Step, ...], out: Outputs) -> Column:
        def value(n: Column, path: tuple[str, ...], to: str) -> Column:
            for k in path:
                n = child(n, k)
            return n.v.try_cast(to)

        def child(n: Column, k: str) -> Column:
            inside = F.slice(all_nodes, n.nid + 2, F.coalesce(n.last - n.nid, F.lit(0)))
            return F.get(F.filter(inside, lambda x: (x.parent == n.nid) & (x.key == k)), F.lit(0))

        def rows(k: int, at: Column, bound: dict[str, Column]) -> Column:
            if k == len(steps):
                return F.array(F.struct(*(value(bound[label], p, self.types.get(o, "string")).alias(o) for o, (label, p) in out.items())))
            s = steps[k]
            if s.direction == "down":
                among = F.slice(all_nodes, at.nid + 2, at.last - at.nid)
            elif s.direction == "up":
                among = F.reverse(F.filter(F.slice(all_nodes, F.lit(1), at.nid), lambda x: x.last >= at.nid))
            else:
                among = F.array(at)
            found = F.filter(among, lambda x: s.wanted().of_node(x, all_nodes))
            if k + 1 == len(steps):
                return F.transform(found, lambda x: F.get(rows(k + 1, x, {**bound, s.label: x}), F.lit(0)))
            return F.flatten(F.transform(found, lambda x: rows(k + 1, x, {**bound, s.label: x})))

        return rows(0, F.get(all_nodes, F.lit(0)), {})

    def _typed(self, root: Place, steps: tuple[Step, ...], out: Outputs) -> Column:
        seen: dict[str, dict[str, T.DataType]] = {o: {} for o in out}

        def value(p: Place, path: tuple[str, ...]) -> Place | None:
            for k in path:
                if not isinstance(p.kind, T.StructType) or k not in p.kind.names:
                    return None
                p = Place(p.col.getField(k), p.kind[k].dataType)
            return p

        def built(final: Callable[[dict[str, Place]], Column], empty: Column) -> Column:
            def rows(k: int, at: Place, bound: dict[str, Place]) -> Column | None:
                """None where the schema rules every match out."""
                if k == len(steps):
                    return F.array(final(bound))
                s = steps[k]

                def onward(q: Place) -> Column | None:
                    ok = s.wanted().of_place(q)
                    more = None if ok is False else rows(k + 1, q, {**bound, s.label: q})
                    return None if more is None else more if ok is True else F.when(_column(ok), more).otherwise(empty)

                if s.direction == "down":
                    parts = [at.each(p, lambda q: F.coalesce(onward(q), empty), empty) for p in at.below() if onward(at.at(p)) is not None]
                else:
                    parts = [x for x in map(onward, at.above if s.direction == "up" else [at]) if x is not None]
                return F.concat(*parts) if parts else None

            got = rows(0, root, {})
            return empty if got is None else got

        def survey(bound: dict[str, Place]) -> Column:
            for o, (label, p) in out.items():
                found = value(bound[label], p)
                if found is not None:
                    seen[o][found.kind.simpleString()] = found.kind
            return F.lit(0)

        built(survey, F.array().cast("array<int>"))
        kinds = {o: self.types.get(o) or (next(iter(k)) if len(k) == 1 else "string") for o, k in seen.items()}
        schema = "array<struct<" + ",".join(f"`{o}`:{k}" for o, k in kinds.items()) + ">>"

        def final(bound: dict[str, Place]) -> Column:
            cols = []
            for o, (label, p) in out.items():
                found = value(bound[label], p)
                nested = found is not None and isinstance(found.kind, (T.StructType, T.ArrayType, T.MapType))
                c = F.lit(None) if found is None else F.to_json(found.col) if nested and kinds[o] == "string" else found.col
                cols.append((c.try_cast(kinds[o]) if not (nested and kinds[o] != "string") else c).alias(o))
            return F.struct(*cols)

        return built(final, F.array().cast(schema))
