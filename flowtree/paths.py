"""Keypaths: reading, writing and finding values in nested columns, resolved against the schema at plan time.

A keypath is a dotted string or a list of keys; integers step into arrays, negative ones from the end. A missing key or a null on
the way gives null; an empty path is the whole row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Path = str | list | tuple | None


class PathNotFound(KeyError):
    """A value was to be set below something that isn't there."""


def steps(path: Path) -> list[str | int]:
    if path is None or path == "":
        return []
    return path.split(".") if isinstance(path, str) else list(path)


def variant_path(keys: list[str | int]) -> str:
    """JSON path with every key quoted, so that any key can be named."""
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else "['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in keys)


def _down(col: Column, kind: T.DataType, keys: list[str | int]) -> tuple[Column, T.DataType] | None:
    """The column and type at ``keys`` below ``col``; None where the schema has no such place."""
    for n, key in enumerate(keys):
        if isinstance(kind, T.VariantType):
            return F.try_variant_get(col, variant_path(keys[n:]), "variant"), T.VariantType()
        if isinstance(kind, T.StructType) and key in kind.names:
            col, kind = col.getField(key), kind[key].dataType
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            col, kind = F.try_element_at(col, F.lit(str(key))), kind.valueType
        elif isinstance(kind, T.ArrayType) and isinstance(key, int):
            col, kind = (F.get(col, F.lit(key)) if key >= 0 else F.try_element_at(col, F.lit(key))), kind.elementType
        else:
            return None
    return col, kind


def get(df: DataFrame, path: Path, default: object = None) -> Column:
    """The value at a keypath; ``default`` where it is missing or null."""
    keys = steps(path)
    if not keys:
        return F.struct(*(df[f"`{c}`"] for c in df.columns))
    found = None
    if keys[0] in df.columns:
        found = _down(df[f"`{keys[0]}`"], df.schema[keys[0]].dataType, keys[1:])
    elif ".".join(map(str, keys)) in df.columns:
        found = df[f"`{'.'.join(map(str, keys))}`"], None
    col = found[0] if found else F.lit(None)
    return col if default is None else F.coalesce(col, F.lit(default))


def type_at(df: DataFrame, path: Path) -> T.DataType | None:
    keys = steps(path)
    if not keys:
        return df.schema
    if keys[0] not in df.columns:
        return None
    found = _down(F.lit(None), df.schema[keys[0]].dataType, keys[1:])
    return found[1] if found else None


def put(df: DataFrame, path: Path, value: Column) -> DataFrame:
    """Sets the value at a keypath; raises PathNotFound if the parents aren't there."""
    keys = steps(path)
    if len(keys) == 1:
        return df.withColumn(keys[0], value)
    if keys[0] not in df.columns:
        raise PathNotFound(".".join(map(str, keys)))
    return df.withColumn(keys[0], _put(df[f"`{keys[0]}`"], df.schema[keys[0]].dataType, keys[1:], value))


def _put(col: Column, kind: T.DataType, keys: list, value: Column) -> Column:
    key, rest = keys[0], keys[1:]
    if isinstance(kind, T.StructType) and (key in kind.names or not rest):
        return col.withField(f"`{key}`", _put(col.getField(key), kind[key].dataType, rest, value) if rest else value)
    if isinstance(kind, T.MapType) and not rest:
        return F.map_concat(F.map_filter(col, lambda k, _: k != F.lit(key)), F.create_map(F.lit(key), value))
    if isinstance(kind, T.ArrayType) and isinstance(key, int):
        return F.transform(col, lambda x, i: F.when(i == key, _put(x, kind.elementType, rest, value) if rest else value).otherwise(x))
    raise PathNotFound(str(key))


def leaves(kind: T.DataType, at: tuple = ()) -> Iterator[tuple[tuple, T.DataType]]:
    """(path, type) of the places below structs that hold no struct; arrays are leaves."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from leaves(f.dataType, (*at, f.name))
    else:
        yield at, kind


def all_paths(kind: T.DataType, at: tuple = ()) -> Iterator[tuple]:
    """Every path of a type in pre-order, the empty one first; ``...`` steps into an array's elements."""
    yield at
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from all_paths(f.dataType, (*at, f.name))
    elif isinstance(kind, T.ArrayType):
        yield from (p for p in all_paths(kind.elementType, (*at, ...)) if p != (*at, ...) or not isinstance(kind.elementType, T.StructType))


def without_indexes(path: tuple | list) -> list[str]:
    return [k for k in path if isinstance(k, str)]


def tail_matches(kind: T.DataType, tail: Path, below: Path = None) -> list[tuple]:
    """The paths whose keys, without array steps, end with ``tail`` and begin with ``below``."""
    end, start = steps(tail), steps(below)
    found = []
    for p in all_paths(kind):
        keys = without_indexes(p)
        if p and p[-1] is not ... and len(keys) >= len(end) and keys[len(keys) - len(end) :] == end and keys[: len(start)] == start:
            found.append(p)
    return found


def replaced(col: Column, kind: T.DataType, path: tuple, f: Callable[[Column], Column]) -> Column:
    """``col`` with f applied at a path, through every element of arrays on the way."""
    if not path:
        return f(col)
    if path[0] is ...:
        return F.transform(col, lambda x: replaced(x, kind.elementType, path[1:], f))
    inner = kind[path[0]].dataType
    return F.when(col.isNotNull(), col.withField(f"`{path[0]}`", replaced(col.getField(path[0]), inner, path[1:], f)))


def replace_by_tail(df: DataFrame, tail: Path, f: Callable[[Column], Column], below: Path = None) -> DataFrame:
    """Every place that ends with ``tail`` replaced by f of it; nested matches from the outside in."""
    for p in tail_matches(df.schema, tail, below):
        col, kind = df[f"`{p[0]}`"], df.schema[p[0]].dataType
        df = df.withColumn(p[0], replaced(col, kind, p[1:], f))
    return df


def collected(col: Column, kind: T.DataType, path: tuple) -> Column:
    """The values at a path as an array, through every element of arrays on the way, in order."""
    if not path:
        return F.array(col)
    if path[0] is ...:
        return F.when(col.isNull(), F.array()).otherwise(F.flatten(F.transform(col, lambda x: collected(x, kind.elementType, path[1:]))))
    return collected(col.getField(path[0]), kind[path[0]].dataType, path[1:])


def values_by_tail(df: DataFrame, tail: Path) -> list[Column]:
    """One array column for each place in the schema that ends with ``tail``, in order of the schema."""
    return [collected(df[f"`{p[0]}`"], df.schema[p[0]].dataType, p[1:]) for p in tail_matches(df.schema, tail)]


def remap(df: DataFrame, mapping: dict) -> dict[str, Column]:
    """Output columns for a mapping whose leaves are keypaths of the input and whose shape is that of the output."""

    def built(x: object) -> Column:
        return F.struct(*(built(v).alias(k) for k, v in x.items())) if isinstance(x, dict) else get(df, x)

    return {k: built(v) for k, v in mapping.items()}
