"""Row transforms."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import paths, rows
from ..functions import load_function

_UNSET = object()


def remapper(df: DataFrame, mapping: dict, retain_input: bool = True) -> DataFrame:
    """Columns of the mapping's shape, each leaf a keypath of the input; what is missing is null."""
    return rows.merged(df, paths.remap(df, mapping), retain_input)


def insert_data(df: DataFrame, value_dict: dict[str, Any], overwrite: bool = True, overwrite_if_null: bool = True) -> DataFrame:
    """Constants set where the column is missing, or all over, or where it is null."""
    out = {}
    for name, value in value_dict.items():
        if name not in df.columns or overwrite:
            out[name] = F.lit(value)
        elif overwrite_if_null:
            out[name] = F.coalesce(df[f"`{name}`"], F.lit(value))
    return df.withColumns(out) if out else df


def simple_transforms(df: DataFrame, transform_mapping: list[dict[str, Any]]) -> DataFrame:
    """For each entry in turn: every place whose keys end with ``path`` (below ``starting_path``, if given) gets ``target_value``
    or ``target_function`` of what was there. An explicit value counts even if it is null, 0 or empty; an entry with neither changes nothing."""
    for entry in transform_mapping:
        value, function = entry.get("target_value", _UNSET), entry.get("target_function")
        if function is not None:
            named, args, kwargs = load_function(function) if isinstance(function, str) else function, entry.get("function_args") or [], entry.get("function_kwargs") or {}
            df = paths.replace_by_tail(df, entry["path"], lambda c, f=named, a=args, k=kwargs: f(c, *a, **k), entry.get("starting_path"))
        elif value is not _UNSET:
            df = paths.replace_by_tail(df, entry["path"], lambda _, v=value: F.lit(v), entry.get("starting_path"))
    return df


def substitute_regex(df: DataFrame, key: paths.Path, match_regex: str, substitute_string: str, output_key: str | None = None) -> DataFrame:
    r"""Every match replaced; \1 and \g<name> in the substitute name groups, a dollar is a dollar."""
    substitute = substitute_string.replace("$", "\\$")
    substitute = re.sub(r"\\g<(\w+)>", lambda m: f"${m[1]}" if m[1].isdigit() else f"${{{m[1]}}}", substitute)
    substitute = re.sub(r"\\(\d+)", r"$\1", substitute)
    pattern = re.sub(r"\(\?P<", "(?<", match_regex)
    value = F.regexp_replace(paths.get(df, key).cast("string"), pattern, substitute)
    return df.withColumn(output_key, value) if output_key else paths.put(df, key, value)


def function_of_message(df: DataFrame, function: str, key: paths.Path = None, output_key: str = "value", returns: T.DataType | str = "string") -> DataFrame:
    """A function, by name, of the value at a keypath."""
    return df.withColumn(output_key, load_function(function, returns)(paths.get(df, key)))


def serializer(df: DataFrame, key: paths.Path = None, values: bool = False, output_key: str | None = None) -> DataFrame:
    """A row for each element of an array, or each key (or value) of a map or struct; a null keeps its row, with a null.

    Elements that are structs become columns if no ``output_key`` is named; others are put in ``output_key`` or 'value'.
    """
    col, kind = paths.get(df, key), paths.type_at(df, key)
    items: Column
    if isinstance(kind, T.ArrayType):
        items, element = col, kind.elementType
    elif isinstance(kind, T.MapType):
        items, element = (F.map_values(col), kind.valueType) if values else (F.map_keys(col), kind.keyType)
    elif isinstance(kind, T.StructType):
        names = kind.names
        items = F.array(*(paths.get(df, [*paths.steps(key), n]).cast("string") for n in names)) if values else F.array(*(F.lit(n) for n in names))
        element = T.StringType()
    else:
        raise TypeError(f"{key} of type {kind} has no elements")
    empty = F.when(col.isNull(), F.array(F.lit(None).cast(element))).otherwise(items)
    out = df.withColumn("__item", F.explode(empty))
    if isinstance(element, T.StructType) and output_key is None:
        merged = rows.merged(out, {f.name: F.col("__item").getField(f.name) for f in element.fields})
        return merged.drop("__item")
    return out.withColumn(output_key or "value", F.col("__item")).drop("__item")
