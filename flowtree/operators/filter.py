"""Predicates and samples."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import paths
from ..functions import to_bool

TESTS = ("key_exists", "value_is_not_none", "value_is_true")


def predicate(df: DataFrame, test: str, test_keypath: paths.Path) -> Column:
    """Never null. Presence counts a null that is there: for maps and variants by row, for columns and structs by schema."""
    if test == "key_exists":
        return _exists(df, paths.steps(test_keypath))
    value, kind = paths.get(df, test_keypath), paths.type_at(df, test_keypath)
    if test == "value_is_not_none":
        there = value.isNotNull()
        return there & ~F.is_variant_null(value) if isinstance(kind, T.VariantType) else there
    if test == "value_is_true":
        return F.coalesce(to_bool(value, kind), F.lit(False)) if kind is not None else F.lit(False)
    raise ValueError(f"unknown test {test!r}; there are {', '.join(TESTS)}")


def _exists(df: DataFrame, keys: list) -> Column:
    *parents, last = keys
    if not parents:
        return F.lit(last in df.columns)
    value, kind = paths.get(df, parents), paths.type_at(df, parents)
    if isinstance(kind, T.MapType):
        return F.coalesce(F.map_contains_key(value, F.lit(last)), F.lit(False))
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(value, paths.variant_path([last]), "variant").isNotNull()
    return value.isNotNull() if isinstance(kind, T.StructType) and last in kind.names else F.lit(False)


def filter_rows(df: DataFrame, test: str, test_keypath: paths.Path, value: bool = True) -> DataFrame:
    """Rows for which the test comes out as ``value``; an unknown test raises when the plan is made."""
    found = predicate(df, test, test_keypath)
    return df.where(found if value else ~found)


def random_sample(df: DataFrame, sample: float = 0.1, seed: int | None = None) -> DataFrame:
    """Each row with that probability, independently."""
    return df.sample(withReplacement=False, fraction=sample, seed=seed)


def drop_nulls(df: DataFrame, key: paths.Path) -> DataFrame:
    return df.where(paths.get(df, key).isNotNull())


def meets_condition(df: DataFrame, condition: Column, by: list[str] | None = None) -> DataFrame:
    """Rows of a table of nodes that meet a condition, once for each content (of the columns ``by``, or all)."""
    names = by or df.columns
    return df.where(condition).withColumn("__content", F.to_json(F.struct(*(df[f"`{c}`"] for c in names)))).dropDuplicates(["__content"]).drop("__content")


def _spark_type(schema: dict) -> T.DataType | None:
    kind = schema.get("type")
    if kind == "object" and schema.get("properties"):
        fields = [(n, _spark_type(s)) for n, s in schema["properties"].items()]
        return T.StructType([T.StructField(n, t or T.VariantType()) for n, t in fields])
    return {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}.get(kind)


_KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}


def _valid(v: Column, schema: dict) -> Column:
    """Whether a variant meets a JSON schema: type, enum, const, required, properties, items, bounds, lengths and pattern."""
    kind = F.schema_of_variant(v)
    ok = F.lit(True)
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        ok = F.lit(False)
        for prefix in (p for n in names for p in _KINDS[n]):
            ok = ok | kind.startswith(prefix)
        if "integer" in names:
            ok = ok | (F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double"))) & ~kind.startswith("STRING")
    if "enum" in schema or "const" in schema:
        ok = ok & F.to_json(v).isin([json.dumps(x, separators=(",", ":")) for x in schema.get("enum", [schema.get("const")])])
    is_object, is_number, is_text = kind.startswith("OBJECT"), F.rlike(kind, F.lit("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")), kind.startswith("STRING")
    for name in schema.get("required", []):
        ok = ok & (~is_object | F.try_variant_get(v, paths.variant_path([name]), "variant").isNotNull())
    for name, sub in schema.get("properties", {}).items():
        child = F.try_variant_get(v, paths.variant_path([name]), "variant")
        ok = ok & (~is_object | child.isNull() | _valid(child, sub))
    if "items" in schema:
        ok = ok & (~kind.startswith("ARRAY") | F.forall(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: _valid(x, schema["items"])))
    number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    for word, test in (("minimum", lambda b: number >= b), ("maximum", lambda b: number <= b), ("exclusiveMinimum", lambda b: number > b), ("exclusiveMaximum", lambda b: number < b)):
        if word in schema:
            ok = ok & (~is_number | test(F.lit(schema[word])))
    for word, test in (("minLength", lambda b: F.length(text) >= b), ("maxLength", lambda b: F.length(text) <= b), ("pattern", lambda b: F.rlike(text, b))):
        if word in schema:
            ok = ok & (~is_text | test(F.lit(schema[word])))
    return F.coalesce(ok, F.lit(False))


def json_valid(df: DataFrame, key: paths.Path, schema: dict[str, Any] | str, output_key: str | None = None) -> DataFrame:
    """Rows whose text is JSON that meets the schema (a dict, or the name of a file); parsed into ``output_key`` if one is named."""
    if isinstance(schema, str):
        with open(schema, encoding="utf-8") as f:
            schema = json.load(f)
    parsed = df.withColumn("__json", F.try_parse_json(paths.get(df, key)))
    left = parsed.where(F.col("__json").isNotNull() & _valid(F.col("__json"), schema))
    return left.withColumnRenamed("__json", output_key) if output_key else left.drop("__json")
