"""Rows out of nothing: constants, sequences, counters and the environment."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import coerce


def constant_emitter(spark: SparkSession, thing: Any, max_loops: int = 5, output_key: str = "value") -> DataFrame:
    """A constant so many times; a dict's keys become columns."""
    base = spark.range(max_loops)
    if isinstance(thing, dict):
        return base.select(*(F.lit(v).alias(k) for k, v in thing.items()))
    return base.select(F.lit(thing).alias(output_key))


def _items(sequence: list) -> list:
    """Elements; {'value': x, 'type': name} is x as the type."""
    return [coerce(x["value"], x.get("type")) if isinstance(x, dict) and "value" in x and set(x) <= {"value", "type"} else x for x in sequence]


def sequence_emitter(spark: SparkSession, sequence: list, max_sequences: int = 1, output_key: str = "value") -> DataFrame:
    """Each element, the whole sequence over ``max_sequences`` times."""
    array = F.array(*(F.lit(x) for x in _items(sequence))) if sequence else F.array().cast("array<string>")
    return spark.range(max_sequences).select(F.explode(array).alias(output_key))


def sequence_cross(df: DataFrame, sequence: list, max_sequences: int = 1, output_key: str = "value") -> DataFrame:
    """The whole sequence for each row: an array literal exploded in place, without a join."""
    array = F.array(*(F.lit(x) for x in _items(sequence))) if sequence else F.array().cast("array<string>")
    repeated = F.flatten(F.array_repeat(array, max_sequences))
    return df.withColumn(output_key, F.explode(repeated))


def counter(spark: SparkSession, start: int = 1, end: int = 10, output_key: str = "value") -> DataFrame:
    """The integers from start to end, both included."""
    return spark.range(start, end + 1).select(F.col("id").alias(output_key))


def environment_variables(spark: SparkSession, names: list[str] | None = None, mappings: dict[str, str] | None = None, df: DataFrame | None = None) -> DataFrame:
    """The driver's environment variables when the plan is made, null if unset, under the names of ``mappings``: one row, or beside the rows of ``df``."""
    renamed = dict(mappings or {})
    wanted = {n: renamed.get(n, n) for n in [*(names or []), *renamed]}
    base = df if df is not None else spark.range(1).select()
    return base.select("*", *(F.lit(os.environ.get(n)).cast("string").alias(k) for n, k in wanted.items()))
