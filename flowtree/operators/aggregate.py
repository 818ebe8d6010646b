"""Aggregates and batches."""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import paths


def aggregate_values(df: DataFrame, tail_path: paths.Path, output_key: str = "values", values: bool = False) -> DataFrame:
    """By row: the values of all places whose keys end with ``tail_path``, in order of the schema and through arrays.

    With ``values``, the values of the first such place instead, which must be a map or struct. None gives an empty array.
    """
    if values:
        found = paths.tail_matches(df.schema, tail_path)
        if not found:
            return df.withColumn(output_key, F.array().cast("array<string>"))
        keys = paths.without_indexes(found[0])
        col, kind = paths.get(df, keys), paths.type_at(df, keys)
        got = F.map_values(col) if isinstance(kind, T.MapType) else F.array(*(col.getField(n) for n in kind.names))
        return df.withColumn(output_key, F.coalesce(got, F.array().cast("array<string>")))
    parts = paths.values_by_tail(df, tail_path)
    return df.withColumn(output_key, F.concat(*parts) if parts else F.array().cast("array<string>"))


def batch_messages(df: DataFrame, batch_size: int, order: list[str], output_key: str = "batch", ranges: int | None = None) -> DataFrame:
    """(batch, output_key): arrays of ``batch_size`` rows each in the given order, the last one shorter.

    Rows are numbered without a single-partition sort: a range partitioning by the order, a count of each partition,
    and a row number within it. ``order`` must tell rows apart for the batches to be the same on every run.
    """
    if batch_size < 1:
        raise ValueError("a batch holds at least one row")
    spread = numbered(df, order, ranges)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    packed = spread.groupBy(F.floor((F.col("__row") - 1) / batch_size).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("__row", row.alias("row")))).alias("rows"))
    return packed.select("batch", F.transform("rows", lambda x: x.getField("row")).alias(output_key))


def numbered(df: DataFrame, order: list[str], ranges: int | None = None, name: str = "__row") -> DataFrame:
    """Rows numbered from 1 in the given order, by range partitions and prefix sums of their counts.

    The bounds of the ranges are quantiles of the first column of the order, so a range can't be one task's whole input.
    """
    first = order[0]
    kind = df.schema[first].dataType
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if isinstance(kind, T.NumericType):
        at = F.col(f"`{first}`").cast("double")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        at = F.col(f"`{first}`").cast("timestamp").cast("double")
    else:
        at = _text_position(df, first)
    bounds = df.select(F.percentile_approx(at, [k / ranges for k in range(1, ranges)], 10_000).alias("b")).first().b if ranges > 1 else None
    part = _bucket(at, sorted(set(bounds or [])))
    ranged = df.withColumn("__range", part)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).select(F.col("__range").alias("__start"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(*order)
    placed = ranged.withColumn("__in", F.row_number().over(inside)).join(F.broadcast(starts), F.col("__range") == F.col("__start"))
    return placed.withColumn(name, F.col("__in") + F.col("__before")).drop("__in", "__before", "__range", "__start")


def _text_position(df: DataFrame, column: str) -> Column:
    """A number in the order of a text: the six bytes after the prefix that all of the column's texts share."""
    text = F.col(f"`{column}`").cast("string")
    low, high = df.agg(F.min(text), F.max(text)).first()
    shared = len(os.path.commonprefix([low.encode(), high.encode()])) if low is not None else 0
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), shared + 1, 6)), 12, "0"), 16, 10).cast("double")


def _bucket(at: Column, bounds: list[float], most: int = 256) -> Column:
    """Number of the bounds that a value is above, by bisection; -1 for null, which sorts first.

    More than ``most`` bounds are cut into blocks, as many as a block has bounds: the block is found by bisection, the place in
    it in a constant array, so that the expression stays small enough to be compiled.
    """

    def part(ends: list[float], low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(at > F.lit(float(ends[mid])), part(ends, mid + 1, high)).otherwise(part(ends, low, mid))

    if len(bounds) <= most:
        found = part(bounds, 0, len(bounds))
    else:
        step = math.isqrt(len(bounds)) + 1
        blocks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
        block = part([b[-1] for b in blocks[:-1]], 0, len(blocks) - 1)
        held = F.array(*(F.array(*(F.lit(float(x)) for x in b)) for b in blocks))
        found = block * step + F.size(F.filter(F.get(held, block), lambda x: at > x))
    return F.when(at.isNull(), F.lit(-1)).otherwise(found)


def row_stats(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, n_distinct, is_unique, has_null), a row a column, in one pass over the data; a null counts as a value.

    Exact counts are taken by grouping (column, value) pairs, which combines before the shuffle; approximate ones by HyperLogLog.
    """
    names = columns or df.columns
    as_text = [df[f"`{c}`"].cast("string") if not isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(df[f"`{c}`"]) for c in names]
    long = df.select(F.posexplode(F.array(*as_text)).alias("i", "value"))
    if approximate:
        got = long.groupBy("i").agg((F.approx_count_distinct("value") + F.max(F.col("value").isNull().cast("long"))).alias("n_distinct"), F.count(F.lit(1)).alias("n"), F.max(F.col("value").isNull()).alias("has_null"))
    else:
        each = long.groupBy("i", "value").agg(F.count(F.lit(1)).alias("c"))
        got = each.groupBy("i").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("c").alias("n"), F.max(F.col("value").isNull()).alias("has_null"))
    label = F.element_at(F.array(*(F.lit(c) for c in names)), F.col("i") + 1)
    return got.select(label.alias("column"), "n_distinct", (F.col("n_distinct") == F.col("n")).alias("is_unique"), "has_null")


def find_value(df: DataFrame, column: str, choice: str = "max") -> DataFrame:
    """One row (value) with the greatest or least value of a column, null if it has none."""
    if choice not in ("max", "min"):
        raise ValueError(f"choice is max or min, not {choice!r}")
    return df.agg({"max": F.max, "min": F.min}[choice](f"`{column}`").alias("value"))
