"""Joins of streams within a time window, and sliding windows; the same plans for tables and for Structured Streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import paths


def _timestamp(df: DataFrame, column: str) -> Column:
    """Event time needs a time zone; times without one count as the session's."""
    return df[f"`{column}`"].cast("timestamp")


def stream_join(streams: dict[str, tuple[DataFrame, paths.Path]], window: float = 30, time: str = "ts", late: str | None = None) -> DataFrame:
    """Inner join of any number of inputs, on the value at each one's keypath, of rows within ``window`` seconds of the first input's.

    Each input becomes a struct column of its name, beside ``key``. An equi-join on key with the time bound as a
    condition, bucketed by the window's length so that a hot key doesn't compare all its rows; for streams both sides
    have watermarks of ``late`` (the window by default), which bound the state.
    """
    if len(streams) < 2:
        raise ValueError("a join has two inputs at least")
    sides = []
    for name, (df, path) in streams.items():
        side = df.select(paths.get(df, path).alias(f"key_{name}"), _timestamp(df, time).alias(f"time_{name}"), F.struct(*(df[f"`{c}`"] for c in df.columns)).alias(name))
        sides.append((name, side.withWatermark(f"time_{name}", late or f"{window} seconds") if df.isStreaming else side))
    (first, left), *rest = sides
    streaming = left.isStreaming or any(s.isStreaming for _, s in rest)

    def joined(acc: DataFrame, other: tuple[str, DataFrame]) -> DataFrame:
        name, side = other
        a, b = F.col(f"time_{first}"), F.col(f"time_{name}")
        near = (F.col(f"key_{first}") == F.col(f"key_{name}")) & (b >= a - F.make_dt_interval(secs=F.lit(float(window)))) & (b <= a + F.make_dt_interval(secs=F.lit(float(window))))
        if streaming:
            near = F.expr(f"key_{first} = key_{name} AND time_{name} >= time_{first} - INTERVAL {window} SECONDS AND time_{name} <= time_{first} + INTERVAL {window} SECONDS")
            return acc.join(side, near)
        length = max(float(window), 1e-6)
        cell = lambda c: F.floor(c.cast("double") / length)
        spread = acc.withColumn("__cell", F.explode(F.array(*(cell(a) + d for d in (-1, 0, 1)))))
        return spread.join(side.withColumn("__other", cell(b)), near & (F.col("__cell") == F.col("__other"))).drop("__cell", "__other")

    out = reduce(joined, rest, left)
    return out.select(F.col(f"key_{first}").alias("key"), *(F.col(n) for n in streams))


def time_window(df: DataFrame, time_window: float, send_interval: float, time: str = "ts", late: str | None = None, by: list[str] | None = None, aggregates: dict[str, Column] | None = None) -> DataFrame:
    """Every ``send_interval`` seconds the rows of the last ``time_window`` seconds: (start, end, *by, rows) or the given aggregates."""
    out = df.withColumn("__t", _timestamp(df, time))
    if df.isStreaming:
        out = out.withWatermark("__t", late or f"{time_window} seconds")
    span = F.window("__t", f"{time_window} seconds", f"{send_interval} seconds")
    named = aggregates or {"rows": F.collect_list(F.struct(*(F.col(f"`{c}`") for c in df.columns)))}
    got = out.groupBy(span.alias("w"), *(by or [])).agg(*(c.alias(n) for n, c in named.items()))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), *named)


