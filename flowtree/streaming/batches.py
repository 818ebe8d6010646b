"""Batches of a number of rows on a stream, the last one after a timeout, in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def batch_stream(df: DataFrame, batch_size: int, timeout: float = 5, lanes: int = 16, by: str | None = None, output_key: str = "batch") -> DataFrame:
    """(lane, output_key): arrays of ``batch_size`` rows as JSON, and what is left of a lane after ``timeout`` seconds without a row.

    Rows go to lanes by the hash of ``by``, or of the whole row, so that batches form in parallel; one lane is one order.
    The rest that a lane holds is in the state and survives a restart.
    """
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    spread = F.pmod(F.xxhash64(F.col(f"`{by}`") if by else row), F.lit(lanes))

    def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[Any] = list(state.get[0]) if state.exists else []
        made = lambda batches: pd.DataFrame({"lane": [key[0]] * len(batches), output_key: batches})
        if state.hasTimedOut:
            state.remove()
            yield made([held])
            return
        for frame in frames:  # full batches leave at once, so that no more than one frame and a rest are held
            held += frame["row"].tolist()
            full = len(held) - len(held) % batch_size
            if full:
                yield made([held[k : k + batch_size] for k in range(0, full, batch_size)])
                held = held[full:]
        if held:
            state.update((held,))
            state.setTimeoutDuration(int(timeout * 1000))
        elif state.exists:
            state.remove()

    keyed = df.select(spread.alias("lane"), row.alias("row"))
    return keyed.groupBy("lane").applyInPandasWithState(gather, f"lane long, {output_key} array<string>", "held array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)
