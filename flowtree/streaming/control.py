"""Stopping a stream on what it produces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def stop_when(df: DataFrame, test: Column, sink: Callable[[DataFrame, int], None], checkpoint: str, max_time: float | None = None, **trigger: str) -> StreamingQuery:
    """Writes each micro-batch by ``sink`` and stops after the first one that has a row for which ``test`` holds, or after ``max_time`` seconds."""
    found: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        if found:
            return
        batch = batch.persist()
        try:
            sink(batch, number)
            if batch.where(test).limit(1).count():
                found.append(number)
        finally:
            batch.unpersist()

    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    query = (writer.trigger(**trigger) if trigger else writer).start()
    waited = 0.0
    while query.isActive and not found and (max_time is None or waited < max_time):
        query.awaitTermination(0.2)
        waited += 0.2
    if query.isActive:
        query.stop()
    return query
