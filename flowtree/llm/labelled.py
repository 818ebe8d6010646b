"""Labelled documents, all of them or a bounded sample, and applying a trained model to every document."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import trimmed

#: Rows of each class that a classifier is fitted on at most (about; drawn by hash of doc_id).
PER_CLASS = 2500
#: Labels that every executor gets a copy of at most; more are joined by a shuffle.
COPIED = 1 << 20


def cleaned(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) of each labelled document: no null doc_id or label, no label but 0 and 1, and of conflicting ones the 1."""
    return labels.select(F.col("doc_id").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))


def once(rows: DataFrame) -> DataFrame:
    """(doc_id, lang, text, y), of repeated documents the row of the least hash."""
    one = rows.groupBy("doc_id", "y").agg(F.min_by(F.struct("lang", "text"), F.struct(F.xxhash64("text"), F.xxhash64("lang"))).alias("r"))
    return one.select("doc_id", "r.lang", "r.text", "y")


def every(docs: DataFrame, lab: DataFrame, count: int, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """All rows of docs with a text and a label, repeated documents included: ``change`` of their (doc_id, lang, text), and y.

    ``count`` is that of lab, (doc_id, y). Beyond COPIED labels the rows are changed first, so that the join shuffles what ``change`` leaves of them.
    """
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").alias("text")).where("text is not null and doc_id is not null")
    return change(texts.join(F.broadcast(lab), "doc_id")) if count <= COPIED else change(texts).join(lab.hint("merge"), "doc_id")


def sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, lang, text, y) of about ``per_class`` labelled documents of each class.

    Drawn by a hash of doc_id at the rate that the class counts give, so neither a sort nor a window over all labels
    is needed. Rows with a null doc_id, text or label and labels other than 0 and 1 are left out. Repeated labels of one document
    count once, and of conflicting ones the 1; of repeated documents one row is used, that of the least hash. So the
    join's small side and the sample have at most about 2 x per_class rows, whatever the input.
    """
    lab = cleaned(labels, column)
    counts = {r.y: r.n for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = F.lit(False)
    for y, n in counts.items():
        drawn = drawn | ((F.col("y") == y) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) <= F.lit(int((1 << 62) * min(1.0, per_class / n)))))
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").alias("text")).where("text is not null")
    return once(texts.join(F.broadcast(lab.where(drawn)), "doc_id"))


def fitted(sampled: DataFrame, fit: Callable[[pa.Table], object]) -> dict | None:
    """The attributes of the model that ``fit`` makes of the sample, in order of doc_id; one task fits, so the driver holds
    no texts. None if ``fit`` makes none."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(got) if got else pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "text": pa.array([], pa.string()), "y": pa.array([], pa.int32())})
        model = fit(table.sort_by([("doc_id", "ascending"), ("y", "ascending"), ("text", "ascending")]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(None if model is None else vars(model))], pa.binary())], ["model"])

    got = sampled.repartition(1).mapInArrow(trimmed(run), "model binary").first()  # none if Catalyst sees that the sample is empty
    return None if got is None else pickle.loads(got.model)  # noqa: S301 - made by our own task


def kept(docs: DataFrame, columns: list[str], decide: Callable[[pa.RecordBatch], "object"]) -> DataFrame:
    """The rows of ``docs`` for which ``decide`` (a batch to a boolean array) holds, all columns unchanged; no shuffle."""

    def run(batches):
        for batch in batches:
            mask = decide(batch.select(columns))
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def scored(docs: DataFrame, columns: list[str], schema: str, score: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """One row per document, from the named columns alone; no shuffle."""

    def run(batches):
        for batch in batches:
            yield score(batch)

    return docs.select(*columns).mapInArrow(trimmed(run), schema)
