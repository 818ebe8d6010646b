"""A training corpus from documents: toxic and low-quality documents go, one of each group of near copies stays, documents
that hold benchmark items go, and what is left is scheduled by source.

Each stage reads all that its predecessor kept, from the Parquet table that it was written to; all but the last return
the columns of documents. Models are fitted on the labelled rows among the documents that a stage gets.

Defined results: every filter judges each row by its own text, whatever its doc_id; a row of a null doc_id isn't scheduled. Texts that are
null, empty or without a word aren't toxic, resemble nothing and hold no item; where there is a quality model it rejects them. Without
labels of both classes a classifier keeps all. Of rows of the same doc_id and text one stays. Ties are settled by hashes and ids,
never by the order of rows. Columns besides doc_id, source, lang and text are passed on unread, whatever their names. Empty
tables give empty tables of the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from flowtree.llm import decontaminate, mixing, neardup, quality, toxicity
from flowtree.llm.storage import remove, remove_at_end, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.schedule(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Trained models and sequential verification have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written as Parquet and read again as the next one's input.

    A stage's table goes once the next one is written, so that two of them are there at most; the last one goes when the process ends, or by ``storage.release``.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    remove_at_end(spark, folder)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
