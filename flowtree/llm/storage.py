"""Tables written between the steps of an operator, in the folder that all executors share.

The folder is the one named in spark.checkpoint.dir. Where that is unset, a session on one machine (a local master, as in
tests) gets a temporary one, and any other is refused: its executors would each write to a disk of their own. Written
tables cut the lineage: they outlive any executor. They are removed by ``discard`` and ``release``, or when the process ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

_written: list[tuple[SparkSession, str]] = []


def remove_at_end(spark: SparkSession, folder: str) -> None:
    """Has ``release`` remove a folder too."""
    _written.append((spark, folder))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/flowtree-{uuid.uuid4().hex}"
    remove_at_end(spark, folder)
    df.write.parquet(f"{folder}/{name}")
    made = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    made.flowtree_folder = folder
    return made


def remove(spark: SparkSession, path: str) -> None:
    """Removes a written table, in whatever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Removes a table that ``written`` returned; nothing that still reads it may be run any more."""
    remove(df.sparkSession, df.flowtree_folder)
    _written[:] = [w for w in _written if w[1] != df.flowtree_folder]


def release() -> None:
    """Removes every table written so far; results that still read one must have been consumed."""
    while _written:
        try:
            remove(*_written.pop())
        except Exception:  # noqa: BLE001 - the session has ended, and with it the access to the folder
            return


atexit.register(release)
