"""Sinks: each runs an action and returns what its successors read."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import paths, rows


def printer(df: DataFrame, disable: bool = False, prepend: str = "printer: ", n: int = 20, pretty: bool = False) -> DataFrame:
    """Prints the first rows and passes all on."""
    if not disable:
        print(prepend)
        df.show(n, truncate=False, vertical=pretty)
    return df


def black_hole(df: DataFrame) -> None:
    """Consumes every row."""
    df.write.format("noop").mode("overwrite").save()


def blocker(df: DataFrame, output_key: str = "finished") -> DataFrame:
    """One row (True), once every row of the input has been consumed."""
    black_hole(df)
    return df.sparkSession.range(1).select(F.lit(True).alias(output_key))


class Collected:
    """A sink for tests: the rows, their number, and the last one."""

    def __init__(self, df: DataFrame) -> None:
        self.message_list = [r.asDict(recursive=True) for r in df.collect()]
        self.message_counter = len(self.message_list)
        self.message_holder = self.message_list[-1] if self.message_list else None


def columns_of(df: DataFrame, include_columns: list[str] | None = None, columns: list[str] | None = None) -> list[str]:
    """Those to include, else those named, else all by name."""
    return [c for c in (include_columns or columns or sorted(df.columns)) if c in df.columns]


def load_table(df: DataFrame, table: str, existing_table_rows: str = "append", include_columns: list[str] | None = None, columns: list[str] | None = None, remap: dict | None = None, via_staging_table: bool = False, staging_table: str | None = None, dummy_run: bool = False, max_errors: int = 0, required: list[str] | None = None) -> DataFrame:
    """Loads rows into a table of the catalog and passes them on.

    ``existing_table_rows``: append, truncate, drop or fail. Rows with a null in a ``required`` column are errors:
    more than ``max_errors`` of them stop the load before anything is written. By way of a staging table, what is
    loaded appears all at once, and the staging table goes even if the load fails.
    """
    spark = df.sparkSession
    out = rows.merged(df, paths.remap(df, remap), retain_input=False) if remap else df
    out = out.select(*(f"`{c}`" for c in columns_of(out, include_columns, columns)))
    if required:
        bad = F.lit(False)
        for c in required:
            bad = bad | F.col(f"`{c}`").isNull()
        rows.check_count(out, bad, max_errors, table)
        out = out.where(~bad)
    if dummy_run:
        return df
    exists = spark.catalog.tableExists(table)
    if exists and existing_table_rows == "fail":
        raise ValueError(f"{table} exists")
    if exists and existing_table_rows == "drop":
        spark.sql(f"DROP TABLE {table}")
        exists = False
    if via_staging_table:
        stage = staging_table or f"{table}_staging_{uuid.uuid4().hex[:8]}"
        spark.sql(f"DROP TABLE IF EXISTS {stage}")
        try:
            out.write.saveAsTable(stage)
            staged = spark.table(stage)
            _into(staged, table, exists, existing_table_rows)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {stage}")
    else:
        _into(out, table, exists, existing_table_rows)
    return df


def _into(df: DataFrame, table: str, exists: bool, existing: str) -> None:
    if not exists:
        df.write.saveAsTable(table)
        return
    held = df.sparkSession.table(table)
    aligned = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema.fields))
    aligned.write.insertInto(table, overwrite=existing == "truncate")


def ensure_table(spark: SparkSession, table: str, columns: dict[str, str]) -> str:
    """Makes a table of nullable columns unless it exists; returns the statement."""
    statement = f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(f'`{n}` {t}' for n, t in columns.items())}) USING parquet"
    spark.sql(statement)
    return statement


def write_text(df: DataFrame, path: str, key: paths.Path = "value") -> DataFrame:
    """One value a line in files under ``path``; passes the rows on."""
    df.select(paths.get(df, key).cast("string").alias("value")).write.mode("append").text(path)
    return df


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertex and edge tables as Parquet, each replaced as a whole, so a repeated run leaves the same graph."""
    vertices.write.mode("overwrite").parquet(os.path.join(path, "vertices"))
    edges.write.mode("overwrite").parquet(os.path.join(path, "edges"))


def snapshot(df: DataFrame, folder: str, node: str, part: str = "output") -> DataFrame:
    """A node's rows recorded under ``folder/node/part`` with their content hash; returns the recorded rows."""
    path = os.path.join(folder, node, part)
    df.withColumn("__hash", rows.content_hash(df)).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).drop("__hash")


def replay(spark: SparkSession, folder: str, node: str, part: str = "output") -> DataFrame:
    return spark.read.parquet(os.path.join(folder, node, part)).drop("__hash")
