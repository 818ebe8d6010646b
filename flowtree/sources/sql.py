"""Tables of the session's catalog, JDBC tables, and SQL with bound parameters."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, table: str, url: str | None = None, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **properties: str) -> DataFrame:
    """All rows of a table: of the catalog, or with a JDBC ``url`` of a database, read in parallel if a numeric partition column and its bounds are given."""
    if url is None:
        return spark.table(table)
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def column_types(df: DataFrame) -> DataFrame:
    """(column_name, column_type) of a table, in its order."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column_name string, column_type string")


def sql_execute(spark: SparkSession, sql: str, query_dict: dict[str, Any] | None = None, returned_columns: list[str] | None = None, dummy_run: bool = False, output_key: str = "result_rows") -> DataFrame:
    """One row with all result rows of a query as an array of structs, or with ``returned_columns`` as maps of text; for small
    results, as it holds them in one row (``sql_rows`` has no such bound). {name} and :name are bound parameters, never text."""
    rows = sql_rows(spark, sql, query_dict)
    if dummy_run:
        rows = rows.limit(0)
    if returned_columns:
        item = F.create_map(*(x for n, c in zip(returned_columns, rows.columns) for x in (F.lit(n), F.col(f"`{c}`").cast("string"))))
    else:
        item = F.struct("*")
    return rows.agg(F.collect_list(item).alias(output_key))


def sql_rows(spark: SparkSession, sql: str, query_dict: dict[str, Any] | None = None) -> DataFrame:
    text = re.sub(r"'?\{(\w+)\}'?", r":\1", sql)
    used = {k: v for k, v in (query_dict or {}).items() if re.search(rf":{k}\b", text)}
    return spark.sql(text, args=used) if used else spark.sql(text)


def sql_to_csv(spark: SparkSession, sql: str, query_dict: dict[str, Any] | None = None, returned_columns: list[str] | None = None) -> DataFrame:
    """The result rows of a query, all columns as text."""
    rows = sql_rows(spark, sql, query_dict)
    return rows.select(*(F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(rows.columns, returned_columns or rows.columns)))
