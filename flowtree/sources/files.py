"""Text and CSV files."""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BROKEN = "__corrupt"


def _content(path: str) -> bytes:
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:/", path):
        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_stream(at) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


def local_file_reader(spark: SparkSession, directory: str = ".", filename: str | None = None, serialize: bool = False, read_mode: str = "r", names: DataFrame | None = None, key: str = "filename", output_key: str = "value") -> DataFrame:
    """Whole files as one value each, or with ``serialize`` a row for each line.

    The file is ``directory/filename``; with ``names``, the files that its column ``key`` names, read on the executors,
    each beside its row: from a folder that all of them have, or with a URI (hdfs://, s3://, gs://, file://) from that store. A missing file raises.
    """
    if names is None:
        path = os.path.join(directory, filename) if filename else directory
        if read_mode == "rb":
            return spark.read.format("binaryFile").load(path).select(F.col("content").alias(output_key))
        return spark.read.text(path, wholetext=not serialize).select(F.col("value").alias(output_key))

    def content(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for name in batch:
                content = _content(os.path.join(directory, name))
                out.append(content if "b" in read_mode else content.decode("utf-8"))
            yield pd.Series(out)

    kind = T.BinaryType() if "b" in read_mode else T.StringType()
    got = names.withColumn(output_key, F.pandas_udf(content, kind)(F.col(f"`{key}`")))
    if serialize:
        text = F.regexp_replace(F.col(output_key), "\\n\\z", "")
        got = got.withColumn(output_key, F.explode(F.split(text, "\n", -1)))
    return got


def csv_reader(spark: SparkSession, path: str, delimiter: str = ",", schema: T.StructType | None = None) -> DataFrame:
    """A row for each record, all columns text, names from the header. An empty field is '', a field that a short record
    lacks is null, and fields beyond the header are dropped. With a schema of the columns the header isn't read twice."""
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "sep": delimiter, "mode": "PERMISSIVE"}
    names = schema.names if schema else spark.read.options(**options).csv(path).columns
    wide = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BROKEN]])
    df = spark.read.schema(wide).options(**options, columnNameOfCorruptRecord=_BROKEN, enforceSchema=True).csv(path)
    # a surplus record is complete and a short one isn't: its last field is missing
    full = F.col(_BROKEN).isNull() | F.col(f"`{names[-1]}`").isNotNull()
    return df.select(*(F.when(full, F.coalesce(F.col(f"`{n}`"), F.lit(""))).otherwise(F.col(f"`{n}`")).alias(n) for n in names))


def csv_to_dictionary_list(df: DataFrame, key: str, output_key: str = "records") -> DataFrame:
    """CSV text with a header in a column, as an array of maps beside it: column name to text; null where a record is short."""

    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda text: None if text is None else [{k: v for k, v in r.items() if k is not None} for r in csv.DictReader(io.StringIO(text, newline=""))])

    kind = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
    return df.withColumn(output_key, F.pandas_udf(parse, kind)(F.col(f"`{key}`")))


def parse_csv(df: DataFrame, key: str, columns: list[str], retain_input: bool = True) -> DataFrame:
    """CSV text with a header in a column as a row for each record, with the named columns."""
    rows = csv_to_dictionary_list(df, key, "__records").withColumn("__record", F.explode("__records"))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns] if retain_input else []
    return rows.select(*kept, *(F.try_element_at("__record", F.lit(c)).alias(c) for c in columns))


def load_typed_csv(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = ",") -> DataFrame:
    """CSV with a header as typed columns: a field that is empty or can't be read as its type is null, the rest of its record stays."""
    text = csv_reader(spark, path, delimiter)
    return text.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) for f in schema.fields if f.name in text.columns))
