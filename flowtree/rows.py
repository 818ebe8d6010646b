"""What happens to a row around every operator: input selection, merging of outputs, tolerance of errors, metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

ERROR = "_error"


class TooManyErrors(RuntimeError):
    """More rows failed than a node tolerates."""


def merged(df: DataFrame, outputs: dict[str, Column], retain_input: bool = True, prefer_existing_value: bool = False) -> DataFrame:
    """Output columns beside the input's. Of one name the output holds, or the input's value where it isn't null."""
    if not retain_input:
        return df.select(*(c.alias(k) for k, c in outputs.items()))
    named = {k: F.coalesce(df[f"`{k}`"], c) if prefer_existing_value and k in df.columns else c for k, c in outputs.items()}
    return df.withColumns(named) if named else df


def fan_in(inputs: list[DataFrame]) -> DataFrame:
    """All rows of all inputs; columns that an input lacks are null."""
    if not inputs:
        raise ValueError("a node that isn't a source has no input")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.select("*") for df in inputs))


def tolerate(df: DataFrame, failed: Column, max_errors: int | None, name: str) -> tuple[DataFrame, Observation | None]:
    """Drops failed rows. With a bound, they are counted as the rows are consumed; ``check_errors`` compares after it."""
    if max_errors is None:
        return df.where(~F.coalesce(failed, F.lit(False))), None
    seen = Observation(f"errors of {name}")
    flagged = df.withColumn(ERROR, F.coalesce(failed, F.lit(False))).observe(seen, F.count_if(F.col(ERROR)).alias("errors"))
    return flagged.where(~F.col(ERROR)).drop(ERROR), seen


def check_errors(seen: Observation | None, max_errors: int, name: str) -> int:
    """After an action: the number of failed rows; raises if it is over the bound."""
    n = int(seen.get["errors"]) if seen is not None else 0
    if n > max_errors:
        raise TooManyErrors(f"{name}: {n} rows failed, {max_errors} are tolerated")
    return n


def check_count(df: DataFrame, failed: Column, max_errors: int, name: str) -> int:
    """The number of failed rows, by a pass of its own; raises if it is over the bound."""
    n = df.where(failed).count()
    if n > max_errors:
        raise TooManyErrors(f"{name}: {n} rows failed, {max_errors} are tolerated")
    return n


def content_hash(df: DataFrame) -> Column:
    return F.md5(F.to_json(F.struct(*(df[f"`{c}`"] for c in sorted(df.columns)))))


def with_metadata(df: DataFrame, column: str = "_meta") -> DataFrame:
    """A struct of a unique id, the hash of the content, and the time of the query."""
    return df.withColumn(column, F.struct(F.uuid().alias("uuid"), content_hash(df).alias("hash"), F.current_timestamp().alias("created")))
