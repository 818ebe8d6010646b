"""Scalar functions. Each takes columns and returns a column, all within generated code; none is a Python function per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REDSHIFT = "MMM dd,yyyy  HH:mm:ss"
_CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "z": "xx", "Z": "VV", "%": "%",
}


def pattern(fmt: str) -> str:
    """A strftime format as a Spark datetime pattern; other letters are quoted."""
    out = ""
    for part in re.findall(r"%.|[A-Za-z]+|'|[^%A-Za-z']+", fmt):
        if part[0] == "%":
            if part[1] not in _CODES:
                raise ValueError(f"no equivalent of {part}")
            out += _CODES[part[1]]
        else:
            out += "''" if part == "'" else f"'{part}'" if part[0].isalpha() else part
    return out


def to_bool(c: Column, kind: T.DataType | None = None) -> Column:
    """Text: whether it begins with t or y, in either case. Numbers and booleans: whether they are above zero."""
    if isinstance(kind, T.BooleanType):
        return c
    if isinstance(kind, T.NumericType):
        return c > 0
    if isinstance(kind, T.VariantType):
        return F.coalesce(F.try_variant_get(c, "$", "double") > 0, _text_bool(F.try_variant_get(c, "$", "string")))
    return _text_bool(c)


def _text_bool(c: Column) -> Column:
    return F.lower(F.substring(c.cast("string"), 1, 1)).isin("t", "y")


def convert_date_format(c: Column, source_format: str, target_format: str) -> Column:
    return F.date_format(F.try_to_timestamp(c, F.lit(pattern(source_format))), pattern(target_format))


def milliseconds_epoch_to_datetime(c: Column, kind: T.DataType | None = None) -> Column:
    """UTC time of an epoch in milliseconds; times pass; what isn't a number is null (``or_same`` keeps it as text)."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    return F.timestamp_millis(c.try_cast("bigint")).cast("timestamp_ntz")


def seconds_epoch_to_datetime(c: Column) -> Column:
    return F.timestamp_seconds(c.try_cast("bigint")).cast("timestamp_ntz")


def datetime_to_milliseconds(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def string_to_datetime(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def string_to_redshift(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit(_REDSHIFT)).cast("timestamp_ntz")


def timestamp_to_redshift(c: Column) -> Column:
    """Epoch in milliseconds to the loader's text form."""
    return datetime_to_redshift(milliseconds_epoch_to_datetime(c))


def datetime_to_redshift(c: Column, kind: T.DataType | None = None) -> Column:
    return c if isinstance(kind, T.StringType) else F.date_format(c, _REDSHIFT)


def now_milliseconds() -> Column:
    return F.unix_millis(F.current_timestamp()).cast("string")


def now_datetime() -> Column:
    return F.current_timestamp().cast("timestamp_ntz")


def now_redshift() -> Column:
    return F.date_format(F.current_timestamp(), _REDSHIFT)


def two_weeks_ago_datetime() -> Column:
    return (F.current_timestamp() - F.expr("INTERVAL 14 DAYS")).cast("timestamp_ntz")


def two_weeks_ago() -> Column:
    """A constant, whatever its name says: 2019-01-01 in milliseconds."""
    return F.lit(1546300800000)


def january_1_2016() -> Column:
    return F.lit("2016-01-01 00:00:00").cast("timestamp_ntz")


def engaging_networks_date(c: Column) -> Column:
    """date_modified of the first element, as yyyyMMdd."""
    return F.date_format(F.try_to_timestamp(F.get(c, F.lit(0)).getField("date_modified"), F.lit("yyyy-MM-dd")), "yyyyMMdd")


def list_to_dict(values: Column, keys: Column) -> Column:
    """Keys to values; raises where their numbers differ."""
    even = F.when(F.size(values) == F.size(keys), F.lit(True)).otherwise(F.raise_error(F.lit("values and keys differ in number")).cast("boolean"))
    return F.when(even, F.map_from_arrays(keys, values))


def template(text: str, fields: dict[str, Column]) -> Column:
    """{x} replaced by the field of that name, in one pass; unknown names stay as they are."""
    parts = []
    for piece in re.split(r"(\{\w+\})", text):
        known = piece[1:-1] if piece[:1] == "{" and piece[-1:] == "}" else None
        parts.append(F.coalesce(fields[known].cast("string"), F.lit("None")) if known in fields else F.lit(piece))
    return F.concat(*parts)


def sub_dictionary(c: Column, keys: list[str], kind: T.DataType) -> Column:
    """The part of a struct or map that the keys name; keys that aren't there are left out."""
    if isinstance(kind, T.StructType):
        return F.struct(*(c.getField(k).alias(k) for k in keys if k in kind.names))
    return F.map_filter(c, lambda k, _: k.isin(keys))


def package(c: Column) -> Column:
    """A value as text that any channel takes: base64 of its JSON."""
    return F.base64(F.encode(F.to_json(F.struct(c.alias("v"))), "UTF-8"))


def unpackage(c: Column, kind: T.DataType | str) -> Column:
    name = kind if isinstance(kind, str) else kind.simpleString()
    return F.from_json(F.decode(F.unbase64(c), "UTF-8"), f"v {name}").getField("v")


def message_hash(c: Column) -> Column:
    return F.md5(F.to_json(c))


def random_hash() -> Column:
    return F.md5(F.rand().cast("string"))


def flatten(c: Column, kind: T.DataType) -> Column:
    """Nested arrays as one, through every level."""
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        c, kind = F.flatten(c), kind.elementType
    return c


def nevermind(c: Column) -> Column:
    return c
