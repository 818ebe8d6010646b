"""Type names, casts and typed rows."""

from __future__ import annotations

import datetime
import re
from typing import Any

from pyspark.sql import Column, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Intermediate type names and property types of graph models.
NAMED = {
    "STRING": T.StringType(), "INTEGER": T.LongType(), "DATETIME": T.TimestampNTZType(), "FLOAT": T.DoubleType(), "BOOL": T.BooleanType(),
    "String": T.StringType(), "Integer": T.LongType(), "DateTime": T.TimestampNTZType(), "Float": T.DoubleType(), "Boolean": T.BooleanType(),
}
_PLAIN = {"date": T.DateType(), "datetime": T.TimestampNTZType(), "bool": T.BooleanType(), "float": T.DoubleType(), "double": T.DoubleType(), "enum": T.StringType(), "int": T.LongType(), "varchar": T.StringType()}
_COERCED = {"int": T.LongType(), "integer": T.LongType(), "str": T.StringType(), "string": T.StringType(), "float": T.DoubleType(), "bool": T.BooleanType()}


def type_from_string(name: str) -> T.DataType:
    """int(n), varchar(n), date and the like, of any length; anything else is a string of up to 128 characters."""
    if name in NAMED:
        return NAMED[name]
    m = re.fullmatch(r"\s*([a-z]+)\s*(?:\(\s*([^)]*)\s*\))?\s*(?:unsigned)?\s*", name.lower())
    if not m or m[1] not in _PLAIN:
        return T.VarcharType(128)
    return T.VarcharType(int(m[2])) if m[1] == "varchar" and m[2] else _PLAIN[m[1]]


def primitive_type(value: Any) -> T.DataType:
    """The type of a Python value."""
    for kind, spark in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (bytes, T.BinaryType()), (datetime.datetime, T.TimestampNTZType()), (datetime.date, T.DateType()), (type(None), T.NullType())):
        if isinstance(value, kind):
            return spark
    raise TypeError(f"no primitive type for {type(value).__name__}")


def convert(col: Column, to: T.DataType | str) -> Column:
    """A cast that gives null where it fails."""
    kind = type_from_string(to) if isinstance(to, str) else to
    return col.try_cast(T.StringType() if isinstance(kind, T.VarcharType) else kind)


def coerce(value: Any, name: str | None) -> Any:
    """A literal of a sequence as the type that it names."""
    if name is None:
        return value
    if name not in _COERCED:
        raise ValueError(f"unknown type {name!r}")
    return {"int": int, "integer": int, "str": str, "string": str, "float": float, "bool": bool}[name](value)


def possible_types(col: Column) -> Column:
    """Names of the types that a string can be read as, narrowest first."""
    kinds = (("INTEGER", "bigint"), ("FLOAT", "double"), ("BOOL", "boolean"), ("DATETIME", "timestamp_ntz"))
    return F.array_compact(F.array(*(F.when(col.try_cast(t).isNotNull(), F.lit(n)) for n, t in kinds), F.lit("STRING")))


class TypedRow(dict):
    """Named values with their types: a mapping that checks its values, and merges with others of distinct names."""

    def __init__(self, types: dict[str, T.DataType] | None = None, **values: Any) -> None:
        super().__init__(values)
        self.types = dict(types or {}) | {k: primitive_type(v) for k, v in values.items() if k not in (types or {})}

    @classmethod
    def from_dict(cls, values: dict) -> TypedRow:
        return cls(None, **values)

    def __getattr__(self, name: str) -> Any:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def is_empty(self) -> bool:
        return not self

    def concat(self, other: TypedRow, fail_on_duplicate: bool = True) -> TypedRow:
        """Both rows' values, the other's on a clash; a clash raises if asked to."""
        if fail_on_duplicate and self.keys() & other.keys():
            raise KeyError(f"in both rows: {sorted(self.keys() & other.keys())}")
        return TypedRow(self.types | other.types, **(dict(self) | dict(other)))

    def __iadd__(self, other: TypedRow) -> TypedRow:
        for k in self.keys() & other.keys():
            if self.types[k] != other.types[k]:
                raise TypeError(f"{k}: {self.types[k]} isn't {other.types[k]}")
        return self.concat(other, fail_on_duplicate=False)

    def to_row(self) -> Row:
        return Row(**self)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(k, self.types[k]) for k in self])
