"""Functions by name: built-in column expressions, those registered here, and dotted Python names from allowed modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scalar


@dataclass
class Named:
    """``columnar``: it maps columns to a column. Otherwise it is a Python function of values, run as an Arrow UDF."""

    function: Callable
    columnar: bool
    returns: T.DataType | str = "string"

    def __call__(self, *args: Column, **kwargs: object) -> Column:
        if self.columnar:
            return self.function(*args, **kwargs)
        f = self.function
        return F.udf((lambda *a: f(*a, **kwargs)) if kwargs else f, self.returns, useArrow=True)(*args)


_COLUMNAR = {n: getattr(scalar, n) for n in dir(scalar) if not n.startswith("_") and callable(getattr(scalar, n)) and getattr(scalar, n).__module__ == scalar.__name__ and n not in ("pattern",)}
_COLUMNAR |= {"identity": scalar.nevermind, "noop": scalar.nevermind, "upper": F.upper, "lower": F.lower, "trim": F.trim, "length": F.length, "concat": F.concat, "int": lambda c: c.try_cast("bigint"), "float": lambda c: c.try_cast("double"), "str": lambda c: c.cast("string"), "bool": scalar.to_bool, "len": F.size, "abs": F.abs, "md5": F.md5}
REGISTRY: dict[str, Named] = {n: Named(f, True) for n, f in _COLUMNAR.items()}
#: Modules that dotted names may be imported from.
ALLOWED_MODULES: set[str] = {"builtins", "math", "json", "string", "operator", "urllib.parse", "datetime", "hashlib", "base64", "html"}


def register(name: str, function: Callable, returns: T.DataType | str | None = None) -> Named:
    """Makes a function known by name: with a return type a Python function of values, without one a function of columns."""
    REGISTRY[name] = Named(function, returns is None, returns or "string")
    return REGISTRY[name]


def load_function(name: str, returns: T.DataType | str = "string") -> Named:
    """By bare name from the registry, or by dotted name (a.b.f or a__b__f) from an allowed module."""
    dotted = name.replace("__", ".")
    if name in REGISTRY:
        return REGISTRY[name]
    module, _, f = dotted.rpartition(".")
    if not module:
        raise ValueError(f"unknown function {name!r}")
    if f in REGISTRY and module.split(".")[-1] in ("helpers", "functions", "scalar"):
        return REGISTRY[f]
    if module not in ALLOWED_MODULES:
        raise ValueError(f"{module} isn't among the allowed modules")
    return Named(getattr(importlib.import_module(module), f), False, returns)
