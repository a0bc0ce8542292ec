"""Sizes of a dataset's tables in memory, before it is loaded."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Bytes of a value by type; a string's are an average.
STRING_BYTES = 25
_FIXED = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8, T.BooleanType: 1}

#: Rows at scale factor 1; the others' count doesn't grow.
ROWS = {"supplier": 10_000, "customer": 150_000, "part": 200_000, "orders": 1_500_000, "lineitem": 6_000_000, "partsupp": 800_000}
CONSTANT_ROWS = {"region": 5, "nation": 25}


def scale_factor(path: str) -> float:
    """Of the last part of a path that names one: ``sf0.01``, ``SF-1k``, ``sf_100``."""
    for part in reversed(path.split("/")):
        if m := re.search(r"sf[-_]?(\d+(?:\.\d+)?)(k?)(?![\w])", part, re.IGNORECASE):
            return float(m[1]) * (1000 if m[2] else 1)
    raise ValueError(f"no scale factor in {path}")


def key_type(path: str) -> T.DataType:
    """Of keys: by ``id32`` or ``id64`` in the path; else 64 bits from the scale on at which 32 overflow."""
    if m := re.search(r"id(32|64)", path):
        return T.IntegerType() if m[1] == "32" else T.LongType()
    return T.LongType() if scale_factor(path) >= 357 else T.IntegerType()


def rows_of(table: str, sf: float) -> int:
    return CONSTANT_ROWS.get(table) or int(ROWS[table] * sf)


def width(schema: T.StructType) -> int:
    return sum(next((n for kind, n in _FIXED.items() if isinstance(f.dataType, kind)), STRING_BYTES) for f in schema)


def table_bytes(table: str, schema: T.StructType, sf: float) -> int:
    return rows_of(table, sf) * width(schema)
