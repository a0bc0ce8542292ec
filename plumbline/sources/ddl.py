"""CREATE TABLE statements to Spark schemas, with unique columns marked in the fields' metadata."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Types by their names; sizes and scales are left away, decimals are doubles.
TYPES = {"INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "CHAR": T.StringType(), "VARCHAR": T.StringType(), "DECIMAL": T.DoubleType(), "DATE": T.DateType()}

_CREATE = re.compile(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"`]+)\s*\((.*)\)\s*$", re.IGNORECASE | re.DOTALL)
_UNIQUE = re.compile(r"^(?:CONSTRAINT\s+\S+\s+)?(?:PRIMARY\s+KEY|UNIQUE)\s*\(([^)]*)\)", re.IGNORECASE)


def _name(text: str) -> str:
    return text.strip().strip("\"`").rpartition(".")[2].strip("\"`").lower()


def _parts(body: str) -> list[str]:
    """Split at commas outside brackets."""
    out, depth = [""], 0
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out if p.strip()]


def parse_ddl(text: str) -> dict[str, T.StructType]:
    """A schema for each table. A key over several columns makes none of them unique."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.DOTALL)
    tables: dict[str, T.StructType] = {}
    for statement in filter(str.strip, text.split(";")):
        m = _CREATE.match(statement.strip())
        if not m:
            raise ValueError(f"not a CREATE TABLE statement: {statement.strip()[:60]}")
        fields: dict[str, tuple[T.DataType, bool, bool]] = {}
        unique: set[str] = set()
        for part in _parts(m[2]):
            if key := _UNIQUE.match(part):
                columns = [_name(c) for c in key[1].split(",")]
                unique |= set(columns) if len(columns) == 1 else set()
                continue
            if re.match(r"(FOREIGN\s+KEY|CHECK|CONSTRAINT)\b", part, re.IGNORECASE):
                continue
            name, kind, rest = re.match(r"([\w\"`]+)\s+(\w+)\s*(?:\([^)]*\))?(.*)$", part, re.DOTALL).groups()
            if kind.upper() not in TYPES:
                raise KeyError(f"unknown type {kind} of column {name}")
            if re.search(r"\b(PRIMARY\s+KEY|UNIQUE)\b", rest, re.IGNORECASE):
                unique.add(_name(name))
            fields[_name(name)] = TYPES[kind.upper()], not re.search(r"NOT\s+NULL|PRIMARY\s+KEY", rest, re.IGNORECASE), False
        tables[_name(m[1])] = T.StructType([T.StructField(n, kind, null, {"unique": True} if n in unique else {}) for n, (kind, null, _) in fields.items()])
    return tables
