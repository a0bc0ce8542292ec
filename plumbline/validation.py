"""Comparing results with those of an independent SQL engine, in any row order or in the given one."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value as both engines give it: dates and times as text, whole floats of other types as floats."""
    if isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat().removesuffix("T00:00:00")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def same(a, b, tolerance: float = 1e-6) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b or math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)
    return a == b


def ordered(rows: list[dict], in_order: bool = False) -> list[tuple]:
    found = [tuple(plain(r[k]) for k in sorted(r)) for r in rows]
    return found if in_order else sorted(found, key=lambda r: [(v is None, f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r])


def oracle(sf_dir: str, sql: str) -> list[dict]:
    """The rows of ``sql`` over the tables of a folder, by DuckDB."""
    import os

    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return [dict(zip(names, row)) for row in got.fetchall()]


def differences(ours: list[dict], theirs: list[dict], tolerance: float = 1e-6, in_order: bool = False) -> str:
    """Empty if the rows are the same, in order too where that is asked; else what differs first."""
    if len(ours) != len(theirs):
        return f"{len(ours)} rows, the oracle has {len(theirs)}"
    if ours and sorted(ours[0]) != sorted(theirs[0]):
        return f"columns {sorted(ours[0])}, the oracle has {sorted(theirs[0])}"
    for a, b in zip(ordered(ours, in_order), ordered(theirs, in_order)):
        if len(a) != len(b) or not all(same(x, y, tolerance) for x, y in zip(a, b)):
            return f"{a} against {b}"
    return ""
