"""Sweep configurations in JSON: required fields, defaults, and overrides by query."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from itertools import product
from pathlib import Path


@dataclass
class SweepConfig:
    """Lists are the values that a sweep tries. Overrides: entries of ``queries`` and the lists to use for them."""

    dataset: str
    queries: list[str]
    storage: list[str] = field(default_factory=lambda: ["parquet_file"])
    shuffle_partitions: list[int] = field(default_factory=lambda: [200])
    broadcast_threshold: list[int] = field(default_factory=lambda: [10 << 20])
    adaptive: list[bool] = field(default_factory=lambda: [True])
    codec: list[str] = field(default_factory=lambda: ["zstd"])
    repeat: int = 6
    query_timeout: int = 1800
    load_timeout: int = 10800
    validate: bool = True
    query_overrides: list[dict] = field(default_factory=list)


_SWEPT = ("storage", "shuffle_partitions", "broadcast_threshold", "adaptive", "codec")


def parse_config(raw: dict) -> SweepConfig:
    known = {f.name for f in fields(SweepConfig)}
    if unknown := sorted(set(raw) - known):
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    if missing := [name for name in ("dataset", "queries") if name not in raw]:
        raise ValueError(f"required fields: {', '.join(missing)}")
    for entry in raw.get("query_overrides", []):
        if not isinstance(entry.get("queries"), list):
            raise ValueError("an override names its queries")
        if unknown := sorted(set(entry) - {"queries", *_SWEPT}):
            raise ValueError(f"fields that can't be overridden: {', '.join(unknown)}")
        if scalar := [k for k, v in entry.items() if not isinstance(v, list)]:
            raise ValueError(f"overrides are lists: {', '.join(scalar)}")
    return SweepConfig(**raw)


def load_config(path: str) -> SweepConfig:
    return parse_config(json.loads(Path(path).read_text()))


def parameters_of(config: SweepConfig, query: str) -> dict[str, list]:
    """The lists for a query. A matching override replaces the default; several of them merge, each value once, in order."""
    out = {}
    for name in _SWEPT:
        lists = [e[name] for e in config.query_overrides if query in e["queries"] and name in e]
        out[name] = list(dict.fromkeys(v for values in lists for v in values)) if lists else list(getattr(config, name))
    return out


def combinations(config: SweepConfig, query: str) -> list[dict]:
    """Every combination for a query, without those that mean the same: partition counts matter to the runtime plan only as a start."""
    found, seen = [], set()
    lists = parameters_of(config, query)
    for values in product(*lists.values()):
        row = dict(zip(lists, values))
        mark = json.dumps(row | ({"codec": None} if row["storage"] != "parquet_file" else {}), sort_keys=True)
        if mark not in seen:
            seen.add(mark)
            found.append(row)
    return found


def spark_conf(row: dict) -> dict[str, str]:
    return {
        "spark.sql.shuffle.partitions": str(row["shuffle_partitions"]),
        "spark.sql.autoBroadcastJoinThreshold": str(row["broadcast_threshold"]),
        "spark.sql.adaptive.enabled": str(row["adaptive"]).lower(),
        "spark.sql.parquet.compression.codec": row["codec"],
    }
