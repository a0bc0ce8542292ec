"""Operator 3. Sharding by a Feistel permutation of global row numbers.

Rows are numbered from 0 in the order of doc_id (equal ids by size and checksum).
A four-round Feistel network permutes the numbers of the least even power of two
that holds them all; a number that lands past the last row walks on along its
cycle until it lands inside. The place p then gives shard p mod SHARDS and slot
p div SHARDS: row counts of shards differ by one at most, slots have no gaps, and
both follow from the row's number, the row count and the key alone.

Edge cases: a null text has no bytes (size 1, checksum 0); null ids come first;
equal rows get numbers of their own; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, only

SHARDS = 8
KEY = 20240615
ROUNDS = 4


def half_bits(n: int) -> int:
    """Bits of each half of the network over at least n numbers."""
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def permute(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Places of row numbers 0 to n - 1 under the keyed permutation."""
    bits = np.uint64(half_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)
    x = numbers.astype(np.uint64)
    out, at = x.copy(), np.arange(len(x))
    while len(at):
        left, right = x >> bits, x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (mix64(right + np.uint64((key + (r + 1) * 0x9E3779B97F4A7C15) % (1 << 64))) & mask)
        x = (left << bits) | right
        inside = x < n
        out[at[inside]] = x[inside]
        at, x = at[~inside], x[~inside]
    return out.astype(np.int64)


def inverse(places: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Row numbers of places: the network run backwards, with the same walk."""
    bits = np.uint64(half_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)
    x = places.astype(np.uint64)
    out, at = x.copy(), np.arange(len(x))
    while len(at):
        left, right = x >> bits, x & mask
        for r in reversed(range(ROUNDS)):
            left, right = right ^ (mix64(left + np.uint64((key + (r + 1) * 0x9E3779B97F4A7C15) % (1 << 64))) & mask), left
        x = (left << bits) | right
        inside = x < n
        out[at[inside]] = x[inside]
        at, x = at[~inside], x[~inside]
    return out.astype(np.int64)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """``rows`` with a column ``number`` from 0 in the given order, and how many there are.

    The rows are sorted by range and written; each range's count (a row per
    partition) gives the first number of the next.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), within.alias("_within"))
    stored = scratch.write(ranged, "ranged")
    counts = sorted((r["_part"], r["count"]) for r in stored.groupBy("_part").count().collect())
    first, n = {}, 0
    for part, count in counts:
        first[part], n = n, n + count
    if not first:
        return stored.select(*rows.columns, F.lit(0).cast("long").alias("number")), 0
    starts = F.create_map(*[F.lit(x).cast("long") for pair in first.items() for x in pair])
    return stored.select(*rows.columns, (starts[F.col("_part").cast("long")] + F.col("_within")).alias("number")), n


def shard(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (none under this law), number."""
    text = F.coalesce("text", F.lit(""))
    narrow = only(docs, doc_id="doc_id", text="text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows, n = numbered(narrow, ["doc_id", "size", "text_crc32"], Scratch(docs.sparkSession, "sharding"))

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(permute(numbers.to_numpy(), n, key))

    placed = rows.withColumn("_place", place("number"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "number",
    )
