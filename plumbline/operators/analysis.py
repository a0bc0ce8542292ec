"""Analytic operators over event tables: interval merging, containment joins, pairs in order, best and stable configurations, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relation import estimated_bytes


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Maximal intervals that overlapping or touching ones make, by key: keys, start, end, n_merged.

    An interval opens a new island where it starts after all before it have ended.
    """
    order = Window.partitionBy(*keys).orderBy(start, end)
    so_far = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(so_far.isNull() | (F.col(start) > so_far), 1).otherwise(0)
    islands = df.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_merged")).drop("_island")


def covered_length(df: DataFrame, keys: Sequence[str], start: str, end: str, alias: str = "covered") -> DataFrame:
    """Length that intervals cover, overlaps counted once."""
    return merge_intervals(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias(alias))


def contained_in(children: DataFrame, parents: DataFrame, keys: Sequence[str], child: tuple[str, str], parent: tuple[str, str], bucket: int) -> DataFrame:
    """Pairs of a child interval and each parent interval of the same keys that contains it.

    Parents fall into classes of length: up to ``bucket`` units, and each class twice as long as the one before. A parent is listed under
    the buckets of its class's length that it meets, two at most however long it is. A child is placed in the bucket of its start in each class
    that parents have and that is no shorter than its own. A hash join on keys, class and bucket replaces a comparison of all pairs.
    Intervals end no earlier than they start; one without a start or an end is in no pair.
    """
    length = lambda of: F.greatest(F.lit(0), F.ceil(F.log2((F.col(of[1]) - F.col(of[0])) / bucket))).cast("int")
    known = lambda df, of: df.where(F.col(of[0]).isNotNull() & F.col(of[1]).isNotNull()).withColumn("_k", F.coalesce(length(of), F.lit(0)))
    at = lambda c: F.floor(F.col(c) / (F.lit(bucket) * F.pow(F.lit(2.0), "_k")))
    parents = known(parents, parent)
    spread = parents.withColumn("_b", F.explode(F.array_distinct(F.array(at(parent[0]), at(parent[1])))))
    classes = parents.select("_k").distinct()  # a row for each doubling of the bucket, so fewer than the bits of a length
    placed = known(children, child).withColumnRenamed("_k", "_own").join(F.broadcast(classes), F.col("_own") <= F.col("_k")).withColumn("_b", at(child[0]))
    joined = placed.join(spread, [*keys, "_k", "_b"]).drop("_k", "_own", "_b")
    return joined.where((F.col(child[0]) >= F.col(parent[0])) & (F.col(child[1]) <= F.col(parent[1])))


def _in_blocks(df: DataFrame, size: int, rows: int) -> DataFrame:
    """Rows (_k, _g, _v) in blocks of near values of a group: _g, _b, _least, _most and _rows by value; _b rises with group and value.

    Equal values stand in order of their keys, so a lost partition comes back in the same blocks.
    """
    order = ["_g", "_v", "_k"]
    placed = df.repartitionByRange(1 + rows // 250_000, *order).sortWithinPartitions(*order).withColumn("_b", F.expr(f"monotonically_increasing_id() div {size}"))
    return placed.groupBy("_g", "_b").agg(F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.sort_array(F.collect_list(F.struct("_v", "_k"))).alias("_rows"))


def pairs_above(high: DataFrame, low: DataFrame, high_cols: tuple[str, str, str], low_cols: tuple[str, str, str], block: int = 256, tasks: int | None = None, small: int = 64 << 20) -> DataFrame:
    """(key of low, key of high) of each pair with the same group where high's value is above low's; columns are (key, group, value).

    Rows of both sides stand in blocks of near values, and blocks meet. A row of ``high`` takes whole blocks that end below its value and the
    beginning of those that its value falls in, so what is compared in vain is a block or two a row. The pairs are as many as they are; ``high``'s
    blocks are dealt evenly over tasks by the pairs' upper bound, whatever its files or groups, neighbours to one task. All rows of a block take
    the same block of ``low`` one after the other, so a key of ``high`` is repeated and the keys of ``low`` come again and again in one order:
    files of the pairs hold a small part of a byte a row, where each row of ``high`` would otherwise list all of its group. ``low``'s blocks are
    copied to all tasks up to ``small`` bytes of ``low``, as the optimizer estimates; beyond, tasks stand in a square and both sides are copied
    along one edge, so what is shuffled grows with the root of the tasks.
    """
    side = lambda df, cols: df.select(*[F.col(c).alias(name) for c, name in zip(cols, ("_k", "_g", "_v"))]).where("_g is not null and _v is not null")
    above, below = side(high, high_cols), side(low, low_cols)
    n, m = above.count(), below.count()
    if tasks is None:
        tasks = max(1, min(4096, n * m // 500_000_000))
    each = lambda name: F.transform("_rows", lambda r: r[name])
    lows = _in_blocks(below, block, m).select("_g", "_b", "_least", F.col("_most").alias("_end"), each("_k").alias("_keys"), each("_v").alias("_values"))
    highs = _in_blocks(above, block, n).select("_g", "_b", "_most", "_rows")
    if estimated_bytes(below) <= small:
        met = highs.repartitionByRange(tasks, "_b").join(F.broadcast(lows.drop("_b")), "_g")
    else:
        across = max(1, min(tasks, round((tasks * n / max(1, m)) ** 0.5)))
        down = -(-tasks // across)
        part = lambda count: F.pmod(F.xxhash64("_b"), F.lit(count)).cast("int")
        all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        on = ["_g", "_across", "_down"]
        highs = highs.withColumn("_across", part(across)).withColumn("_down", all_of(down)).repartition(tasks, *on)
        met = highs.join(lows.withColumn("_down", part(down)).drop("_b").withColumn("_across", all_of(across)).repartition(tasks, *on).hint("merge"), on)
    # Functions of arrays keep these steps out of generated code, which would hold all pairs of two blocks at once.
    rows = met.where("_most > _least").select("_end", "_keys", "_values", F.explode(F.filter("_rows", lambda r: r["_v"] > F.col("_least"))).alias("_r"))
    value = F.col("_r._v")
    counted = rows.select("_keys", F.col("_r._k").alias("_hk"), F.when(value > F.col("_end"), F.size("_keys")).otherwise(F.size(F.filter("_values", lambda v: v < value))).alias("_n"))
    return counted.select(F.explode(F.slice("_keys", F.lit(1), F.col("_n"))).alias(low_cols[0]), F.col("_hk").alias(high_cols[0]))


def best_per_group(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str]) -> DataFrame:
    """The row with the least ``by`` of each group; the first by ``ties`` if there are several."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    order = F.struct(by, *ties)
    return df.groupBy(*keys).agg(F.min_by(row, order).alias("_r")).select(*keys, "_r.*")


def warm_statistics(runs: DataFrame, keys: Sequence[str], number: str, value: str) -> DataFrame:
    """Mean, extremes and count by key, without the first run (number 0)."""
    return runs.where(F.col(number) > 0).groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n"))


def matches_glob(column, pattern: str):
    """``*`` and ``?`` stand for any run and any character, ``[ab-d]`` for one of a set and ``[^...]`` (or ``[!...]``) for one outside it.

    A ``]`` that comes first in a set belongs to it; a ``[`` that nothing closes is itself. The whole value must match.
    """
    import re

    def piece(m: re.Match) -> str:
        if m[1] is not None:
            return f"[{'^' if m[1] else ''}{re.sub(r'([^-0-9A-Za-z])', r'\\\1', m[2])}]"
        return {"*": ".*", "?": "."}.get(m[0]) or re.escape(m[0])

    return column.rlike(r"\A(?s:" + re.sub(r"(?s)\[([\^!]?)(\]?[^\]]+|\])\]|.", piece, pattern) + r")\z")


def joined_strings(df: DataFrame, keys: Sequence[str], value: str, alias: str, separator: str = ",") -> DataFrame:
    """Distinct values of each group, sorted, in one string."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias(alias))


def pivot_max(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    """A column for each of ``values`` with the largest ``value`` there; the list is given, so no pass is needed to find it."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(column) == v, F.col(value))).alias(v) for v in values])


def size_rollup(df: DataFrame, keys: Sequence[str], plain: str, packed: str) -> DataFrame:
    """Sums of plain and packed sizes and their ratio at each level of ``keys``: keys, plain_size, primary_size, n, ratio, level (keys rolled up).

    The finest groups are summed first, so only they, and not the rows, are repeated for the levels.
    """
    finest = df.groupBy(*keys).agg(F.sum(F.col(plain).cast("long")).alias("_plain"), F.sum(F.col(packed).cast("long")).alias("_packed"), F.count(F.lit(1)).alias("_n"))
    level = sum((F.grouping(k).cast("long") for k in keys), F.lit(0).cast("long")).alias("level")
    rolled = finest.rollup(*keys).agg(F.sum("_plain").alias("plain_size"), F.sum("_packed").alias("primary_size"), F.sum("_n").alias("n"), level)
    return rolled.withColumn("ratio", F.round(F.col("plain_size").cast("double") / F.col("primary_size"), 6))
