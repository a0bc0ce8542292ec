"""A plan-building interface by column position, over lazy DataFrames.

Each method returns a new relation; nothing runs until ``to_df`` is acted on. Columns are
addressed by place, so duplicate names never clash: they are renamed inside and get
their names at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Expr, expr

# Names of kinds.
JOINS = {"inner": "inner", "left": "left", "left_semi": "left_semi", "left_anti": "left_anti", "full": "full"}
AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_valid": F.count, "count_all": lambda c: F.count(F.lit(1))}

#: A side larger than this isn't broadcast whatever a plan asks for; Spark then chooses.
BROADCAST_BYTES = 512 << 20
#: A side larger than this isn't hashed in memory.
HASH_BYTES = 64 << 30


class Relation:
    def __init__(self, df: DataFrame, names: Sequence[str] | None = None):
        self.names = list(names or df.columns)
        self.df = df.toDF(*[f"_{i}" for i in range(len(df.columns))])

    @property
    def columns(self) -> list[Column]:
        return [self.df[f"_{i}"] for i in range(len(self.names))]

    def to_df(self, names: Sequence[str] | None = None) -> DataFrame:
        return self.df.toDF(*(names or self.names))

    def _select(self, df: DataFrame, columns: list[Column], names: list[str]) -> Relation:
        return Relation(df.select(*[c.alias(f"_{i}") for i, c in enumerate(columns)]), names)

    def _picked(self, indices: Sequence[int] | None) -> list[int]:
        return list(range(len(self.names))) if indices is None else list(indices)

    def filter(self, condition: Expr, projection: Sequence[int] | None = None) -> Relation:
        """Rows where the condition is true; the columns at the places given."""
        at = self._picked(projection)
        return self._select(self.df.where(condition.build(self.columns)), [self.columns[i] for i in at], [self.names[i] for i in at])

    def project(self, outputs: Sequence[Expr | int]) -> Relation:
        """An output for each expression; a place alone keeps its column."""
        built = [self.columns[o] if isinstance(o, int) else expr(o).build(self.columns) for o in outputs]
        return self._select(self.df, built, [self.names[o] if isinstance(o, int) else f"e{i}" for i, o in enumerate(outputs)])

    def named(self, *names: str) -> Relation:
        return Relation(self.df, names)

    def _join(self, right: Relation, condition: Expr, kind: str, projection, left_filter, right_filter, prepare) -> Relation:
        if kind not in JOINS:
            raise ValueError(f"unknown join {kind!r}; one of {', '.join(JOINS)}")
        n = len(self.names)
        other = right.df.toDF(*[f"_{n + i}" for i in range(len(right.names))])
        both = self.columns + [other[f"_{n + i}"] for i in range(len(right.names))]
        left = self.df.where(left_filter.build(both)) if left_filter else self.df
        other = other.where(right_filter.build(both)) if right_filter else other
        left, other = prepare(left, other)
        joined = left.join(other, condition.build(both), JOINS[kind])
        one_sided = kind in ("left_semi", "left_anti")
        names = self.names if one_sided else self.names + right.names
        at = range(len(names)) if projection is None else projection
        return Relation(joined.select(*[F.col(f"_{i}") for i in at]), [names[i] for i in at])

    def broadcast_join(self, right: Relation, condition: Expr, projection=None, kind: str = "inner", broadcast_left: bool = False, left_filter=None, right_filter=None) -> Relation:
        """A join that copies one side to all tasks, if the optimizer's estimate of it is small enough.

        The condition may be any over the columns of both sides. ``right_filter`` counts places on from the left's.
        """

        def prepare(left: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
            return (_broadcast(left), other) if broadcast_left else (left, _broadcast(other))

        return self._join(right, condition, kind, projection, left_filter, right_filter, prepare)

    def shuffle_join(self, right: Relation, condition: Expr, projection=None, kind: str = "inner", left_filter=None, right_filter=None, strategy: str | None = None) -> Relation:
        """A join of sides hashed by their keys; Spark adds the exchanges itself.

        Without a strategy Spark chooses one that spills. ``shuffle_hash`` holds a partition of the right side in memory, so it is
        only asked for where the estimate of that side is small enough for its partitions.
        """
        if strategy == "shuffle_hash" and estimated_bytes(right.df) > HASH_BYTES:
            strategy = None
        return self._join(right, condition, kind, projection, left_filter, right_filter, lambda left, other: (left, other.hint(strategy) if strategy else other))

    def shuffle(self, columns: Sequence[int], partitions: int | None = None) -> Relation:
        """Rows dealt by a hash of columns."""
        keys = [self.columns[i] for i in columns]
        return Relation(self.df.repartition(*([partitions] if partitions else []), *keys), self.names)

    def aggregate(self, keys: Sequence[Expr | int], measures: Sequence[tuple[str, Expr | int]], condition: Expr | None = None) -> Relation:
        """Keys, then measures (kind, expression). No keys: one row. No measures: distinct keys."""
        df = self.df.where(condition.build(self.columns)) if condition else self.df
        of = lambda e: self.columns[e] if isinstance(e, int) else e.build(self.columns)
        built = []
        for i, (kind, e) in enumerate(measures):
            if kind not in AGGREGATES:
                raise ValueError(f"unknown aggregate {kind!r}; one of {', '.join(AGGREGATES)}")
            if not isinstance(e, (Expr, int)):
                raise TypeError("a measure is an expression")
            built.append(AGGREGATES[kind](of(e)).alias(f"_{len(keys) + i}"))
        by = [of(k).alias(f"_{i}") for i, k in enumerate(keys)]
        names = [self.names[k] if isinstance(k, int) else f"k{i}" for i, k in enumerate(keys)] + [kind for kind, _ in measures]
        if not measures:
            return Relation(df.select(*by).distinct(), names)
        return Relation(df.groupBy(*by).agg(*built) if by else df.agg(*built), names)

    def sort(self, keys: Sequence[tuple[Expr | int, str, str]]) -> Relation:
        """By (expression, ascending or descending, nulls before or after)."""
        built = []
        for e, order, nulls in keys:
            column = self.columns[e] if isinstance(e, int) else e.build(self.columns)
            name = {("ascending", "before"): "asc_nulls_first", ("ascending", "after"): "asc_nulls_last", ("descending", "before"): "desc_nulls_first", ("descending", "after"): "desc_nulls_last"}.get((order, nulls))
            if not name:
                raise ValueError(f"unknown order {order!r}, {nulls!r}")
            built.append(getattr(column, name)())
        return Relation(self.df.orderBy(*built), self.names)

    def fetch(self, offset: int, count: int) -> Relation:
        """``count`` rows after the first ``offset``; fewer at the end."""
        if offset < 0 or count < 0:
            raise ValueError("offset and count aren't negative")
        return Relation(self.df.offset(offset).limit(count), self.names)

    def transform(self, step: Callable[[DataFrame], DataFrame], names: Sequence[str] | None = None) -> Relation:
        """A user's operator: a function from a table, under its names, to a table."""
        return Relation(step(self.to_df()), names)

    def union_all(self, other: Relation) -> Relation:
        """Rows of both, by place, duplicates kept."""
        return Relation(self.df.unionAll(other.df), self.names)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a result's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if estimated_bytes(df) <= BROADCAST_BYTES else df


def read(catalog, table: str, columns: Sequence[str], partial_filter: Expr | None = None) -> Relation:
    """Columns of a catalog table in the order given. ``partial_filter`` counts places in the whole table, and is pushed to the scan."""
    df = catalog.table(table)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"unable to find column name {', '.join(missing)} in {table}")
    if partial_filter is not None:
        df = df.where(partial_filter.build([df[c] for c in df.columns]))
    return Relation(df.select(*columns))
