"""Expressions by position, for the relation interface, and scalar helpers with settled semantics.

An ``Expr`` becomes a Spark column once the columns of its relation are known. Plain Python
values beside an ``Expr`` are literals.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Expr:
    def __init__(self, build: Callable[[list[Column]], Column]):
        self.build = build

    def _with(self, other, op: Callable[[Column, Column], Column]) -> Expr:
        other = expr(other)
        return Expr(lambda cols: op(self.build(cols), other.build(cols)))

    def __and__(self, other):
        return self._with(other, lambda a, b: a & b)

    def __or__(self, other):
        return self._with(other, lambda a, b: a | b)

    def __eq__(self, other):
        return self._with(other, lambda a, b: a == b)

    def __ne__(self, other):
        return self._with(other, lambda a, b: a != b)

    def __lt__(self, other):
        return self._with(other, lambda a, b: a < b)

    def __le__(self, other):
        return self._with(other, lambda a, b: a <= b)

    def __gt__(self, other):
        return self._with(other, lambda a, b: a > b)

    def __ge__(self, other):
        return self._with(other, lambda a, b: a >= b)

    def __add__(self, other):
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._with(other, lambda a, b: a * b)

    def __truediv__(self, other):
        return self._with(other, lambda a, b: a / b)

    def __invert__(self):
        return Expr(lambda cols: ~self.build(cols))

    __hash__ = None


def expr(value) -> Expr:
    return value if isinstance(value, Expr) else literal(value)


def ref(index: int) -> Expr:
    """The column at a place from 0; in join conditions those of the right side follow the left's."""
    if index < 0:
        raise ValueError("places start at 0")
    return Expr(lambda cols: cols[index])


# Spark types of Python and numpy literals. bool stands before int, which holds it.
_LITERALS = {np.int32: "int", np.int64: "bigint", np.float32: "float", np.float64: "double", bool: "boolean", str: "string", int: "int", float: "double"}


def literal(value) -> Expr:
    """A constant: int is 32 bits and float 64, numpy numbers keep their width. Never null."""
    kind = _LITERALS.get(type(value))
    if kind is None:
        raise NotImplementedError(f"no literal of {type(value).__name__}")
    plain = value.item() if isinstance(value, np.generic) else value
    return Expr(lambda cols: F.lit(plain).cast(kind))


def date_literal(text: str) -> Expr:
    day = date.fromisoformat(text)
    return Expr(lambda cols: F.lit(day))


def like_column(column: Column, pattern: str, escape: str = "") -> Column:
    """SQL LIKE. Without an escape sign, a backslash in the pattern stands for itself."""
    if len(escape) > 1:
        raise ValueError("the escape is one character")
    if not escape:  # Spark's own escape is the backslash
        return column.like(pattern.replace("\\", "\\\\"))
    return F.like(column, F.lit(pattern), F.lit(escape))


def like(value: Expr, pattern: str, escape: str = "") -> Expr:
    return Expr(lambda cols: like_column(value.build(cols), pattern, escape))


def substr_column(column: Column, start: int, length: int) -> Column:
    """``length`` characters from ``start``, which counts from 0."""
    if start < 0 or length < 0:
        raise ValueError("start and length aren't negative")
    return F.substring(column, start + 1, length)


def substr(value: Expr, start: int, length: int) -> Expr:
    return Expr(lambda cols: substr_column(value.build(cols), start, length))


def if_then_else(condition: Expr, then, otherwise) -> Expr:
    """``otherwise`` where the condition is false or null."""
    then, otherwise = expr(then), expr(otherwise)
    return Expr(lambda cols: F.when(condition.build(cols), then.build(cols)).otherwise(otherwise.build(cols)))


# Parts of dates and times. Weeks start on Monday, which is 1.
_PARTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "weekday": lambda c: F.weekday(c) + 1,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "millisecond": lambda c: F.date_format(c, "SSS").cast("int"),
    "nanosecond": lambda c: F.when(c.isNotNull(), F.lit(0)),  # times have whole microseconds
}


def date_part_column(column: Column, part: str) -> Column:
    if part not in _PARTS:
        raise ValueError(f"unknown part {part!r}; one of {', '.join(_PARTS)}")
    return _PARTS[part](column)


def date_part(value: Expr, part: str) -> Expr:
    if part not in _PARTS:
        raise ValueError(f"unknown part {part!r}; one of {', '.join(_PARTS)}")
    return Expr(lambda cols: date_part_column(value.build(cols), part))


def cast(value: Expr, kind: str) -> Expr:
    """To ``int64`` or ``float64``."""
    target = {"int64": "bigint", "float64": "double"}.get(kind)
    if not target:
        raise ValueError(f"can't cast to {kind!r}")
    return Expr(lambda cols: value.build(cols).cast(target))
