"""Expressions over tuples: order, equality and ranges by several columns at once."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedType


def as_columns(what: str | Column | Iterable) -> list[Column]:
    """Names are taken as SQL expressions, so "l.a + 1 AS a" works."""
    items = [what] if isinstance(what, (str, Column)) else list(what)
    return [F.expr(x) if isinstance(x, str) else x for x in items]


def _tuple(columns: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(f"_{i}") for i, c in enumerate(columns)])


def _literal(columns: Sequence[Column], values: Sequence) -> Column:
    if len(columns) != len(values):
        raise ValueError(f"{len(columns)} columns and {len(values)} values")
    return F.struct(*[F.lit(v).alias(f"_{i}") for i, v in enumerate(values)])


def tuple_at_least(columns: Sequence[Column], values: Sequence) -> Column:
    """Lexicographic >=; the leading comparison alone is added so that scans can skip."""
    return (columns[0] >= F.lit(values[0])) & (_tuple(columns) >= _literal(columns, values)) if len(columns) > 1 else columns[0] >= F.lit(values[0])


def tuple_between(columns: Sequence[Column], low: Sequence, high: Sequence) -> Column:
    """Lexicographic low <= columns <= high, both ends included."""
    if len(columns) == 1:
        return columns[0].between(F.lit(low[0]), F.lit(high[0]))
    return columns[0].between(F.lit(low[0]), F.lit(high[0])) & (_tuple(columns) >= _literal(columns, low)) & (_tuple(columns) <= _literal(columns, high))


def tuple_equals(columns: Sequence[Column], values: Sequence) -> Column:
    """Null-safe equality of every column."""
    out = F.lit(True)
    for c, v in zip(columns, values, strict=True):
        out &= c.eqNullSafe(F.lit(v))
    return out


def check_types(kind: T.DataType) -> None:
    """Refuse types without an order or an equality: maps, variants, nulls only, UDTs."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            check_types(f.dataType)
    elif isinstance(kind, T.ArrayType):
        check_types(kind.elementType)
    elif not isinstance(kind, (T.NumericType, T.BooleanType, T.StringType, T.CharType, T.VarcharType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        raise UnsupportedType(kind.simpleString())
