"""Relations: immutable sets of tuples with a fixed schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..engine import Engine
from ..functions import check_types, tuple_at_least
from ..sources import load_relation, save_relation


def as_schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


def same_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame, or ValueError if names, types or their order differ."""
    mine, theirs = ([(f.name, f.dataType.simpleString()) for f in s] for s in (df.schema, schema))
    if mine != theirs:
        raise ValueError(f"columns {mine}, expected {theirs}")
    return df


class Relation:
    """A de-duplicated DataFrame. Nulls equal each other, as do NaNs, and 0.0 and -0.0."""

    def __init__(self, engine: Engine, df: DataFrame, distinct: bool = False):
        """``distinct`` says that the rows are known to differ already."""
        check_types(df.schema)
        self.engine, self.df, self._count = engine, df if distinct else df.distinct(), None

    @classmethod
    def from_rows(cls, engine: Engine, rows: Iterable, schema: T.StructType | str) -> Relation:
        """From Python tuples, or bare values if the schema has one column."""
        schema = as_schema(schema)
        rows = [r if isinstance(r, (tuple, list)) else (r,) for r in rows]
        return cls(engine, engine.spark.createDataFrame(rows, schema)) if rows else cls.empty(engine, schema)

    @classmethod
    def empty(cls, engine: Engine, schema: T.StructType | str) -> Relation:
        return cls(engine, engine.spark.createDataFrame([], as_schema(schema)), distinct=True)

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def count(self) -> int:
        if self._count is None:
            self._count = self.df.count()
        return self._count

    __len__ = count

    def is_empty(self) -> bool:
        return self.df.isEmpty() if self._count is None else not self._count

    def stored(self) -> Relation:
        """The same rows, written to the shared workspace so that plans start from there."""
        path, n = self.engine.write(self.df)
        out = Relation(self.engine, self.engine.read([path], self.schema), distinct=True)
        out._count = n
        return out

    def cached(self) -> Relation:
        self.df.persist()
        return self

    def release(self) -> None:
        self.df.unpersist()

    def merge(self, *others: Relation) -> Relation:
        """Union; all inputs stay usable."""
        df = self.df
        for o in others:
            df = df.union(same_schema(o.df, self.schema))
        return Relation(self.engine, df)

    def subtract(self, other: Relation) -> Relation:
        """Null-safe difference."""
        return Relation(self.engine, self.df.subtract(same_schema(other.df, self.schema)), distinct=True)

    def intersect(self, other: Relation) -> Relation:
        return Relation(self.engine, self.df.intersect(same_schema(other.df, self.schema)), distinct=True)

    def select(self, *columns: str | Column) -> Relation:
        return Relation(self.engine, self.df.select(*[F.expr(c) if isinstance(c, str) else c for c in columns]))

    def where(self, condition: str | Column) -> Relation:
        return Relation(self.engine, self.df.where(condition), distinct=True)

    def suffix_from(self, *values) -> Relation:
        """Tuples that are, compared column by column, at least ``values``."""
        columns = [F.col(f"`{c}`") for c in self.df.columns[: len(values)]]
        return Relation(self.engine, self.df.where(tuple_at_least(columns, values)), distinct=True)

    def sorted(self) -> DataFrame:
        """Rows in the order of tuples; the one place where order exists."""
        return self.df.orderBy(*[F.col(f"`{c}`") for c in self.df.columns])

    def rows(self) -> list[tuple]:
        """All rows, sorted, on the driver: for small relations and tests."""
        return [tuple(r) for r in self.sorted().collect()]

    def save(self, path: str) -> int:
        return save_relation(self.engine, self.df, path)

    @classmethod
    def load(cls, engine: Engine, path: str, limit: int | None = None, schema: T.StructType | str | None = None) -> Relation:
        return cls(engine, load_relation(engine, path, limit, None if schema is None else as_schema(schema)))
