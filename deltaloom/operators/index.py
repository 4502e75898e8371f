"""Secondary indices: lookups by a key that tuples are not ordered by."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..engine import Engine
from ..functions import as_columns, tuple_between, tuple_equals
from .relation import Relation, as_schema


class SecondaryIndex:
    """Tuples found by key expressions, one or several.

    ``clustered`` writes the tuples in ranges of the key, so that Parquet statistics let a
    lookup skip files; else lookups are filters pushed into whatever the tuples come from.
    """

    def __init__(self, engine: Engine, schema: T.StructType | str, keys, clustered: bool = False):
        self.engine, self.schema, self.keys, self.clustered = engine, as_schema(schema), as_columns(keys), clustered
        self._relation = Relation.empty(engine, self.schema)
        self._relation._count = 0

    @classmethod
    def of(cls, relation: Relation, keys, clustered: bool = False) -> SecondaryIndex:
        out = cls(relation.engine, relation.schema, keys, clustered)
        out.insert(relation)
        return out

    def insert(self, rows: Relation | DataFrame) -> None:
        rows = rows if isinstance(rows, Relation) else Relation(self.engine, rows)
        self._relation = rows if self._relation._count == 0 else self._relation.merge(rows)
        if self.clustered:
            self._relation = Relation(self.engine, self._relation.df.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys), distinct=True).stored()

    def insert_rows(self, rows: Iterable) -> None:
        self.insert(Relation.from_rows(self.engine, rows, self.schema))

    def lookup(self, *key) -> Relation:
        """Tuples of a key; empty if there is none."""
        return Relation(self.engine, self._relation.df.where(tuple_equals(self.keys, key)), distinct=True)

    def get(self, *key) -> Relation | None:
        """Tuples of a key, or None if there is none."""
        found = self.lookup(*key)
        return None if found.is_empty() else found

    def get_range(self, low, high) -> Relation:
        """Tuples with low <= key <= high, both included; none if high is below low."""
        low, high = ((x if isinstance(x, (tuple, list)) else (x,)) for x in (low, high))
        return Relation(self.engine, self._relation.df.where(tuple_between(self.keys, low, high)), distinct=True)
