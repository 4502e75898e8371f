"""Variables of semi-naive evaluation: known, newest and pending tuples."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..engine import Engine
from .relation import Relation, as_schema, same_schema


class Variable:
    """A growing relation split into ``stable``, ``recent`` and pending tuples.

    Each round's new tuples are written once, as a batch of the shared workspace; stable
    tuples are one scan over all earlier batches, which never overlap. As soon as
    ``engine.fold_at`` batches have been folded equally often they are folded into one, so
    that a scan has few batches and a tuple is written few times (both follow the logarithm
    of the rounds). Plans stay small in any number of rounds and lost executors lose nothing.
    """

    def __init__(self, engine: Engine, schema: T.StructType | str):
        self.engine, self.schema = engine, as_schema(schema)
        self._stable: list[tuple[str, int]] = []
        self._recent: tuple[str, int] | None = None
        self._pending: list[Relation] = []
        self._sure = False  # whether what is pending needs no comparison
        self._folds: list[int] = []  # how often each stable batch has been folded
        self._folded: list[str] = []  # batches that others hold now; frames may still read them

    def insert(self, rows: Relation | DataFrame) -> None:
        """Add tuples; they are seen only from the next changed() on."""
        rows = rows if isinstance(rows, Relation) else Relation(self.engine, rows)
        same_schema(rows.df, self.schema)
        self._pending.append(rows)
        self._sure = False

    def insert_new(self, rows: DataFrame) -> None:
        """Add tuples known to differ from each other and from all others: they are written as they are."""
        same_schema(rows, self.schema)
        self._sure = not self._pending
        self._pending.append(Relation(self.engine, rows, distinct=True))

    def insert_rows(self, rows: Iterable) -> None:
        self.insert(Relation.from_rows(self.engine, rows, self.schema))

    @property
    def recent(self) -> DataFrame:
        return self._read([self._recent] if self._recent else [])

    @property
    def stable(self) -> DataFrame:
        return self._read(self._stable)

    @property
    def known(self) -> DataFrame:
        """Stable and recent tuples."""
        return self._read(self._stable + ([self._recent] if self._recent else []))

    @property
    def recent_count(self) -> int:
        return self._recent[1] if self._recent else 0

    @property
    def stable_count(self) -> int:
        return sum(n for _, n in self._stable)

    def _read(self, batches: list[tuple[str, int]]) -> DataFrame:
        return self.engine.read([p for p, n in batches if n], self.schema)

    def changed(self) -> bool:
        """Make recent tuples stable and pending ones, less those known, recent."""
        if self._recent:
            self._stable.append(self._recent)
            self._folds.append(0)
            self._recent = None
            self._fold()
        if not self._pending:
            return False
        new = reduce(DataFrame.union, [r.df for r in self._pending])
        self._pending = []
        path, n = self.engine.write(new if self._sure else self._unknown(new) if self._stable else new.distinct())
        if n:
            self._recent = path, n
        return bool(n)

    def _fold(self) -> None:
        """Fold the last batches into one while so many of them have been folded equally often."""
        most = self.engine.fold_at
        while len(self._folds) >= most and self._folds[-most] == self._folds[-1]:
            path, n = self.engine.write(self._read(self._stable[-most:]).coalesce(self.engine.spark.sparkContext.defaultParallelism))
            self._folded += [p for p, _ in self._stable[-most:]]
            self._stable[-most:], self._folds[-most:] = [(path, n)], [self._folds[-1] + 1]

    def _unknown(self, new: DataFrame) -> DataFrame:
        """Candidates that no stable tuple equals, each once; nulls equal each other.

        A subtraction shuffles all stable tuples. Where these are many and the candidates,
        once written and counted, few, the stable batches are scanned in place against the
        candidates instead, and only what was found is subtracted.
        """
        if self.stable_count < self.engine.probe_from:
            return new.subtract(self.stable)
        path, n = self.engine.write(new.distinct())
        new = self.engine.read([path], self.schema)
        if n > self.engine.probe_most:
            return new.subtract(self.stable)
        s, c = self.stable.alias("s"), F.broadcast(new.alias("c"))
        same = reduce(lambda a, b: a & b, [F.col(f"s.`{f}`").eqNullSafe(F.col(f"c.`{f}`")) for f in new.columns])
        return new.subtract(s.join(c, same, "left_semi"))

    def total_len(self) -> int:
        """Stable, recent and pending tuples; pending ones count though known already."""
        return self.stable_count + self.recent_count + sum(r.count() for r in self._pending)

    def complete(self) -> Relation:
        """All tuples as one relation; the variable is empty afterwards."""
        done = self.known
        pending, batches = self._pending, self._stable + ([self._recent] if self._recent else [])
        self._stable, self._recent, self._pending, self._folds = [], None, [], []
        if not pending:
            out = Relation(self.engine, done, distinct=True)
            out._count = sum(n for _, n in batches)
            return out
        return Relation(self.engine, reduce(DataFrame.union, [done, *[r.df for r in pending]]))

    def release(self) -> None:
        """Delete the batches; frames made from them can't be read any more."""
        self.engine.remove([p for p, _ in self._stable + ([self._recent] if self._recent else [])] + self._folded)
        self._stable, self._recent, self._pending, self._folds, self._folded = [], None, [], [], []
