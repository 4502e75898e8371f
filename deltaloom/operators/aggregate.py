"""Group-by over finished relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import as_columns
from .relation import Relation


def aggregate(relation: Relation, keys, **measures: str | Column) -> Relation:
    """One tuple per key; measures are aggregate expressions over the set of tuples.

    Equal tuples have been merged before, so a sum adds each distinct tuple once. An empty
    relation has no groups. Keys may be any expressions.
    """
    out = [(F.expr(m) if isinstance(m, str) else m).alias(n) for n, m in measures.items()]
    return Relation(relation.engine, relation.df.groupBy(*as_columns(keys)).agg(*out), distinct=True)


def fold(relation: Relation, keys, init: Column, step: Callable[[Column, Column], Column], name: str = "value") -> Relation:
    """Left fold of each group's tuples, in their order, by ``step(accumulator, tuple)``.

    For folds that no built-in aggregate says. A group's tuples are gathered in one row:
    use aggregate() where groups can be large.
    """
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in relation.df.columns])))
    return Relation(relation.engine, relation.df.groupBy(*as_columns(keys)).agg(F.aggregate(rows, init, step).alias(name)), distinct=True)
