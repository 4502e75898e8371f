"""Joins of relations and delta joins of variables.

Rules are written as expressions over the sides ``l`` and ``r``. Keys are compared by
ordinary equality, so a null key joins nothing; Catalyst picks the physical join.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_columns
from .relation import Relation
from .variable import Variable

Keys = str | Iterable[str] | Mapping[str, str] | Column


def _condition(on: Keys) -> Column:
    if isinstance(on, Column):
        return on
    pairs = on.items() if isinstance(on, Mapping) else [(k, k) for k in ([on] if isinstance(on, str) else on)]
    out = None
    for a, b in pairs:
        one = F.col(f"l.`{a}`") == F.col(f"r.`{b}`")
        out = one if out is None else out & one
    if out is None:
        raise ValueError("a join needs a key")
    return out


def _join(left: DataFrame, right: DataFrame, on: Keys, select, how: str = "inner") -> DataFrame:
    joined = left.alias("l").join(right.alias("r"), _condition(on), how)
    return joined.select(*as_columns(select)) if select is not None else joined.select("l.*")


def join_helper(left: Relation, right: Relation, on: Keys, select) -> Relation:
    """Inner join on key columns; ``on`` may also be any condition over l and r.

    A condition can match most pairs, so its result isn't compared as a whole: a tuple can only
    come twice where a side has several tuples with the columns that are selected.
    """
    sides = _sides(select) if isinstance(on, Column) else None
    if sides is None:
        return Relation(left.engine, _join(left.df, right.df, on, select))
    (one, many), (other, others) = (_split(rel.df, names) for rel, names in zip((left, right), sides))
    again = _spread(many, right.df, on, select).union(_spread(one, others, on, select)).distinct()
    return Relation(left.engine, _spread(one, other, on, select).union(again), distinct=True)


def _spread(left: DataFrame, right: DataFrame, on: Column, select, parts: int = 16) -> DataFrame:
    """A join in which each tuple of ``left`` meets shares of ``right``, so that a frequent value is several tasks' work."""
    left = left.withColumn("_part", F.explode(F.array(*[F.lit(i) for i in range(parts)])))
    right = right.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in right.columns]), F.lit(parts)).cast("int"))
    return _join(left, right, on & F.expr("l._part = r._part"), select)


def _sides(select) -> list[list[str]] | None:
    """Columns of l and of r that a selection takes as they are; None if it has anything else."""
    found = [re.fullmatch(r"\s*([lr])\.(\w+)(\s+AS\s+\w+)?\s*", s, re.IGNORECASE) if isinstance(s, str) else None for s in ([select] if isinstance(select, str) else select or [None])]
    sides = None if None in found else [[m[2] for m in found if m[1].lower() == side] for side in "lr"]
    return sides if sides and all(sides) else None


def _split(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tuples that have the named columns alone, and those that share them with others."""
    if set(df.columns) <= set(names):
        return df, df.where("false")
    marked = df.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy(*names)) > 1)
    return marked.where("NOT _many").drop("_many"), marked.where("_many").drop("_many")


def anti_join(left: Relation, right: Relation, on: Keys) -> Relation:
    """Tuples of ``left`` without a match in ``right``; a null key matches nothing."""
    return Relation(left.engine, _join(left.df, right.df, on, None, "left_anti"), distinct=True)


def semi_join(left: Relation, right: Relation, on: Keys, select=None) -> Relation:
    """Tuples of ``left`` with a match in ``right``."""
    return Relation(left.engine, _join(left.df, right.df, on, select, "left_semi"), distinct=select is None)


def join_into(left: Variable, right: Variable, on: Keys, select, out: Variable) -> None:
    """Delta join: what new tuples of either side add; stable never meets stable."""
    parts = []
    if left.recent_count and (right.recent_count or right.stable_count):
        parts.append(_join(left.recent, right.known, on, select))
    if left.stable_count and right.recent_count:
        parts.append(_join(left.stable, right.recent, on, select))
    if parts:
        out.insert(parts[0] if len(parts) == 1 else parts[0].union(parts[1]))


def join_anti(left: Variable, right: Variable, on: Keys, select, out: Variable) -> None:
    """New tuples of ``left`` whose key no known tuple of ``right`` has.

    Only what ``right`` has now counts and nothing is taken back later, so ``right`` should
    be complete first. ``on`` may name any number of columns, all of them for a whole-tuple
    difference. A null key matches nothing, so its tuples are kept.
    """
    if left.recent_count:
        out.insert(_join(left.recent, right.known, on, select, "left_anti"))
