"""Extension of tuples by values on which several relations agree.

A source tuple is ``t`` and a value ``v`` in all expressions. Each leaper is one relation's
say: it can propose values for a tuple, keep only values it knows, or exclude. One call
becomes one plan: the relation with the fewest rows proposes through a join, all other
proposers become semi joins, exclusions anti joins, so the intermediate result never
outgrows one relation's proposals.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_columns
from .relation import Relation
from .variable import Variable


class Leaper:
    """Base of user-written leapers; frames have the columns ``t`` (a struct) and ``v``.

    ``count`` is a hint: the leaper with the smallest proposes.
    """

    proposes = False

    def count(self) -> int:
        return 1 << 62

    def counted(self, tuples: DataFrame, name: str) -> DataFrame:
        """The tuples with the number of values proposed for each as one more column."""
        return tuples.withColumn(name, F.lit(self.count()))

    def filter(self, tuples: DataFrame) -> DataFrame:
        """Source tuples that may be extended at all."""
        return tuples

    def propose(self, tuples: DataFrame) -> DataFrame:
        raise NotImplementedError

    def intersect(self, pairs: DataFrame) -> DataFrame:
        return pairs


def _side(rel: Relation, key: Mapping[str, str], value: str | None) -> tuple[DataFrame, list]:
    names = [f"_k{i}" for i in range(len(key))]
    columns = [F.col(f"`{c}`").alias(n) for c, n in zip(key, names)]
    if value is not None:
        columns.append(F.col(f"`{value}`").alias("_v"))
    return rel.df.select(*columns), [F.expr(e) == F.col(n) for e, n in zip(key.values(), names)]


def _both(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


class ExtendWith(Leaper):
    """Values that ``relation`` holds with a tuple's key.

    ``key`` maps the relation's columns to expressions over ``t``; ``value`` is the column
    of values.
    """

    proposes = True

    def __init__(self, relation: Relation, key: Mapping[str, str], value: str):
        self.relation, self.key, self.value = relation, key, value

    def count(self) -> int:
        return self.relation.count()

    def counted(self, tuples: DataFrame, name: str) -> DataFrame:
        side, on = _side(self.relation, self.key, self.value)
        side = side.distinct().groupBy(*[c for c in side.columns if c != "_v"]).agg(F.count(F.lit(1)).alias("_n"))
        return tuples.join(side, _both(on), "left").select(tuples["*"], F.coalesce("_n", F.lit(0)).alias(name))

    def propose(self, tuples: DataFrame) -> DataFrame:
        side, on = _side(self.relation, self.key, self.value)
        return tuples.join(side, _both(on)).select("t", F.col("_v").alias("v"))

    def intersect(self, pairs: DataFrame) -> DataFrame:
        side, on = _side(self.relation, self.key, self.value)
        return pairs.join(side, _both([*on, F.col("v") == F.col("_v")]), "left_semi")


class FilterAnti(Leaper):
    """Drops source tuples whose key ``relation`` has; proposed values aren't seen."""

    def __init__(self, relation: Relation, key: Mapping[str, str]):
        self.relation, self.key = relation, key

    def filter(self, tuples: DataFrame) -> DataFrame:
        side, on = _side(self.relation, self.key, None)
        return tuples.join(side, _both(on), "left_anti")


class ExtendAnti(Leaper):
    """Drops values that ``relation`` holds with a tuple's key; never proposes."""

    def __init__(self, relation: Relation, key: Mapping[str, str], value: str):
        self.relation, self.key, self.value = relation, key, value

    def intersect(self, pairs: DataFrame) -> DataFrame:
        side, on = _side(self.relation, self.key, self.value)
        return pairs.join(side, _both([*on, F.col("v") == F.col("_v")]), "left_anti")


def _extended(tuples: DataFrame, first: Leaper, leapers: list[Leaper]) -> DataFrame:
    pairs = first.propose(tuples)
    for x in leapers:
        if x is not first:
            pairs = x.intersect(pairs)
    return pairs.select("t", "v")


def extend_into(source: Variable, leapers: list[Leaper], select, out: Variable, by_tuple: bool = False) -> None:
    """Extend the source's recent tuples by every value that all leapers admit.

    Without a leaper that proposes there are no values, so nothing is added. With
    ``by_tuple`` each tuple's values are proposed by the leaper that has the fewest for
    that tuple, the first of equals: more joins, but the bound of a worst-case-optimal join
    where relations are skewed differently.
    """
    proposers = [x for x in leapers if x.proposes]
    if not proposers or not source.recent_count:
        return
    tuples = source.recent.select(F.struct("*").alias("t"))
    for x in leapers:
        tuples = x.filter(tuples)
    if by_tuple and len(proposers) > 1:
        names = [f"_n{i}" for i in range(len(proposers))]
        for x, name in zip(proposers, names):
            tuples = x.counted(tuples, name)
        fewest, parts = F.least(*names), []
        for i, x in enumerate(proposers):
            mine = (F.col(names[i]) == fewest) & (fewest > 0)
            for earlier in names[:i]:
                mine &= F.col(earlier) != fewest
            parts.append(_extended(tuples.where(mine).select("t"), x, leapers))
        pairs = reduce(DataFrame.union, parts)
    else:
        first = min(proposers, key=lambda x: x.count()) if len(proposers) > 1 else proposers[0]
        pairs = _extended(tuples, first, leapers)
    out.insert(pairs.select(*as_columns(select)))
