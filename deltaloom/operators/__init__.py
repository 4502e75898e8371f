"""Relations, semi-naive variables, fixpoints, joins, extensions, aggregates, indices."""

from .aggregate import aggregate, fold
from .extend import ExtendAnti, ExtendWith, FilterAnti, Leaper, extend_into
from .index import SecondaryIndex
from .iteration import Iteration
from .joins import anti_join, join_anti, join_helper, join_into, semi_join
from .relation import Relation
from .variable import Variable

__all__ = ["ExtendAnti", "ExtendWith", "FilterAnti", "Iteration", "Leaper", "Relation", "SecondaryIndex", "Variable", "aggregate", "anti_join", "extend_into", "fold", "join_anti", "join_helper", "join_into", "semi_join"]
