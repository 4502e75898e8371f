"""Recursive programs built from the operators."""

from .closure import extend_closure, reachable_from, same_generation, transitive_closure
from .strata import stratify

__all__ = ["extend_closure", "reachable_from", "same_generation", "stratify", "transitive_closure"]
