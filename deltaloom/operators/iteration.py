"""Iterations: variables that change together until none does."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import types as T

from ..engine import Engine
from ..errors import MaxIterationsExceeded
from .variable import Variable


class Iteration:
    """A group of variables with one round counter and, perhaps, a round limit."""

    def __init__(self, engine: Engine, max_iterations: int | None = None):
        self.engine = engine
        self.max_iterations = engine.max_iterations if max_iterations is None else max_iterations
        self.rounds = 0
        self.variables: list[Variable] = []

    def variable(self, schema: T.StructType | str) -> Variable:
        self.variables.append(Variable(self.engine, schema))
        return self.variables[-1]

    def begin(self) -> None:
        """Count a round, or raise if the limit is reached."""
        if self.max_iterations is not None and self.rounds >= self.max_iterations:
            raise MaxIterationsExceeded(f"{self.max_iterations} rounds")
        self.rounds += 1

    def changed(self) -> bool:
        """One round of every variable; whether any has new tuples.

        The limit is looked at first: beyond it this raises even if nothing would change.
        """
        self.begin()
        if len(self.variables) < 2 or self.engine.workers < 2:
            return any([v.changed() for v in self.variables])
        with ThreadPoolExecutor(min(self.engine.workers, len(self.variables))) as pool:
            return any(list(pool.map(Variable.changed, self.variables)))

    def reset(self) -> None:
        """Set the counter back; tuples stay."""
        self.rounds = 0

    def run(self, step: Callable[[], None]) -> int:
        """Apply rules until nothing changes; the number of rounds."""
        while self.changed():
            step()
        return self.rounds

    def release(self) -> None:
        for v in self.variables:
            v.release()
