"""Insert-only maintenance of a fixpoint from a stream of facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import Iteration, Variable


def feed(stream: DataFrame, iteration: Iteration, variable: Variable, step: Callable[[], None], after: Callable[[int], None] | None = None) -> DataStreamWriter:
    """A stream writer that adds each micro-batch to ``variable`` and runs to the fixpoint.

    Facts that are known already change nothing, so a batch that is delivered twice does no
    harm. ``after`` is called with the batch's number once it is worked in.
    """

    def batch(facts: DataFrame, number: int) -> None:
        facts.persist()
        variable.insert(facts)
        iteration.reset()
        iteration.run(step)
        facts.unpersist()
        if after:
            after(number)

    return stream.writeStream.foreachBatch(batch)
