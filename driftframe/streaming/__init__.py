"""Comparisons are of two bounded frames. A stream is compared batch by batch, in ``foreachBatch``, with ``each_batch``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from driftframe.api import Config, diff


def each_batch(right: Callable[[int], DataFrame], config: Config, use: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for ``writeStream.foreachBatch``: the counts of each micro-batch against ``right(batch id)`` go to ``use``."""

    def run(batch: DataFrame, number: int) -> None:
        use(diff(batch, right(number), config).counts(), number)

    return run
