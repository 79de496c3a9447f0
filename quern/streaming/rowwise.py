"""An extension: steps that look at one row at a time, on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.plans import runner

#: Steps whose result for a row doesn't depend on other rows.
ROWWISE = ("noise_removal", "pii_scrubbing", "language_filter", "quality_scorer")


def apply(stream: DataFrame, steps: list[dict], sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Runs each micro-batch through the steps and gives it to ``sink(rows, batch number)``. A batch may come again after a failure, with the same number."""
    if other := [s["step"] for s in steps if runner.ALIASES.get(s["step"], s["step"]) not in ROWWISE]:
        raise ValueError(f"not for streams: {', '.join(other)}")
    return stream.writeStream.foreachBatch(lambda df, k: sink(runner.run(df, steps).df, k)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
