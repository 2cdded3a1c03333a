"""New objects as a stream: each micro-batch computes what is missing and adds it to the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from asterweave.operators.cache import HashedStore


def refresh_stream(objects: DataFrame, store: HashedStore, compute: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Start a query that keeps the store up to date with a stream of objects; it ends when the input is used up.

    A batch that is delivered again finds its results in the store, so a restart
    adds nothing twice. Repeated objects within a batch are computed once.
    """

    def add(batch: DataFrame, _: int) -> None:
        distinct = batch.dropDuplicates(store.keys)
        if not distinct.isEmpty():
            store.refreshed(distinct, compute)

    return objects.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
