"""Dimension maintained from a stream of typed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.dimension import DimensionStore


def upsert_stream(
    events: DataFrame,
    store: DimensionStore,
    checkpoint: str,
    available_now: bool = False,
    every: str | None = None,
    stream: str | None = None,
) -> StreamingQuery:
    """Merges each micro-batch into the store. Each one that alters the dimension rewrites its folder,
    so `every` should be long.

    The commit record carries the stream's name and the batch id, so a batch that the engine delivers
    again after a failure is recognised and skipped. The name is the query's id, which the checkpoint
    holds: a new checkpoint is a new stream, and several streams may feed one store by turns.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        name = stream or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not name:
            raise RuntimeError("the engine names no query here: give `stream`")
        store.apply(batch, batch_id=batch_id, stream=name)

    writer = events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()
