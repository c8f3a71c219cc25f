"""Structured Streaming into containers: each micro-batch is one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrane.operators.container import Container
from terrane.operators.pyramid import latest


def upsert_batches(container: Container, table: str, key: list[str], order: Column) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts the last row of each key into a table.

    The batch number is kept with the commit, so a batch that is replayed after a failure changes nothing.  A batch
    is written as an upsert is: geometries are encoded, bounds grow, nulls are refused, and nothing is rewritten.
    """

    def put(batch: DataFrame, number: int) -> None:
        done = container.state["specs"].get("_stream", {}).get(table, -1)
        if number <= done:
            return
        marked = {"_stream": {**container.state["specs"].get("_stream", {}), table: number}}
        own = [c for c in batch.columns if c in container.table(table).columns]
        container.upsert(table, latest(batch, key, order).select(*own), key, specs=marked)

    return put


def stream_into(stream: DataFrame, container: Container, table: str, key: list[str], order: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start writing a stream into a table of the container."""
    writer = stream.writeStream.foreachBatch(upsert_batches(container, table, key, F.col(order))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tile_activity(events: DataFrame, time: str, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events that carry a tile address, counted by address and event-time window; late ones up to the watermark count."""
    return events.withWatermark(time, watermark).groupBy(F.window(time, window), "zoom_level", "tile_column", "tile_row").agg(F.count(F.lit(1)).alias("n"))
