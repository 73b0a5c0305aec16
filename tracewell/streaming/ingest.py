"""Structured Streaming into the store: micro-batches of kept rows are appended under the batch's number.

An extension: replayed batches write the same numbers, and reads keep one row a key, so the store is exactly-once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tracewell.sources.store import STAMP, ParquetStore


def ingest(stream: DataFrame, store: ParquetStore, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    def batch(df: DataFrame, number: int) -> None:
        store.append({table: df.drop(STAMP)}, number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
