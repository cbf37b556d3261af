"""A stream of operations into a store: each micro-batch is one atomic commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalog.sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, order_by: str = "seq", available_now: bool = True, name: str | None = None) -> StreamingQuery:
    """Write a stream with user_key, kind, value, expiry_ns and an order to a store.

    The number of a micro-batch is published in the same manifest edit as its rows, under the stream's ``name`` (by
    default its checkpoint folder, as numbers begin anew with a new one). A micro-batch that is run again after a
    failure is therefore written once.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.write_frame(batch.withColumn("op_index", F.col(order_by)), (name or checkpoint, number))

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
