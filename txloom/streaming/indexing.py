"""Continuous indexing, expiry and block heights."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from txloom.model import RETENTION_HOURS, RETENTION_PERIOD
from txloom.sources.merging import merge_batches
from txloom.sources.messages import (
    block_headers,
    decode_messages,
    height_span,
    parse_messages,
    route_by_type,
    split_messages,
    transaction_rows,
)
from txloom.sources.store import expire_store, index_batch, write_rejected


def stream_index(
    raw: DataFrame,
    root: str,
    checkpoint: str,
    arrival: Column | None = None,
    merge_every: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Index a stream of raw messages; each micro-batch is one repeatable step.

    The parsed batch is kept while it is stored, as several jobs read it; a lost
    part is parsed again from the source. After every `merge_every` batches those before the
    current one are merged.
    """
    if merge_every is not None and merge_every < 1:
        raise ValueError("merge_every must be at least 1")

    def step(batch: DataFrame, batch_id: int) -> None:
        decoded = decode_messages(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            accepted, rejected = split_messages(decoded)
            txs, _ = route_by_type(accepted)
            write_rejected(root, rejected, batch_id)
            index_batch(batch.sparkSession, root, transaction_rows(txs, arrival), batch_id)
            if merge_every is not None and (batch_id + 1) % merge_every == 0:
                merge_batches(batch.sparkSession, root)
        finally:
            decoded.unpersist()

    writer = raw.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_heights(raw: DataFrame, arrival: str | Column) -> DataFrame:
    """Earliest and latest block height of a message stream (complete mode)."""
    accepted, _ = parse_messages(raw)
    _, blocks = route_by_type(accepted)
    name = arrival if isinstance(arrival, str) else "_arrival"
    if not isinstance(arrival, str):
        blocks = blocks.withColumn("_arrival", arrival)
    return height_span(block_headers(blocks, (name,)), name)


def stream_retention(
    spark: SparkSession,
    root: str,
    checkpoint: str,
    hours: int = RETENTION_HOURS,
    every: str | None = RETENTION_PERIOD,
    now: Column | None = None,
) -> StreamingQuery:
    """Expire the store now and then every hour.

    Without a period it runs once more and ends; `now` stands for the current time.
    """
    expire_store(spark, root, now, hours)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def step(batch: DataFrame, batch_id: int) -> None:
        expire_store(batch.sparkSession, root, now, hours)

    writer = ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    trigger = {"once": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()
