"""Filters on live streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Most filters that `fan_out` takes as expressions.
MAX_EXPRESSIONS = 200
# Number of the folder with the stored matches, before those of all batches.
HISTORY = -1


def stream_filter(tx: DataFrame, matches: Column) -> DataFrame:
    """Matching transactions, whole; the same filter as for stored ones."""
    return tx.where(matches)


def fan_out(tx: DataFrame, subscriptions: dict[str, Column]) -> DataFrame:
    """Every transaction once for each subscription it matches, as column `sub_id`.

    One scan and no shuffle for all filters together. Each filter is an expression of its
    own, so work and plan grow with their number; beyond MAX_EXPRESSIONS they belong in
    `conditions.fan_out_table`.
    """
    if len(subscriptions) > MAX_EXPRESSIONS:
        raise ValueError(f"more than {MAX_EXPRESSIONS} filters: use conditions.fan_out_table")
    hits = F.array_compact(F.array(*[F.when(f, F.lit(s)) for s, f in subscriptions.items()]))
    return tx.withColumn("sub_id", F.explode(hits))


def match_counts(delivered: DataFrame) -> DataFrame:
    """Matches per subscription, also as a running count over a stream."""
    return delivered.groupBy("sub_id").agg(F.count("*").alias("matches"))


def dedupe_by_hash(tx: DataFrame, watermark: str | None = None) -> DataFrame:
    """One row per transaction hash; rows without a hash are all kept.

    Stored: the one with the lowest id (or height, where rows have no id yet);
    partial aggregation removes most copies before the shuffle. Stream: the first to
    arrive, remembered for `watermark`.
    """
    named, unnamed = tx.where("tx_hash IS NOT NULL"), tx.where("tx_hash IS NULL")
    if tx.isStreaming:
        delay = watermark or "1 hour"
        once = named.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["tx_hash"])
        return once.unionByName(unnamed.withWatermark("ts", delay))
    order = "tx_id" if "tx_id" in tx.columns else "height"
    first = named.groupBy("tx_hash").agg(F.min_by(F.struct(*tx.columns), order).alias("_first"))
    return first.select("_first.*").unionByName(unnamed)


def not_delivered(batch: DataFrame, delivered: DataFrame) -> DataFrame:
    """Rows of a batch whose hash is not among those delivered.

    A hash has one height, so only the heights of the batch are read; stored
    tables skip the rest by their statistics.
    """
    low, high = batch.agg(F.min("height"), F.max("height")).first()
    if low is None:
        return batch
    overlap = delivered.where(F.col("height").between(low, high)).select("tx_hash")
    return batch.join(overlap, "tx_hash", "left_anti").select(*batch.columns)


def backfill_then_live(
    history: DataFrame, live: DataFrame, matches: Column, sink: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Stored matches first, then matches of the stream, each transaction once.

    Stored matches are written at once, whether or not the stream has anything: a
    Parquet folder of their own under `sink`, which a restart leaves as it is. Each
    batch then gets a folder; running it again replaces it. No state is kept and no
    late row is lost: repeats are found in what was delivered.
    """
    found = stream_filter(live, matches)
    stored = dedupe_by_hash(history.where(matches))
    stored.write.mode("ignore").parquet(f"{sink}/batch_id={HISTORY}")

    def deliver(batch: DataFrame, batch_id: int) -> None:
        once = dedupe_by_hash(batch).persist()
        try:
            earlier = batch.sparkSession.read.parquet(sink).where(F.col("batch_id") < batch_id)
            out = not_delivered(once, earlier)
            out.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        finally:
            once.unpersist()

    writer = found.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
