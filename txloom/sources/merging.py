"""Merging of stored batches: many small folders become few, one per day.

A run takes the batches that are closed (all but the last, which a stream may run again) and
writes them once more: transactions, attributes and facts in a folder per day, each sorted as
its searches want it, and dictionaries sorted by key. The `days` table gets its rows last; until
then readers see the batches as they were. What a run replaces is deleted by the next run, so a
reader that began before it keeps its files for one period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.sources import store

# How a table is dealt out, and how its files are sorted. Frequent paths and values are
# split further by transaction.
LAYOUT = {
    "transactions": (("day", "tx_id"), ("day", "tx_id")),
    "attrs": (("day", "path", "tx_id"), ("day", "path", "unit", "qty_key")),
    "facts": (("day", "path_id", "value_id", "tx_id"), ("day", "path_id", "value_id")),
    "paths": (("path_id",), ("path_id",)),
    "values": (("value_hash",), ("value_hash",)),
    "rejected": (("reason", "value"), ("reason",)),
}


def merge_batches(spark: SparkSession, root: str) -> int:
    """Merge the closed batches that are not merged yet; the number of batches taken.

    Earlier merges of no more batches than the new one are taken into it. So there are at
    most about log2 as many merges as batches, and a row is rewritten as many times at most.
    Expired rows are left out. A run that was cut short is simply run again; only one may
    run at a time. Rows without a time have no day, and lie in a folder of their own.
    """
    merges = store.merges(spark, root)
    _delete_replaced(spark, root, merges)
    done = store.merged_to(merges)
    last = store._last_committed(spark, root)
    closed = None if last is None else store._last_committed(spark, root, last.batch_id)
    if closed is None or closed.batch_id <= done:
        return 0
    first, upto, taken = done + 1, closed.batch_id, []
    while merges and merges[-1].last_batch - merges[-1].first_batch <= upto - first:
        taken.insert(0, merges.pop())
        first = taken[0].first_batch
    limit = store.hidden_before(spark, root)

    def rows(table: str) -> DataFrame:
        return store.unexpired(store.stored(spark, root, table, taken, done, upto), table, limit)

    for table in store.MERGED:
        _write(rows(table), root, table, first, upto)
    written = store.read_merged(spark, root, "transactions", [store.Merge(first, upto, ())])
    per_day = written.groupBy("day").agg(
        F.count("*").alias("n_tx"),
        F.min("height").alias("first_height"),
        F.max("height").alias("last_height"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    # A merge without transactions is one all the same: there is always a row without a day.
    columns = per_day.columns
    here = spark.range(1).select(*[F.lit(0 if c == "n_tx" else None).alias(c) for c in columns])
    per_day.unionByName(here).select(*columns).coalesce(1).write.mode("overwrite").parquet(
        store.merge_folder(root, "days", first, upto)
    )
    return upto - done


def _write(rows: DataFrame, root: str, table: str, first: int, upto: int) -> None:
    by, order = LAYOUT[table]
    aging = table in store.AGING
    if aging:
        rows = rows.withColumn("day", store.day_of("ts"))
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*order)
    writer = dealt.write.mode("overwrite")
    if aging:
        writer = writer.partitionBy("day")
    store.with_blooms(writer, table).parquet(store.merge_folder(root, table, first, upto))


def _delete_replaced(spark: SparkSession, root: str, merges: list[store.Merge]) -> None:
    """Delete batches that a merge in force holds, and merges that another one holds or that
    were cut short."""
    done = store.merged_to(merges)
    for table in (*store.MERGED, "progress"):
        for name in store.folder_names(spark, f"{root}/{table}"):
            batch_id = int(name.removeprefix("batch_id=")) if name.startswith("batch_id=") else None
            # The next batch counts on from the progress of the last closed one.
            if batch_id is not None and (batch_id < done or batch_id == done and table != "progress"):
                store._delete(spark, f"{root}/{table}/{name}")
    in_force = {(f"first_batch={m.first_batch}", f"last_batch={m.last_batch}") for m in merges}
    for table in ("days", *store.MERGED):  # `days` first: without it a merge is not seen
        base = f"{root}/merged/{table}"
        for first in store.folder_names(spark, base):
            for last in store.folder_names(spark, f"{base}/{first}"):
                if last.startswith("last_batch=") and (first, last) not in in_force:
                    store._delete(spark, f"{base}/{first}/{last}")
