"""The stored tables: one Parquet folder each, with one sub-folder per batch.

A batch writes only its own sub-folders and overwrites them, so running it
again gives the same store. `progress` gets its row last: a batch without one
is not visible to readers. Rows carry the ingestion time, so expiry hides them
by a time filter at once and deletes whole batches once all of them is old.

Closed batches may be merged (`merging.merge_batches`) into folders per day, below `merged`.
Readers take merged batches from there and later ones from their own folders.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, Row, SparkSession
from pyspark.sql import functions as F

from txloom import model
from txloom.model import RETENTION_HOURS
from txloom.operators.attributes import explode_attributes, index_attributes
from txloom.operators.dictionary import (
    encode_attributes,
    path_keys,
    upsert_paths,
    upsert_values,
    value_keys,
)
from txloom.operators.delivery import height_range
from txloom.operators.retention import cutoff
from txloom.sources.messages import append_transactions

SCHEMAS = {
    "transactions": model.TX_DDL,
    "attrs": model.ATTRS_DDL,
    "paths": model.PATHS_DDL,
    "values": model.VALUES_DDL,
    "facts": model.FACTS_DDL,
    "rejected": "value string, reason string",
    "progress": (
        "n_tx long, last_tx_id long, last_path_id long, last_value_id long, "
        "first_ts timestamp, last_ts timestamp"
    ),
    "retention": "cutoff timestamp",
}
# Tables whose rows expire; the dictionaries only grow.
AGING = ("transactions", "attrs", "facts")
MERGED = (*AGING, "paths", "values", "rejected")
# One row per merge and day, and one without a day, written when the merge is complete.
DAYS_DDL = "day long, n_tx long, first_height long, last_height long, first_ts timestamp, last_ts timestamp"
DAY_SECONDS = 86_400


def _folder(root: str, table: str, batch_id: int) -> str:
    return f"{root}/{table}/batch_id={batch_id}"


def _read(spark: SparkSession, root: str, table: str) -> DataFrame:
    schema = SCHEMAS[table] + ", batch_id long"
    try:
        return spark.read.schema(schema).parquet(f"{root}/{table}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def with_blooms(writer: DataFrameWriter, table: str) -> DataFrameWriter:
    if table in ("attrs", "values"):
        # Point searches by fingerprint skip row groups.
        writer = writer.option("parquet.bloom.filter.enabled#value_hash", "true")
    return writer


def _write(df: DataFrame, root: str, table: str, batch_id: int) -> None:
    with_blooms(df.write.mode("overwrite"), table).parquet(_folder(root, table, batch_id))


def _hadoop(spark: SparkSession, folder: str):
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()), path


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it does not exist."""
    files, path = _hadoop(spark, folder)
    return [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []


def _last_committed(spark: SparkSession, root: str, before: int | None = None) -> Row | None:
    """`progress` of the last batch (before some other), with its `batch_id`.

    From the folder names, so only one small file is read however many there are.
    """
    names = folder_names(spark, f"{root}/progress")
    ids = sorted((int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id=")), reverse=True)
    for batch_id in ids:
        if before is None or batch_id < before:
            rows = spark.read.schema(SCHEMAS["progress"]).parquet(_folder(root, "progress", batch_id))
            # A folder whose writing was cut short has no row yet.
            row = rows.withColumn("batch_id", F.lit(batch_id)).first()
            if row is not None:
                return row
    return None


class Merge(NamedTuple):
    """Batches from first to last, merged; `days` are its rows of the `days` table."""

    first_batch: int
    last_batch: int
    days: tuple[Row, ...]


def day_of(ts: str) -> Column:
    """Days since 1970, in UTC whatever the session's time zone."""
    return F.floor(F.unix_seconds(ts) / DAY_SECONDS).cast("long")


def merge_folder(root: str, table: str, first: int, last: int) -> str:
    return f"{root}/merged/{table}/first_batch={first}/last_batch={last}"


def merges(spark: SparkSession, root: str) -> list[Merge]:
    """The merges in force, oldest first: they follow each other without a gap.

    One whose writing was cut short has no rows in `days`; one that a wider merge holds is left
    out. There are a few rows per day of history.
    """
    if not folder_names(spark, f"{root}/merged/days"):
        return []
    found: dict[tuple[int, int], list[Row]] = {}
    schema = DAYS_DDL + ", first_batch long, last_batch long"
    for row in spark.read.schema(schema).parquet(f"{root}/merged/days").collect():
        found.setdefault((row.last_batch, -row.first_batch), []).append(row)
    chain: list[Merge] = []
    for (last, first), days in sorted(found.items(), reverse=True):
        # Of those that end at one batch the widest is in force, and sorted last.
        if chain and chain[-1].last_batch == last and -first < chain[-1].first_batch:
            chain[-1] = Merge(-first, last, tuple(days))
        elif not chain or last == chain[-1].first_batch - 1:
            chain.append(Merge(-first, last, tuple(days)))
    return chain[::-1]


def merged_to(merged: list[Merge]) -> int:
    return merged[-1].last_batch if merged else -1


def read_merged(spark: SparkSession, root: str, table: str, merged: list[Merge]) -> DataFrame:
    """Rows of some merges, with their `day` if the table ages."""
    schema = SCHEMAS[table] + (", day long" if table in AGING else "")
    if not merged:
        return spark.createDataFrame([], schema)
    folders = [merge_folder(root, table, m.first_batch, m.last_batch) for m in merged]
    ids = ", first_batch long, last_batch long"
    reader = spark.read.schema(schema + ids).option("basePath", f"{root}/merged/{table}")
    return reader.parquet(*folders).drop("first_batch", "last_batch")


def stored(
    spark: SparkSession,
    root: str,
    table: str,
    merged: list[Merge],
    after: int,
    upto: int,
    days: set[int | None] | None = None,
) -> DataFrame:
    """Rows of merges (of some `days`, or all), and of the batches after `after` up to `upto`
    from their own folders.

    Tables that age have a `day`, by which folders of merges are left out.
    """
    rows = _read(spark, root, table).where(F.col("batch_id").between(after + 1, upto)).drop("batch_id")
    if table in AGING:
        rows = rows.withColumn("day", day_of("ts"))
    if not merged:
        return rows
    old = read_merged(spark, root, table, merged)
    if days is not None:
        named = F.col("day").isin([day for day in days if day is not None])
        old = old.where(named | F.col("day").isNull() if None in days else named)
    return old.unionByName(rows)


def hidden_before(spark: SparkSession, root: str) -> datetime | None:
    return _read(spark, root, "retention").agg(F.max("cutoff")).first()[0]


def unexpired(rows: DataFrame, table: str, limit: datetime | None) -> DataFrame:
    """Rows of `stored` that have not expired, without `day`."""
    if table not in AGING:
        return rows
    if limit is not None:
        # The day says nothing new, but names the folders to read.
        limit = F.lit(limit)
        first_day = F.floor(F.unix_seconds(limit) / DAY_SECONDS)
        rows = rows.where((F.col("ts") >= limit) & (F.col("day") >= first_day))
    return rows.drop("day")


def _committed(
    spark: SparkSession, root: str, table: str, merged: list[Merge], days: set[int | None] | None = None
) -> DataFrame:
    last = _last_committed(spark, root)
    upto = -1 if last is None else last.batch_id
    # Tables that are not merged are in their batches' folders alone.
    held = merged if table in MERGED else []
    return stored(spark, root, table, held, merged_to(held), upto, days)


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Committed rows of a table that have not expired."""
    limit = hidden_before(spark, root) if table in AGING else None
    return unexpired(_committed(spark, root, table, merges(spark, root)), table, limit)


def read_heights(
    spark: SparkSession,
    root: str,
    table: str = "transactions",
    from_height: int | None = None,
    to_height: int | None = None,
) -> DataFrame:
    """Rows of `transactions` or `attrs` of the heights from … to …, both included.

    Of merged batches only days are read that hold such heights; later batches are read
    whole. Without limits it is `read_table`; else rows without a height are not among them.
    """
    merged = merges(spark, root)
    low = float("-inf") if from_height is None else from_height
    high = float("inf") if to_height is None else to_height
    days = None
    if from_height is not None or to_height is not None:
        days = {
            row.day
            for merge in merged
            for row in merge.days
            if row.first_height is not None and row.first_height <= high and row.last_height >= low
        }
    rows = _committed(spark, root, table, merged, days)
    return height_range(unexpired(rows, table, hidden_before(spark, root)), from_height, to_height)


def index_batch(spark: SparkSession, root: str, rows: DataFrame, batch_id: int) -> None:
    """Store one batch of `transaction_rows` as a repeatable step.

    Transactions and attributes are written and then read back; new ids are saved
    before anything refers to them.
    """
    last = _last_committed(spark, root, batch_id)
    last_tx, last_path, last_value = (
        (0, 0, 0) if last is None else (last.last_tx_id, last.last_path_id, last.last_value_id)
    )

    def written(table: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[table]).parquet(_folder(root, table, batch_id))

    merged = merges(spark, root)
    done = merged_to(merged)
    if batch_id <= done:
        raise ValueError(f"batch {batch_id} is closed: batches up to {done} are merged")

    def known(table: str) -> DataFrame:
        return stored(spark, root, table, merged, done, batch_id - 1)

    _write(append_transactions(rows, last_tx), root, "transactions", batch_id)
    tx = written("transactions")

    exploded = explode_attributes(tx, ("tx_id", "height", "ts"))
    # Whole paths lie together, split further by transaction where a path is
    # frequent; inside a file the quantities are in order.
    clustered = index_attributes(exploded.repartitionByRange("path", "tx_id"))
    clustered = clustered.sortWithinPartitions("path", "unit", "qty_key")
    _write(clustered, root, "attrs", batch_id)
    attrs = written("attrs")

    # Of the dictionaries only the rows of this batch are needed from here on.
    paths = upsert_paths(path_keys(tx), known("paths"), last_path)
    _write(paths.new, root, "paths", batch_id)
    values = upsert_values(value_keys(attrs), known("values"), last_value)
    _write(values.new, root, "values", batch_id)
    dictionaries = paths.with_new(written("paths")), values.with_new(written("values"))
    _write(encode_attributes(attrs, *dictionaries, ("tx_id", "ts")), root, "facts", batch_id)

    def highest(table: str, id_col: str, before: int):
        # From the footers of the few files that the batch has just written.
        return F.coalesce(written(table).agg(F.max(id_col)).scalar(), F.lit(before)).cast("long")

    progress = tx.agg(
        F.count("*").alias("n_tx"),
        F.coalesce(F.max("tx_id"), F.lit(last_tx)).alias("last_tx_id"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    ).select(
        "n_tx",
        "last_tx_id",
        highest("paths", "path_id", last_path).alias("last_path_id"),
        highest("values", "value_id", last_value).alias("last_value_id"),
        "first_ts",
        "last_ts",
    )
    _write(progress, root, "progress", batch_id)


def write_rejected(root: str, rejected: DataFrame, batch_id: int) -> None:
    _write(rejected.select("value", "reason"), root, "rejected", batch_id)


def expire_store(
    spark: SparkSession, root: str, now: datetime | Column | None = None, hours: int = RETENTION_HOURS
) -> int:
    """Hide transactions older than `hours` and delete batches that an earlier run hid.

    A reader that began before this run may still be at what it hides, so the folders of a
    batch go only once the cutoff of an earlier run had passed it. No rows are scanned or
    rewritten: the times of each batch are in `progress`. Returns the number of batches
    deleted. Merged batches go day by day, and days count as batches do.
    """
    moment = F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)
    earlier = _read(spark, root, "retention")
    limit = (
        spark.range(1)
        .select(cutoff(moment, hours).cast("timestamp").alias("cutoff"))
        .unionByName(earlier.select("cutoff"))
        .agg(F.max("cutoff").alias("cutoff"))  # never moves back
        .withColumn("run", F.unix_seconds("cutoff"))
        .first()
    )
    hidden = earlier.where(F.col("cutoff") < F.lit(limit.cutoff)).agg(F.max("cutoff")).first()[0]
    if not earlier.where(F.col("cutoff") == F.lit(limit.cutoff)).take(1):
        marker = spark.createDataFrame([(limit.cutoff,)], "cutoff timestamp")
        _write(marker, root, "retention", limit.run)
        # Markers of a day ago, which no reader can still be at, serve no more.
        for row in earlier.where(F.col("batch_id") < limit.run - 86_400).select("batch_id").toLocalIterator():
            _delete(spark, _folder(root, "retention", row.batch_id))

    last = _last_committed(spark, root)
    if last is None or hidden is None:
        return 0
    # The last batch stays known, because the next one counts on from it; and so does the
    # progress of the one before, from which the last one counts if it is run again.
    before = _last_committed(spark, root, last.batch_id)
    batches = _read(spark, root, "progress").where(F.col("batch_id") < last.batch_id)
    old = batches.where(F.col("last_ts") < F.lit(hidden)).select("batch_id").distinct()
    deleted = 0
    for row in old.toLocalIterator():
        gone = [_delete(spark, _folder(root, table, row.batch_id)) for table in AGING]
        if row.batch_id != before.batch_id:
            _delete(spark, _folder(root, "progress", row.batch_id))
        deleted += any(gone)
    for merge in merges(spark, root):
        folders = [merge_folder(root, table, merge.first_batch, merge.last_batch) for table in AGING]
        left = {folder: set(folder_names(spark, folder)) for folder in folders}
        for row in merge.days:
            name = f"day={row.day}"
            held = [folder for folder in folders if name in left[folder]]
            if held and row.last_ts < hidden:
                for folder in held:
                    _delete(spark, f"{folder}/{name}")
                deleted += 1
    return deleted


def _delete(spark: SparkSession, folder: str) -> bool:
    """Whether there was such a folder."""
    files, path = _hadoop(spark, folder)
    return files.delete(path, True)
