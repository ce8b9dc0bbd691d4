"""Event maps, exploded attributes and the parts of an execution result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.functions import values as V
from txloom.model import LOG_DDL, LOG_OTHER_DDL


def explode_attributes(tx: DataFrame, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """One row per value: path, place in its list, value. Duplicates stay."""
    return tx.select(*keep, F.explode("events").alias("path", "_values")).select(
        *keep, "path", F.posexplode("_values").alias("val_ord", "value")
    )


def index_attributes(attrs: DataFrame) -> DataFrame:
    """Add what searches compare: digits, order key, unit and fingerprint.

    Digits come as a generated row, which later filters on them, their key or their unit cannot
    pass: pushed down they would match the pattern again for every place that names one.
    """
    kept = [c for c in attrs.columns if c != "qty_text"]
    return (
        attrs.select(*kept, F.explode(F.array(V.quantity_text("value"))).alias("qty_text"))
        .withColumn("qty_key", V.quantity_key("qty_text"))
        .withColumn("unit", V.unit_after("value", "qty_text"))
        .withColumn("value_hash", V.value_fingerprint("value"))
    )


def build_event_map(attrs: DataFrame, together: bool = False) -> DataFrame:
    """Values back in lists by path, one map per transaction.

    Partitioned by transaction once; both groupings then work in place. With `together` the
    rows come so already, from a join or grouping by `tx_id`, and are not shuffled again; of
    other rows it gives the same maps by two shuffles. A map is one cell of one row, no larger
    than the message it came from.
    """
    rows = attrs.select("tx_id", "path", "val_ord", "value")
    rows = rows if together else rows.repartition("tx_id")
    by_path = (
        rows.groupBy("tx_id", "path")
        .agg(F.array_sort(F.collect_list(F.struct("val_ord", "value"))).alias("_ordered"))
        .select("tx_id", F.struct("path", F.col("_ordered.value").alias("values")).alias("_entry"))
    )
    return by_path.groupBy("tx_id").agg(F.map_from_entries(F.collect_list("_entry")).alias("events"))


def flatten_result_events(tx: DataFrame, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """Attributes of `result.events`, under the path `type.key`."""
    events = tx.select(*keep, F.posexplode("result.events").alias("event_no", "_event"))
    attributes = events.select(
        *keep, "event_no", F.col("_event.type").alias("_type"), F.explode("_event.attributes").alias("_a")
    )
    return attributes.select(
        *keep,
        "event_no",
        F.concat_ws(".", "_type", "_a.key").alias("path"),
        F.col("_a.value").alias("value"),
        F.coalesce("_a.index", F.lit(False)).alias("indexed"),
    )


def parse_logs(tx: DataFrame, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """One row per log entry: its events and its other fields.

    A log that is not a JSON array gives one row with the text itself in `plain`.
    """
    log = F.col("result.log")
    is_array = log.rlike(r"^\s*\[")
    parsed = tx.select(
        *keep,
        log.alias("_log"),
        F.when(is_array, F.from_json(log, LOG_DDL)).alias("_entries"),
        F.when(is_array, F.from_json(log, LOG_OTHER_DDL)).alias("_fields"),
    ).where("_log IS NOT NULL")
    rows = parsed.withColumn("_pairs", F.arrays_zip("_entries", "_fields"))
    # An empty array is JSON, only without entries.
    rows = rows.where("_entries IS NULL OR size(_entries) > 0")
    return rows.select(
        *keep,
        F.posexplode_outer("_pairs").alias("log_no", "_pair"),
        F.when(F.col("_entries").isNull(), F.col("_log")).alias("plain"),
    ).select(
        *keep,
        F.coalesce("log_no", F.lit(0)).alias("log_no"),
        F.col("_pair._entries.events").alias("events"),
        F.map_filter("_pair._fields", lambda k, _: k != "events").alias("other"),
        "plain",
    )


def log_attributes(logs: DataFrame, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """Attributes of the events of parsed log entries."""
    events = logs.select(*keep, "log_no", F.explode("events").alias("_event"))
    return events.select(
        *keep, "log_no", F.col("_event.type").alias("_type"), F.explode("_event.attributes").alias("_a")
    ).select(
        *keep,
        "log_no",
        F.concat_ws(".", "_type", "_a.key").alias("path"),
        F.col("_a.value").alias("value"),
    )


def distinct_paths(tx: DataFrame) -> DataFrame:
    """Paths that occur, also those with an empty list."""
    return tx.select(F.explode(F.map_keys("events")).alias("path")).distinct()


def distinct_values(attrs: DataFrame) -> DataFrame:
    return attrs.select("value").where("value IS NOT NULL").distinct()
