"""Serial ids and row positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txloom.session import shared_folder

# Digest characters that make a bucket in `assign_ids_by_hash`; in base64 that is
# at most 64 ** 3 = 262,144 buckets.
_PREFIX = 3
# Rows per bucket of `row_positions`, and buckets per group.
_BITS = 20


def free_names(columns: list[str], *names: str) -> list[str]:
    """`names`, each with underscores before it until none of `columns` (in any case) is it."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def assign_ids(df: DataFrame, order_by: list, id_col: str, start: int | Column = 0) -> DataFrame:
    """Add `id_col` = start + 1, start + 2, … in the given order.

    Range-sorts on the whole order (a frequent first column is split by the
    later ones) and saves the sorted rows with their partition and place in it,
    so the numbering cannot shift when a task is run again; offsets then come
    from one small row per partition. Any column of `df` stays, but for one called `id_col`.
    """
    shared_folder(df.sparkSession)
    place, part, before = free_names(df.columns, "_place", "_part", "_before")
    placed = df.orderBy(*order_by).withColumn(place, F.monotonically_increasing_id()).checkpoint()
    part_no = F.shiftright(place, 33)
    sizes = placed.groupBy(part_no.alias(part)).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy(part)) - F.col("_n")
    offsets = sizes.select(part, earlier.alias(before))
    # One row per partition of the sort, bounded by the number of partitions.
    numbered = placed.withColumn(part, part_no).join(F.broadcast(offsets), part)
    within = F.col(place).bitwiseAND((1 << 33) - 1)
    start = F.lit(start) if isinstance(start, int) else start
    new_id = (start + F.col(before) + within + 1).cast("long")
    return numbered.withColumn(id_col, new_id).drop(place, part, before)


def assign_ids_by_hash(
    df: DataFrame, hash_col: str, id_col: str, start: int | Column = 0
) -> DataFrame:
    """Add serial ids to rows with *distinct* keys, in the order of their hash.

    `hash_col` is a base64 or hex digest. Distinct digests fall evenly into the
    prefix buckets, so each bucket is ranked on its own; offsets come from one
    row per bucket, a bounded number.
    """
    bucket, before, within = free_names(df.columns, "_bucket", "_before", "_within")
    bucketed = df.withColumn(bucket, F.substring(hash_col, 1, _PREFIX))
    sizes = bucketed.groupBy(bucket).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy(bucket)) - F.col("_n")
    offsets = F.broadcast(sizes.select(bucket, earlier.alias(before)))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(hash_col))
    start = F.lit(start) if isinstance(start, int) else start
    ranked = bucketed.withColumn(within, rank).join(offsets, bucket)
    new_id = (start + F.col(before) + F.col(within)).cast("long")
    return ranked.withColumn(id_col, new_id).drop(bucket, before, within)


def row_positions(df: DataFrame, id_col: str) -> DataFrame:
    """Add `row_idx` (from 0, in id order) and `row_total`.

    Ids are unique, so an id range of 2^20 holds at most 2^20 rows: each range is
    ranked by itself. Range totals, one saved row per range, are summed in two levels; so
    `df` is evaluated twice, once for its ids alone.
    """
    shared_folder(df.sparkSession)
    bucket = F.shiftright(F.col(id_col), _BITS)
    sizes = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n")).checkpoint()
    grouped = sizes.withColumn("_group", F.shiftright("_bucket", _BITS))
    groups = grouped.groupBy("_group").agg(F.sum("_n").alias("_size"))
    everything = Window.orderBy("_group").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    groups = groups.select(
        "_group",
        (F.sum("_size").over(Window.orderBy("_group")) - F.col("_size")).alias("_group_before"),
        F.sum("_size").over(everything).alias("row_total"),
    )
    in_group = Window.partitionBy("_group").orderBy("_bucket")
    offsets = (
        grouped.withColumn("_before", F.sum("_n").over(in_group) - F.col("_n"))
        .join(groups, "_group")
        .select("_bucket", (F.col("_before") + F.col("_group_before")).alias("_before"), "row_total")
    )
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(id_col)) - 1
    return (
        df.withColumn("_bucket", bucket)
        .withColumn("_within", within)
        .join(offsets, "_bucket")
        .withColumn("row_idx", (F.col("_before") + F.col("_within")).cast("long"))
        .drop("_bucket", "_before", "_within")
    )
