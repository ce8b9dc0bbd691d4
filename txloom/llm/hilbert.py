"""Sharding along a Hilbert curve, so that files can be pruned by several columns.

Each of some metadata columns is quantised into 2^bits cells that hold about equally
many rows, rows are ordered by the index of their cell on the Hilbert curve, and the
order is cut into runs. Neighbours on the curve are neighbours in every column, so each
run covers a small box and min/max statistics skip the others for a filter on any column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txloom.llm.common import fresh
from txloom.operators.ids import assign_ids
from txloom.session import shared_folder

# The curve is a table of 2^(dimensions * bits) rows; that many are broadcast.
MAX_CURVE_BITS = 16
# Values of a dimension whose counts fit one sort; more are range-sorted, with the same cells.
MAX_CLASSES = 1 << 16


def size_class(number: Column) -> Column:
    """Half octaves of a count: a bounded number of classes in the order of the numbers."""
    n = F.greatest(number.cast("long"), F.lit(0))
    digits = F.bin(n)
    return F.length(digits) * 2 + (F.substring(digits, 2, 1) == "1").cast("int")


def curve(dims: int, bits: int) -> np.ndarray:
    """Hilbert index of every cell, by the cell's number (its coordinates' bits, first highest)."""
    cells = np.arange(1 << (dims * bits))
    x = [(cells >> (bits * (dims - 1 - k))) & ((1 << bits) - 1) for k in range(dims)]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for k in range(dims):
            flip = (x[k] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
        q >>= 1
    for k in range(1, dims):
        x[k] = x[k] ^ x[k - 1]
    fix = np.zeros_like(cells)
    for b in range(bits - 1, 0, -1):
        fix ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    index = np.zeros_like(cells)
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            index = (index << 1) | (((x[k] ^ fix) >> b) & 1)
    return index


def _cell_of(df: DataFrame, key: str, cell: str, bits: int) -> DataFrame:
    """`df` with the equal-depth cell of its column `key`, which is dropped.

    The cell is the share of rows with a smaller value, in 2^bits parts; null is the
    smallest value. Counts are aggregated before they move, so a value that most rows
    have costs nothing. Cells follow the order of values, so what comes back by a broadcast
    is each cell's least value, 2^bits at most.
    """
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    order = F.col("_key").asc_nulls_first()
    if sizes.limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        # Sorted and saved, so that places do not shift; offsets are one row per partition.
        shared_folder(df.sparkSession)
        placed = sizes.orderBy(order).withColumn("_place", F.monotonically_increasing_id()).checkpoint()
        placed = placed.withColumn("_part", F.shiftright("_place", 33))
        offsets = placed.groupBy("_part").agg(F.sum("_n").alias("_size"))
        earlier = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
        offsets = offsets.select("_part", earlier.alias("_earlier"))
        within = F.sum("_n").over(Window.partitionBy("_part").orderBy("_place")) - F.col("_n")
        counted = placed.withColumn("_within", within).join(F.broadcast(offsets), "_part")
        counted = counted.select("_key", (F.col("_earlier") + F.col("_within")).alias("_before"))
        total = placed.agg(F.sum("_n").alias("_total"))
    else:
        counted = sizes.select("_key", (F.sum("_n").over(Window.orderBy(order)) - F.col("_n")).alias("_before"))
        total = sizes.agg(F.sum("_n").alias("_total"))
    cells = counted.where("_key is not null").crossJoin(F.broadcast(total))
    cells = cells.groupBy(F.expr(f"cast(_before * {1 << bits} div _total as int)").alias("_at")).agg(
        F.min("_key").alias("_least")
    )
    bounds = fresh(df, "_bounds")
    lows = cells.agg(F.sort_array(F.collect_list(F.struct("_least", "_at"))).alias(bounds))
    # Binary search for how many cells begin at the value or before.
    reached = F.aggregate(
        F.lit([1 << b for b in range(bits, -1, -1)]),
        F.lit(0),
        lambda n, step: F.when(
            (n + step <= F.size(bounds)) & (F.get(bounds, n + step - 1)["_least"] <= F.col(key)), n + step
        ).otherwise(n),
    )
    place = F.coalesce(F.get(bounds, reached - 1)["_at"], F.lit(0))
    return df.crossJoin(F.broadcast(lows)).withColumn(cell, place).drop(key, bounds)


def hilbert_index(df: DataFrame, dims: list[Column], bits: int, index: str) -> DataFrame:
    """`df` with the place on the curve of each row's cell in the column `index`."""
    if len(dims) * bits > MAX_CURVE_BITS:
        raise ValueError(f"{len(dims)} dimensions of {bits} bits are over {MAX_CURVE_BITS} bits")
    keys = [fresh(df, f"_key_{k}") for k in range(len(dims))]
    cells = [fresh(df, f"_cell_{k}") for k in range(len(dims))]
    df = df.withColumns(dict(zip(keys, dims)))
    for key, cell in zip(keys, cells):
        df = _cell_of(df, key, cell, bits)
    number = sum((F.col(c) * (1 << bits * (len(dims) - 1 - k)) for k, c in enumerate(cells)), F.lit(0))
    cell_number = fresh(df, "_cell_number")
    # As large as the grid, 2^MAX_CURVE_BITS rows at most.
    places = list(enumerate(curve(len(dims), bits).tolist()))
    grid = df.sparkSession.createDataFrame(places, f"{cell_number} int, {index} int")
    df = df.withColumn(cell_number, number.cast("int"))
    return df.join(F.broadcast(grid), cell_number).drop(cell_number, *cells)


def shard(
    df: DataFrame, dims: list[Column], ties: list[Column], shards: int = 16, bits: int = 4
) -> DataFrame:
    """`df` with `hilbert`, `shard` (from 0) and `slot` (from 0 in each shard).

    Rows in the order of curve index, then `ties`, are cut into `shards` runs whose row
    counts differ by one at most. Rows alike in all of these take any of their places.
    Numbering is a range sort on the whole order with one count per partition; a crowded
    cell is split by `ties`. Null values are a cell's smallest; an empty table gives none.
    An input column named like one of the three is replaced.
    """
    df = df.drop("hilbert", "shard", "slot")
    placed = hilbert_index(df, dims, bits, "hilbert")
    place = fresh(placed, "_place_no")
    ranked = assign_ids(placed, ["hilbert", *ties], place)
    total = max(1, df.count())
    ranked = ranked.withColumn("shard", F.expr(f"cast(({place} - 1) * {shards} div {total} as int)"))
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("slot", (F.col(place) - 1 - first).cast("long")).drop(place)


def write_shards(sharded: DataFrame, path: str, shards: int = 16) -> None:
    """One folder per shard, rows in the order of the curve.

    `repartitionByRange` on shard and slot gives each file a run; a shard too large for
    one task is cut into several runs of the same folder.
    """
    ordered = sharded.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
