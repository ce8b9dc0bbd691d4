"""Equi-joins whose left side may have very frequent keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txloom.operators.ids import free_names
from txloom.session import shared_folder, stored

# A key is hot from this many rows on: more than one task should hold.
HOT_ROWS = 1_000_000

# What may be sent to every executor.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024

# A key is frequent from this many rows on, if no more than so many keys are: its rows meet
# a broadcast part of the other side and are not shuffled.
FREQUENT_ROWS = 64
FREQUENT_KEYS = 250_000


def fits_broadcast(df: DataFrame, *also: Column):
    """Whether a table measures small, by rows and bytes.

    Rows are counted first, which of a stored table reads no column; only the columns of a
    table with few rows are measured. With `also`, aggregates, their values come along.
    """
    rows, *rest = df.agg(F.count("*"), *also).first()
    small = rows <= BROADCAST_ROWS
    if small and rows:
        small = df.agg(F.sum(row_bytes(df))).first()[0] <= BROADCAST_BYTES
    return (small, *rest) if also else small


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row, about: of texts as they are, of nested columns as JSON."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(column), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size += F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            size += 8
    return size


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, salts): every key of at least `hot_rows` rows and how many tasks it needs.

    One pass over the key column; repeats are counted before the shuffle. All such keys
    are listed, at most one per `hot_rows` rows of `df`.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return _hot(counts, [key], hot_rows)


def _hot(counts: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    hot = counts.where(F.col("_n") >= hot_rows)
    return hot.select(*keys, F.greatest(F.lit(2), F.ceil(F.col("_n") / hot_rows)).cast("int").alias("_salts"))


def frequent_rows(counts: DataFrame, most: int = FREQUENT_KEYS) -> int | None:
    """The least power of two, of those from `FREQUENT_ROWS` on, which the `_n` rows of at most
    `most` keys reach; None if there are no such keys."""
    steps = counts.groupBy(F.floor(F.log2("_n")).cast("int").alias("step")).agg(F.count("*").alias("keys"))
    found, total = None, 0
    # One row per power of two.
    for row in steps.orderBy(F.desc("step")).collect():
        total += row["keys"]
        if total > most:
            break
        found = max(2 ** row["step"], FREQUENT_ROWS)
    return found


def join_spreading_hot_keys(
    left: DataFrame,
    right: DataFrame,
    key: str | list[str],
    spread_by: list[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """`left.join(right, key, how)` with the rows of hot keys spread over tasks.

    A right side that measures small is broadcast, and then no key is counted. Else the left
    rows of frequent keys stay where they are, if the right rows of these measure small. Where
    they do not, each hot key gets as many salts as it has times `hot_rows` rows, and only the
    `right` rows of hot keys are repeated, each by its own number. `spread_by` are left columns
    that tell the rows of one key apart. `how` is inner, left, left_semi or left_anti. Which
    keys are frequent or hot changes the speed and never the result. `key` may be several columns.

    The left side is read once to count its keys and twice to be joined, without a shuffle of
    rows in the first and of frequent keys in any; so it should be stored, or cheap to make.
    """
    keys = [key] if isinstance(key, str) else key
    if fits_broadcast(right):
        return left.join(F.broadcast(right), keys, how)
    shared_folder(left.sparkSession)
    counts = left.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n"))
    counts = stored(counts.where(F.col("_n") >= min(FREQUENT_ROWS, hot_rows)), "counts")
    least = frequent_rows(counts)
    if least is None:
        return left.join(right, keys, how) if counts.isEmpty() else _salted(left, right, keys, spread_by, how, _hot(counts, keys, hot_rows))
    frequent = F.broadcast(counts.where(F.col("_n") >= least).select(*keys))
    theirs = stored(right.join(frequent, keys, "left_semi"), "theirs")
    if least > hot_rows or not fits_broadcast(theirs):
        return _salted(left, right, keys, spread_by, how, _hot(counts, keys, hot_rows))
    here = left if how in ("inner", "left_semi") else left.join(frequent, keys, "left_semi")
    rest = left.join(frequent, keys, "left_anti").join(right, keys, how)
    return here.join(F.broadcast(theirs), keys, how).unionByName(rest)


def join_with_salts(
    left: DataFrame, right: DataFrame, key: str, spread_by: list[str], how: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The way for a large right side, of which frequent keys have very many rows."""
    shared_folder(left.sparkSession)
    return _salted(left, right, [key], spread_by, how, hot_keys(left, key, hot_rows).checkpoint())


def _salted(left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[str], how: str, hot: DataFrame) -> DataFrame:
    small, rows = fits_broadcast(hot, F.count("*"))
    if rows == 0:
        return left.join(right, keys, how)
    # Names that neither side has.
    salt_no, salt_count = free_names([*left.columns, *right.columns], "_salt", "_salt_count")
    hot = hot.withColumnRenamed("_salts", salt_count)
    named = F.broadcast(hot) if small else hot
    salts = F.coalesce(salt_count, F.lit(1))
    salt = F.pmod(F.xxhash64(*spread_by), salts).cast("int")
    spread = left.join(named, keys, "left").withColumn(salt_no, salt).drop(salt_count)
    every = F.explode(F.sequence(F.lit(0), salts - 1))
    repeated = right.join(named, keys, "left").withColumn(salt_no, every).drop(salt_count)
    return spread.join(repeated, [*keys, salt_no], how).drop(salt_no)
