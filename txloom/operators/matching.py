"""Sets of transactions that meet conditions on exploded attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txloom.functions.rowwise import on_path
from txloom.functions import values as V
from txloom.operators.skew import fits_broadcast, join_spreading_hot_keys
from txloom.session import shared_folder


def matching_attributes(attrs: DataFrame, condition: Column) -> DataFrame:
    """Transactions together with the value that met the condition."""
    return attrs.where(condition).select("tx_id", "path", "value")


def matching_facts(
    facts: DataFrame, paths: DataFrame, values: DataFrame, path: str, condition: Column
) -> DataFrame:
    """The same from the dictionary-coded tables: facts ⋈ paths ⋈ values.

    Facts are cut down to the path first (one dictionary row unless it has a `*`), and the
    dictionary to the values that meet the condition under that path, so frequent values
    are looked for among what is left of both.
    """
    named = paths.select("path_id", F.col("path_text").alias("path")).where(on_path(path))
    valued = values.select(
        "value_id",
        V.restore_value("value_text", "value_bytes").alias("value"),
        "qty_key",
        "unit",
        "value_hash",
    )
    if "*" not in path:
        valued = valued.withColumn("path", F.lit(path)).where(condition).drop("path")
    here = join_spreading_hot_keys(facts.select("tx_id", "path_id", "value_id"), named, "path_id", ["tx_id"])
    joined = join_spreading_hot_keys(here, valued, "value_id", ["tx_id", "path_id"])
    return joined.where(condition).select("tx_id", "path", "value")


def matching_ids(attrs: DataFrame, condition: Column) -> DataFrame:
    """Each transaction with a match once; repeats are dropped before the shuffle,
    which then serves the join as well."""
    return attrs.where(condition).select("tx_id").distinct()


def tx_semijoin(tx: DataFrame, attrs: DataFrame, condition: Column) -> DataFrame:
    """Transactions with a value that meets the condition, each once."""
    return tx.join(matching_ids(attrs, condition), "tx_id", "left_semi")


def tx_antijoin(tx: DataFrame, attrs: DataFrame, condition: Column) -> DataFrame:
    """Transactions without such a value."""
    return tx.join(matching_ids(attrs, condition), "tx_id", "left_anti")


def tx_outer_flags(
    tx: DataFrame, attrs: DataFrame, conditions: dict[str, Column], where: Column
) -> DataFrame:
    """Transactions for which a combination of matched conditions holds.

    `where` refers to the names of `conditions`; each stands for "some value
    matched". One pass over the attributes, whose partial aggregation leaves at
    most one row per transaction and task before the shuffle. Where `where`
    cannot hold without a match, Catalyst makes the outer join an inner one. A
    condition cannot be named like a column of `tx`, which would stand for either.
    """
    columns = {c.lower() for c in tx.columns}
    if taken := sorted(name for name in conditions if {name.lower(), f"_{name.lower()}"} & columns):
        raise ValueError(f"conditions named like columns: {taken}")
    relevant = None
    for condition in conditions.values():
        relevant = condition if relevant is None else relevant | condition
    flags = (
        attrs.where(relevant)
        .groupBy("tx_id")
        .agg(*[F.bool_or(c).alias(f"_{name}") for name, c in conditions.items()])
    )
    joined = tx.join(flags, "tx_id", "left")
    named = {name: F.coalesce(F.col(f"_{name}"), F.lit(False)) for name in conditions}
    return joined.withColumns(named).where(where).select(*tx.columns)


def attr_in_table(tx: DataFrame, attrs: DataFrame, path: str, members: DataFrame) -> DataFrame:
    """Transactions with a value under the path from a large set.

    `members` has a column `value`. Distinct first, so that it stays as small as it
    can be; it is broadcast if it measures small, and otherwise rows of frequent values
    are spread.
    """
    here = attrs.where(on_path(path)).select("tx_id", "value")
    hits = join_spreading_hot_keys(here, members.select("value").distinct(), "value", ["tx_id"], "left_semi")
    return tx.join(hits.select("tx_id").distinct(), "tx_id", "left_semi")


def rehydrate(attrs: DataFrame, selected: DataFrame) -> DataFrame:
    """All attributes of the selected transactions.

    Serial ids lie close together, so 64 of them go into one row of bits. If these measure
    small they are broadcast, and attributes are not shuffled.
    """
    if dict(selected.dtypes)["tx_id"] not in ("int", "bigint") or dict(attrs.dtypes)["tx_id"] not in ("int", "bigint"):
        return attrs.join(selected.select("tx_id"), "tx_id", "left_semi")
    shared_folder(attrs.sparkSession)
    number = F.col("tx_id").cast("long")
    bit, word = number.bitwiseAND(63).cast("int"), F.shiftright(number, 6)
    words = selected.where("tx_id IS NOT NULL").groupBy(word.alias("_word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(tx_id & 63 as int))")).alias("_bits")).checkpoint()
    if not fits_broadcast(words):
        return attrs.join(selected.select("tx_id"), "tx_id", "left_semi")
    return attrs.join(F.broadcast(words), (word == F.col("_word")) & (F.getbit("_bits", bit) == 1), "left_semi")
