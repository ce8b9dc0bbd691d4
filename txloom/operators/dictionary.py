"""Dictionaries of paths and values, and facts that refer to them by id."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.functions import values as V
from txloom.operators.ids import assign_ids, assign_ids_by_hash
from txloom.operators.skew import fits_broadcast, join_spreading_hot_keys
from txloom.session import discard, stored


class Upsert(NamedTuple):
    """`new` rows to append, and `known`: id and key of what the dictionary has already."""

    new: DataFrame
    known: DataFrame

    @property
    def found(self) -> DataFrame:
        """Id and key of everything requested."""
        return self.with_new(self.new)

    def with_new(self, stored: DataFrame) -> DataFrame:
        """The same, with the new rows as they were stored, which need not be numbered again."""
        return self.known.unionByName(stored.select(self.known.columns))


def last_id(dictionary: DataFrame, id_col: str):
    """Highest id in use as a scalar column, 0 when there is none."""
    return F.coalesce(dictionary.agg(F.max(id_col)).scalar(), F.lit(0))


def existing_rows(keys: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """Dictionary rows of the requested keys.

    The dictionary is on the streamed side: if the keys measure small enough to
    broadcast, which those of a micro-batch do, it is read once without a shuffle.
    """
    wanted = keys.select(key)
    if fits_broadcast(wanted):
        wanted = F.broadcast(wanted)
    return dictionary.join(wanted, key, "left_semi")


def insert_if_absent(
    keys: DataFrame,
    dictionary: DataFrame,
    key: str,
    id_col: str,
    numbered: Callable[[DataFrame], DataFrame],
) -> Upsert:
    """Ids of distinct keys; those the dictionary lacks get new ones by `numbered`.

    The keys and what is known of them are saved, so the data they come from and the
    dictionary are read once each.
    """
    keys = stored(keys, "keys")
    known = stored(existing_rows(keys, dictionary.select(id_col, key), key), "known")
    new = numbered(keys.join(known.select(key), key, "left_anti"))
    return Upsert(new, known)


# --- paths ------------------------------------------------------------------


def path_keys(tx: DataFrame) -> DataFrame:
    """Each path with the first transaction that carries it."""
    return (
        tx.select("tx_id", F.explode(F.map_keys("events")).alias("path_text"))
        .groupBy("path_text")
        .agg(F.min("tx_id").alias("first_tx"))
    )


def upsert_paths(keys: DataFrame, paths: DataFrame, start=None) -> Upsert:
    """Ids in first-seen order: first transaction, then path."""
    start = last_id(paths, "path_id") if start is None else start

    def numbered(unseen: DataFrame) -> DataFrame:
        with_id = assign_ids(unseen, ["first_tx", "path_text"], "path_id", start)
        return with_id.select("path_id", "path_text")

    return insert_if_absent(keys, paths, "path_text", "path_id", numbered)


# --- values -----------------------------------------------------------------


def value_keys(attrs: DataFrame) -> DataFrame:
    """Each distinct value as a dictionary row without id.

    The map-side half of the aggregation drops repeats before the shuffle. Where the
    fingerprint is stored already it is the key, and the text comes along; else texts are
    made distinct first, and parsed and hashed once each.
    """
    value = F.col("value")
    given = attrs.where("value IS NOT NULL")
    if "value_hash" in attrs.columns:
        once = given.groupBy("value_hash").agg(F.first("value").alias("value"))
    else:
        once = given.select("value").distinct().withColumn("value_hash", V.value_fingerprint(value))
    return _parsed(once)


def _parsed(once: DataFrame) -> DataFrame:
    """Dictionary rows of values (`value`, `value_hash`), with any other column before them."""
    value = F.col("value")
    return once.select(
        *[c for c in once.columns if c not in ("value", "value_hash")],
        "value_hash",
        V.quantity_text(value).alias("qty_text"),
        V.quantity_key(V.quantity_text(value)).alias("qty_key"),
        V.quantity_unit(value).alias("unit"),
        V.value_text(value).alias("value_text"),
        V.value_bytes(value).alias("value_bytes"),
    )


def value_dictionary(attrs: DataFrame) -> DataFrame:
    """The dictionary of all values of `attrs`, stored, with ids in the order of fingerprints.

    Distinct values are stored alone first: numbering reads them twice, and what is parsed of
    a value, several times its length, is not shuffled.
    """
    once = stored(attrs.where("value IS NOT NULL").select("value").distinct(), "distinct")
    hashed = once.withColumn("value_hash", V.value_fingerprint("value"))
    numbered = assign_ids_by_hash(hashed, "value_hash", "value_id")
    columns = [*value_keys(attrs).columns, "value_id"]
    dictionary = stored(_parsed(numbered).select(*columns), "dictionary")
    discard(once)
    return dictionary


def upsert_values(keys: DataFrame, values: DataFrame, start=None) -> Upsert:
    """Ids of new values in the order of their fingerprints."""
    start = last_id(values, "value_id") if start is None else start

    def numbered(unseen: DataFrame) -> DataFrame:
        return assign_ids_by_hash(unseen, "value_hash", "value_id", start).select("value_id", *keys.columns)

    return insert_if_absent(keys, values, "value_hash", "value_id", numbered)


# --- facts ------------------------------------------------------------------


def _short_key(value_hash) -> list:
    """128 bits of a fingerprint, to join by: a third of its length as text."""
    return [F.xxhash64(value_hash).alias("_key_a"), F.xxhash64(F.lit(1), value_hash).alias("_key_b")]


def encode_attributes(
    attrs: DataFrame, paths: DataFrame, values: DataFrame, keep: tuple[str, ...] = ("tx_id",)
) -> DataFrame:
    """Paths and values replaced by ids; one row per value, repeats kept.

    Rows of a value that many share (every transaction has `tm.event = 'Tx'`) are not
    shuffled, and paths are joined by broadcast, since their dictionary measures small as a rule.
    The others are shuffled with 128 bits of their fingerprint, in which it is told apart as well.
    """
    hashed_before = "value_hash" in attrs.columns
    value_hash = F.col("value_hash") if hashed_before else V.value_fingerprint("value")
    given = attrs.where("value IS NOT NULL")
    hashed = (given.where("value_hash IS NOT NULL") if hashed_before else given).select(
        *keep, F.col("path").alias("path_text"), *_short_key(value_hash)
    )
    by_path = paths.select("path_id", "path_text")
    with_path = join_spreading_hot_keys(hashed, by_path, "path_text", ["tx_id"])
    by_hash = values.where("value_hash IS NOT NULL").select("value_id", *_short_key(F.col("value_hash")))
    with_value = join_spreading_hot_keys(
        with_path.drop("path_text"), by_hash, ["_key_a", "_key_b"], ["tx_id", "path_id"]
    )
    tail = [c for c in keep if c != "tx_id"]
    return with_value.select("tx_id", "path_id", "value_id", *tail)


def decode_facts(facts: DataFrame, paths: DataFrame, values: DataFrame) -> DataFrame:
    """Facts with their path and value again, long values from their bytes."""
    with_value = join_spreading_hot_keys(
        facts.select("tx_id", "path_id", "value_id"),
        values.select("value_id", "value_text", "value_bytes"),
        "value_id",
        ["tx_id", "path_id"],
    )
    return join_spreading_hot_keys(with_value, paths, "path_id", ["tx_id"]).select(
        "tx_id",
        F.col("path_text").alias("path"),
        V.restore_value("value_text", "value_bytes").alias("value"),
    )
