"""Removal of old transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txloom.model import RETENTION_HOURS


def cutoff(now: Column, hours: int = RETENTION_HOURS) -> Column:
    return now - F.expr(f"INTERVAL {int(hours)} HOURS")


def expire_transactions(tx: DataFrame, now: Column, hours: int = RETENTION_HOURS) -> DataFrame:
    """Transactions that stay; one exactly as old as allowed does."""
    return tx.where(F.col("ts") >= cutoff(now, hours))


def cascade_expire(facts: DataFrame, kept: DataFrame) -> DataFrame:
    """Facts of the transactions that stay. Dictionary rows are never removed."""
    return facts.join(kept.select("tx_id"), "tx_id", "left_semi")
