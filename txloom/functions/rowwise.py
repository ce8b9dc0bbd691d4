"""The same conditions on exploded attributes (one row per value).

Each gives a boolean column over `path`, `value` and the derived columns of
`index_attributes`. They are plain comparisons with literals, so they reach the
Parquet scan; `matching` turns them into sets of transactions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from txloom.functions import values as V
from txloom.functions.predicates import check_path, literal_set


def on_path(path: str) -> Column:
    if "*" in check_path(path):
        prefix = path.split("*")[0]
        return F.col("path").startswith(prefix) & F.col("path").rlike(V.path_regex(path))
    return F.col("path") == path


def _fingerprint(text: str) -> Column:
    return V.value_fingerprint(F.lit(text))


def attr_exists(path: str) -> Column:
    return on_path(path)


def attr_eq(path: str, text: str | int) -> Column:
    """Exactly this value; long ones are found by fingerprint."""
    text = str(text)
    if V.is_long_literal(text):
        return on_path(path) & (F.col("value_hash") == _fingerprint(text))
    return on_path(path) & (F.col("value") == text)


def attr_ne(path: str, text: str | int) -> Column:
    text = str(text)
    if V.is_long_literal(text):
        return on_path(path) & (F.col("value_hash") != _fingerprint(text))
    return on_path(path) & (F.col("value") != text)


def _attr_order(op: str):
    def condition(path: str, quantity: str | int) -> Column:
        digits, unit = V.split_quantity(str(quantity))
        key, limit = F.col("qty_key"), V.quantity_key_of(digits)
        verdict = {">": key > limit, ">=": key >= limit, "<": key < limit, "<=": key <= limit}[op]
        same_unit = F.col("unit").isNull() if unit is None else F.col("unit") == unit
        return on_path(path) & same_unit & verdict

    condition.__doc__ = f"A value of the same unit that is {op} the quantity."
    return condition


attr_gt = _attr_order(">")
attr_lt = _attr_order("<")
attr_ge = _attr_order(">=")
attr_le = _attr_order("<=")


def attr_includes(path: str, text: str) -> Column:
    return on_path(path) & F.col("value").contains(text)


def attr_not_includes(path: str, text: str) -> Column:
    return on_path(path) & ~F.col("value").contains(text)


def attr_like(path: str, pattern: str) -> Column:
    # The literal head of the pattern reaches the scan, the regex does not.
    head = pattern.replace("_", "%").split("%")[0]
    return on_path(path) & F.col("value").startswith(head) & F.col("value").rlike(V.like_regex(pattern))


def attr_not_like(path: str, pattern: str) -> Column:
    return on_path(path) & ~F.col("value").rlike(V.like_regex(pattern))


def attr_in(path: str, members: Iterable[str | int]) -> Column:
    return on_path(path) & F.col("value").isin(literal_set(members))


def attr_not_in(path: str, members: Iterable[str | int]) -> Column:
    return on_path(path) & ~F.col("value").isin(literal_set(members))
