"""Filters over a transaction's event map, as plain boolean columns.

A filter holds for a transaction when *some* value under the path satisfies it;
only `attr_not_exists` speaks about all values. Combine filters with `&` and
`|`. None of them is ever NULL, so any combination is safe. `=` and `!=`
compare strings, the order operators compare integers of the same unit.

The same columns serve stored tables and streams. A `*` in a path stands for
any run of path characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from txloom.functions import values as V
from txloom.model import PATH_LIMIT


def check_path(path: str) -> str:
    if not 1 <= len(path) <= PATH_LIMIT or "\n" in path or "`" in path:
        raise ValueError(f"not an attribute path: {path!r}")
    return path


def literal_set(members: Iterable[str | int]) -> list[str]:
    """Set members as strings, each once."""
    return list(dict.fromkeys(str(m) for m in members))


def values_at(path: str, events: Column | str = "events") -> Column:
    """All values under the path, an empty list where there are none."""
    events = F.col(events) if isinstance(events, str) else events
    if "*" in check_path(path):
        chosen = F.map_filter(events, lambda k, _: k.rlike(V.path_regex(path)))
        found = F.flatten(F.filter(F.map_values(chosen), lambda v: v.isNotNull()))
    else:
        found = events[path]
    return F.coalesce(found, F.array().cast("array<string>"))


def _some(path: str, holds: Callable[[Column], Column], events: Column | str) -> Column:
    return F.coalesce(F.exists(values_at(path, events), holds), F.lit(False))


def path_wildcard(pattern: str, holds: Callable[[Column], Column], events="events") -> Column:
    """Some value under some path that fits the pattern satisfies `holds`."""
    return _some(pattern, holds, events)


def attr_exists(path: str, events: Column | str = "events") -> Column:
    return F.size(values_at(path, events)) > 0


def attr_not_exists(path: str, events: Column | str = "events") -> Column:
    return F.size(values_at(path, events)) == 0


def attr_eq(path: str, text: str | int, events: Column | str = "events") -> Column:
    return F.coalesce(F.array_contains(values_at(path, events), str(text)), F.lit(False))


def attr_ne(path: str, text: str | int, events: Column | str = "events") -> Column:
    return _some(path, lambda v: v != str(text), events)


def _attr_order(op: str):
    def predicate(path: str, quantity: str | int, events: Column | str = "events") -> Column:
        return _some(path, lambda v: V.compare_quantity(v, op, str(quantity)), events)

    predicate.__doc__ = f"Some value of the same unit is {op} the quantity."
    return predicate


attr_gt = _attr_order(">")
attr_lt = _attr_order("<")
attr_ge = _attr_order(">=")
attr_le = _attr_order("<=")


def unit_matches(value: Column, unit: str | None) -> Column:
    """The value is a quantity with exactly this unit (None: with no unit)."""
    return V.quantity_text(value).isNotNull() & V.quantity_unit(value).eqNullSafe(F.lit(unit))


def attr_includes(path: str, text: str, events: Column | str = "events") -> Column:
    return _some(path, lambda v: v.contains(text), events)


def attr_not_includes(path: str, text: str, events: Column | str = "events") -> Column:
    return _some(path, lambda v: ~v.contains(text), events)


def attr_like(path: str, pattern: str, events: Column | str = "events") -> Column:
    return _some(path, lambda v: v.rlike(V.like_regex(pattern)), events)


def attr_not_like(path: str, pattern: str, events: Column | str = "events") -> Column:
    return _some(path, lambda v: ~v.rlike(V.like_regex(pattern)), events)


def attr_in(path: str, members: Iterable[str | int], events: Column | str = "events") -> Column:
    members = literal_set(members)
    return _some(path, lambda v: v.isin(members), events)


def attr_not_in(path: str, members: Iterable[str | int], events: Column | str = "events") -> Column:
    members = literal_set(members)
    return _some(path, lambda v: ~v.isin(members), events)


def all_of(*filters: Column) -> Column:
    return reduce(and_, filters, F.lit(True))


def any_of(*filters: Column) -> Column:
    return reduce(or_, filters, F.lit(False))
