"""Column functions over single attribute values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from txloom.model import QUANTITY_PATTERN, TEXT_LIMIT

_QUANTITY = re.compile(QUANTITY_PATTERN.replace(r"\z", r"\Z"), re.ASCII)
_COMPLEMENT = ("0123456789", "9876543210")


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- quantities -------------------------------------------------------------


def quantity_text(value: Column | str) -> Column:
    """Signed digits of a quantity, NULL where the value is not one."""
    # The pattern is matched once; `nullif` names its argument twice.
    return F.get(F.regexp_extract_all(_c(value), F.lit(QUANTITY_PATTERN), F.lit(1)), F.lit(0))


def quantity_unit(value: Column | str) -> Column:
    """Unit of a quantity, NULL where there is none."""
    return F.nullif(F.regexp_extract(_c(value), QUANTITY_PATTERN, 2), F.lit(""))


def unit_after(value: Column | str, qty_text: Column | str) -> Column:
    """`quantity_unit` of a value whose `quantity_text` is known: what follows the digits."""
    value, digits = _c(value), F.length(_c(qty_text))
    return F.when(F.length(value) > digits, F.substr(value, digits + 1))


def quantity_key(qty_text: Column | str) -> Column:
    """String whose plain order is the numeric order of up to 78 digits.

    Sign, two-digit length, digits; the last two complemented below zero.
    """
    qty_text = _c(qty_text)
    magnitude = F.ltrim(qty_text, F.lit("+-0"))
    body = F.concat(F.lpad(F.length(magnitude).cast("string"), 2, "0"), magnitude)
    below_zero = qty_text.startswith("-") & (magnitude != "")
    return F.when(
        below_zero, F.concat(F.lit("0"), F.translate(body, *_COMPLEMENT))
    ).otherwise(F.concat(F.lit("1"), body))


def split_quantity(text: str) -> tuple[str, str | None]:
    """Digits and unit of a quantity written in a filter."""
    match = _QUANTITY.match(str(text))
    if match is None:
        raise ValueError(f"not a quantity: {text!r}")
    return match.group(1), match.group(2)


def quantity_key_of(digits: str) -> str:
    """`quantity_key` of a literal."""
    magnitude = digits.lstrip("+-0")
    body = f"{len(magnitude):02d}{magnitude}"
    if digits.startswith("-") and magnitude:
        return "0" + body.translate(str.maketrans(*_COMPLEMENT))
    return "1" + body


def compare_quantity(value: Column, op: str, quantity: str) -> Column:
    """`value op quantity` for a raw value; false unless the units are the same.

    The unit of the literal is known, so one match settles it and the digits are
    compared by length first: cheaper per row than building a key, which matters
    where values are still unparsed (event maps and streams).
    """
    digits, unit = split_quantity(quantity)
    unit = unit or ""
    # A unit that starts with a digit can only follow a full-length number.
    repeat = "{78}" if unit[:1].isdigit() else "{1,78}"
    same_unit = value.rlike(rf"^[-+]?\d{repeat}{quote_regex(unit)}\z")

    number = F.substr(value, F.lit(1), F.length(value) - len(unit)) if unit else value
    magnitude = F.ltrim(number, F.lit("+-0"))
    below_zero = number.startswith("-")

    limit = digits.lstrip("+-0")
    limit_below_zero = digits.startswith("-") and limit != ""
    size, limit_size = F.length(magnitude), len(limit)

    def longer(or_equal: bool) -> Column:
        digits_side = magnitude >= limit if or_equal else magnitude > limit
        return (size > limit_size) | ((size == limit_size) & digits_side)

    if limit_below_zero:
        greater = ~below_zero | ~longer(or_equal=True)
        not_less = ~below_zero | ~longer(or_equal=False)
    else:
        greater = ~below_zero & longer(or_equal=False)
        not_less = ~below_zero & longer(or_equal=True)
        if limit == "":
            not_less = not_less | (magnitude == "")
    verdict = {">": greater, ">=": not_less, "<": ~not_less, "<=": ~greater}[op]
    return same_unit & verdict


# --- text and bytes ---------------------------------------------------------


def is_long(value: Column | str) -> Column:
    """At or over the text limit, counted in UTF-16 units.

    A code point is one or two units, so only values in between need encoding.
    """
    value = _c(value)
    points = F.length(value)
    units = F.octet_length(F.encode(value, "UTF-16BE")) / 2
    return (points >= TEXT_LIMIT) | ((points * 2 >= TEXT_LIMIT) & (units >= TEXT_LIMIT))


def is_long_literal(text: str) -> bool:
    return len(text.encode("utf-16-be")) // 2 >= TEXT_LIMIT


def value_text(value: Column | str) -> Column:
    """The value itself while it is short enough, else NULL."""
    return F.when(~is_long(value), _c(value))


def value_bytes(value: Column | str) -> Column:
    """UTF-8 bytes of a value too long for text, else NULL."""
    return F.when(is_long(value), F.encode(_c(value), "UTF-8"))


def restore_value(text: Column | str, binary: Column | str) -> Column:
    """The value again, from whichever of the two columns holds it."""
    return F.coalesce(F.decode(_c(binary), "UTF-8"), _c(text))


def value_fingerprint(value: Column | str) -> Column:
    """Base64 of the SHA-256 of the value: its key in the value dictionary."""
    return F.base64(F.unhex(F.sha2(_c(value), 256)))


def encode_tx(tx_bytes: Column | str) -> Column:
    return F.base64(_c(tx_bytes))


def decode_tx(tx_base64: Column | str) -> Column:
    return F.unbase64(_c(tx_base64))


def tx_hash(events: Column | str = "events") -> Column:
    """First value under `tx.hash`, NULL where there is none."""
    return F.get(_c(events)["tx.hash"], F.lit(0))


def explorer_link(template: str, chain_id: Column | str, hash_: Column | str) -> Column:
    """Fill `{chainShort}` (chain id up to its first dash) and `{hash}`."""
    short = F.regexp_replace(_c(chain_id), r"^([^-]+).*$", "$1")
    with_chain = F.replace(F.lit(template), F.lit("{chainShort}"), short)
    return F.replace(with_chain, F.lit("{hash}"), _c(hash_))


# --- patterns ---------------------------------------------------------------

# Any character but a line end; `.` differs in this between regex dialects.
_ONE = r"[^\n\r\u2028\u2029]"
_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}])")


def quote_regex(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def like_regex(pattern: str) -> str:
    """Whole-value regex of a `%` / `_` pattern; there is no escape character."""
    return "^" + quote_regex(pattern).replace("%", _ONE + "*").replace("_", _ONE) + r"\z"


def like_regex_column(pattern: Column) -> Column:
    """`like_regex` for patterns held in a column."""
    quoted = F.regexp_replace(pattern, _SPECIAL.pattern, r"\\$1")
    one = F.lit(_ONE)
    any_run = F.replace(quoted, F.lit("%"), F.lit(_ONE + "*"))
    return F.concat(F.lit("^"), F.replace(any_run, F.lit("_"), one), F.lit(r"\z"))


def path_regex(pattern: str) -> str:
    """Whole-path regex in which `*` stands for any run of path characters."""
    return "^" + r"[\w.:*-]*".join(quote_regex(p) for p in pattern.split("*")) + r"\z"


def path_regex_column(pattern: Column) -> Column:
    """`path_regex` for patterns held in a column."""
    quoted = F.regexp_replace(pattern, _SPECIAL.pattern, r"\\$1")
    any_run = F.replace(quoted, F.lit(r"\*"), F.lit(r"[\w.:*-]*"))
    return F.concat(F.lit("^"), any_run, F.lit(r"\z"))
