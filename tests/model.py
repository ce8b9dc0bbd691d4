"""The meaning of filters in plain Python, to compare with."""

import random
import re

QUANTITY = re.compile(
    r"([-+]?[0-9]{1,78})([a-z0-9_]{1,16}|ibc/[A-F0-9]{64}|factory/\S{0,120})?", re.ASCII
)


def quantity(value):
    m = QUANTITY.fullmatch(value)
    return (int(m.group(1)), m.group(2) or "") if m else None


ONE = "[^\n\r\u2028\u2029]"  # no line end is matched by either wildcard


def like(value, pattern):
    parts = [ONE + "*" if c == "%" else ONE if c == "_" else re.escape(c) for c in pattern]
    return re.fullmatch("".join(parts), value) is not None


ORDER = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def holds(events, path, op, arg):
    values = events.get(path) or []
    if op == "exists":
        return bool(values)
    if op == "not exists":
        return not values
    if op in ORDER:
        limit, unit = quantity(str(arg))
        numbers = [quantity(v) for v in values]
        return any(n and n[1] == unit and ORDER[op](n[0], limit) for n in numbers)
    test = {
        "=": lambda v: v == arg,
        "!=": lambda v: v != arg,
        "includes": lambda v: arg in v,
        "not includes": lambda v: arg not in v,
        "like": lambda v: like(v, arg),
        "not like": lambda v: not like(v, arg),
        "in": lambda v: v in arg,
        "not in": lambda v: v not in arg,
    }[op]
    return any(test(v) for v in values)


PATHS = ["a.x", "a.y", "b.z"]
VALUES = [
    "", "0", "-0", "+0", "7", "007", "-7", "150uscrt", "15uscrt", "-3uscrt", "150uatom", "1u,2v",
    "9" * 78, "9" * 77 + "uscrt", "-" + "9" * 50, "gray", "gray_1", "gra\ny", "50%", "a.b", "x" * 20,
]
QUANTITIES = ["0", "7", "-7", "150uscrt", "16uscrt", "-4uscrt", "149uatom", "9" * 77, "-" + "9" * 49]
TEXTS = VALUES + ["ra", "g%", "%y", "gra_", "_", "%", "a.b"]
OPS = [
    "exists", "not exists", "=", "!=", ">", ">=", "<", "<=",
    "includes", "not includes", "like", "not like", "in", "not in",
]


def random_events(rng: random.Random) -> dict:
    return {
        p: [rng.choice(VALUES) for _ in range(rng.randint(0, 4))] for p in PATHS if rng.random() < 0.8
    }


def random_condition(rng: random.Random):
    op = rng.choice(OPS)
    if op in ORDER:
        arg = rng.choice(QUANTITIES)
    elif op in ("in", "not in"):
        arg = rng.sample(VALUES, 3)
    elif op in ("exists", "not exists"):
        arg = None
    else:
        arg = rng.choice(TEXTS)
    return rng.choice(PATHS), op, arg
