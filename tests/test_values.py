import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from txloom.functions import values as V
from txloom.model import TEXT_LIMIT


def rows(spark, values, **columns):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return df.select("value", *[c.alias(n) for n, c in columns.items()]).collect()


@pytest.mark.parametrize(
    "value, expected",
    [
        ("150uscrt", ("150", "uscrt")),
        ("-7", ("-7", None)),
        ("+7u_1", ("+7", "u_1")),
        ("1u,2v", None),
        ("", None),
        ("12 uscrt", None),
        ("5\n", None),
        ("5USCRT", None),
        ("9" * 78, ("9" * 78, None)),
        ("9" * 80, ("9" * 78, "99")),
        ("9" * 95, None),
        ("1ibc/" + "A1" * 32, ("1", "ibc/" + "A1" * 32)),
        ("1ibc/" + "a1" * 32, None),
        ("3factory/addr/x-y", ("3", "factory/addr/x-y")),
        ("3factory/" + "x" * 121, None),
        ("1" + "a" * 17, None),
    ],
)
def test_parse_quantity(spark, value, expected):
    (row,) = rows(spark, [value], q=V.quantity_text("value"), u=V.quantity_unit("value"))
    assert (row.q, row.u) == (expected or (None, None))
    if expected is None:
        with pytest.raises(ValueError):
            V.split_quantity(value)
    else:
        assert V.split_quantity(value) == expected


def test_quantity_key_orders_like_integers(spark):
    rng = random.Random(1)
    numbers = ["0", "-0", "+0", "00012", "+12", "12", "-1", "-01"]
    for _ in range(400):
        digits = str(rng.randrange(10 ** rng.randint(1, 78)))
        numbers.append(rng.choice(["", "-", "+"]) + digits.zfill(rng.choice([1, min(78, len(digits) + 2)])))
    found = rows(spark, numbers, key=V.quantity_key("value"))
    assert all(r.key == V.quantity_key_of(r.value) for r in found)
    by_key = sorted(found, key=lambda r: r.key)
    assert [int(r.value) for r in by_key] == sorted(int(n) for n in numbers)
    assert len({r.key for r in found}) == len({int(n) for n in numbers})


def test_compare_quantity_agrees_with_keys(spark):
    rng = random.Random(2)
    values = ["", "x", "5uscrt", "-5uscrt", "0uscrt", "-0uscrt", "+0", "0", "9" * 80, "9" * 78 + "7"]
    for _ in range(150):
        number = rng.choice(["", "-", "+"]) + str(rng.randrange(10 ** rng.choice([1, 2, 40, 78])))
        values.append(number + rng.choice(["", "uscrt", "uatom"]))
    for limit in ["0", "-0", "5uscrt", "-5uscrt", "0uscrt", "9" * 40, "-" + "9" * 39 + "uatom", "9" * 78 + "99"]:
        digits, unit = V.split_quantity(limit)
        key, same = V.quantity_key(V.quantity_text("value")), V.quantity_unit("value").eqNullSafe(F.lit(unit))
        k = V.quantity_key_of(digits)
        by_key = {">": key > k, ">=": key >= k, "<": key < k, "<=": key <= k}
        columns = {}
        for i, (op, verdict) in enumerate(by_key.items()):
            columns[f"a{i}"] = V.compare_quantity(F.col("value"), op, limit)
            columns[f"b{i}"] = F.coalesce(same & verdict, F.lit(False))
        for r in rows(spark, values, **columns):
            for i in range(4):
                assert r[f"a{i}"] == r[f"b{i}"], (r.value, i, limit)


def test_long_values_are_split_by_utf16_length(spark):
    values = ["x" * (TEXT_LIMIT - 1), "x" * TEXT_LIMIT, "😀" * 4095, "😀" * 4096, "😀" * 4095 + "x", "", "é" * 8190]
    found = rows(spark, values, t=V.value_text("value"), b=V.value_bytes("value"))
    for r in found:
        long = len(r.value.encode("utf-16-be")) // 2 >= TEXT_LIMIT
        assert (r.t is None, r.b is not None) == (long, long)
        assert V.is_long_literal(r.value) == long
    both = spark.createDataFrame(found).select("value", V.restore_value("t", "b").alias("back"))
    assert all(r.value == r.back for r in both.collect())


def test_fingerprint_and_base64(spark):
    text = "grün"
    (row,) = rows(
        spark, [text], h=V.value_fingerprint("value"), e=V.encode_tx(F.encode(F.col("value"), "UTF-8"))
    )
    assert row.h == base64.b64encode(hashlib.sha256(text.encode()).digest()).decode()
    assert row.e == base64.b64encode(text.encode()).decode()
    (null,) = spark.sql("SELECT CAST(NULL AS BINARY) AS b, CAST(NULL AS STRING) AS s").select(
        V.encode_tx("b").alias("e"), V.decode_tx("s").alias("d")
    ).collect()
    assert null.e is None and null.d is None


def test_tx_hash_is_the_first_value(spark, tx_of):
    txs = tx_of({"tx.hash": ["A", "B"]}, {"tx.hash": []}, {})
    assert [r.h for r in txs.orderBy("tx_id").select(V.tx_hash().alias("h")).collect()] == ["A", None, None]


def test_explorer_link(spark):
    df = spark.createDataFrame([("chain-4", "AB"), ("plain", "CD")], "chain string, hash string")
    link = V.explorer_link("https://x.example/{chainShort}/tx/{hash}", "chain", "hash")
    assert [r.u for r in df.select(link.alias("u")).collect()] == [
        "https://x.example/chain/tx/AB",
        "https://x.example/plain/tx/CD",
    ]


def test_like_column_equals_literal(spark):
    patterns = ["a%", "a.b", "50%", "_[x]", "a\\b", "%\n%", "($)"]
    df = spark.createDataFrame([(p,) for p in patterns], "p string")
    assert {r.p: r.r for r in df.select("p", V.like_regex_column(F.col("p")).alias("r")).collect()} == {
        p: V.like_regex(p) for p in patterns
    }
