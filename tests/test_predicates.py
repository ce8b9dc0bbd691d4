import random
from functools import reduce

import model
import pytest
from pyspark.sql import functions as F

from txloom.functions import predicates as P
from txloom.functions import rowwise as R
from txloom.operators.attributes import explode_attributes, index_attributes
from txloom.operators.matching import tx_antijoin, tx_outer_flags, tx_semijoin

NAMES = {
    "exists": "attr_exists", "not exists": "attr_not_exists", "=": "attr_eq", "!=": "attr_ne",
    ">": "attr_gt", ">=": "attr_ge", "<": "attr_lt", "<=": "attr_le",
    "includes": "attr_includes", "not includes": "attr_not_includes",
    "like": "attr_like", "not like": "attr_not_like", "in": "attr_in", "not in": "attr_not_in",
}


def on_map(path, op, arg):
    return getattr(P, NAMES[op])(path, *([] if arg is None else [arg]))


def on_rows(path, op, arg):
    name = "attr_exists" if op == "not exists" else NAMES[op]
    return getattr(R, name)(path, *([] if arg is None else [arg]))


def eq(p, v):
    return lambda: P.attr_eq(p, v)


CASES = [
    ({"a": ["x", "y"]}, lambda: P.attr_ne("a", "x"), True),
    ({"a": ["x"]}, lambda: P.attr_ne("a", "x"), False),
    ({}, lambda: P.attr_ne("a", "x"), False),
    ({}, lambda: P.attr_not_exists("a"), True),
    ({"a": []}, lambda: P.attr_exists("a"), False),
    ({"h": ["150"]}, lambda: P.attr_eq("h", "0150"), False),
    ({"h": ["150"]}, lambda: P.attr_eq("h", 150), True),
    ({"m": ["10uscrt"]}, lambda: P.attr_gt("m", 5), False),
    ({"m": ["10uscrt", "1uatom"]}, lambda: P.attr_gt("m", "5uscrt"), True),
    ({"m": ["1uscrt", "10uatom"]}, lambda: P.attr_gt("m", "5uscrt"), False),
    ({"m": ["9" * 78]}, lambda: P.attr_gt("m", "9" * 77), True),
    ({"m": ["1u,2v"]}, lambda: P.attr_gt("m", 0), False),
    ({"m": ["-7"]}, lambda: P.attr_lt("m", -6), True),
    # Three-way AND, and OR below AND.
    ({"a": ["1"], "b": ["2"], "c": ["3"]},
     lambda: P.attr_eq("a", 9) & P.attr_eq("b", 2) & P.attr_eq("c", 3), False),
    ({"a": ["1"], "b": ["2"]},
     lambda: P.attr_eq("a", 1) & (P.attr_eq("b", 2) | P.attr_eq("c", 3)), True),
    ({"t": ["a\nb"]}, lambda: P.attr_like("t", "a%b"), False),
    ({"t": ["gray_1"]}, lambda: P.attr_like("t", "gray%"), True),
    ({"t": ["gray_1"]}, lambda: P.attr_like("t", "ray%"), False),
    ({"t": ["a.b"]}, lambda: P.attr_like("t", "a.b"), True),
    ({"t": ["axb"]}, lambda: P.attr_like("t", "a.b"), False),
    ({"w.x": ["1"], "w.y": ["2"]}, lambda: P.attr_eq("w.*", 2), True),
    ({"w.x": ["1"], "wy": ["2"]}, lambda: P.attr_eq("w.*", 2), False),
    ({"w.x": []}, lambda: P.attr_not_exists("w.*"), True),
    ({"t": ["a"]}, lambda: P.attr_in("t", ["a", "b", "a"]), True),
    ({"t": ["5"]}, lambda: P.attr_in("t", [5]), True),
    ({"t": ["c"]}, lambda: P.attr_in("t", []), False),
    ({"t": ["c"]}, lambda: P.attr_not_in("t", []), True),
    # The only worked example of the query language.
    ({"tx.height": ["120", "1251"], "transfer.amount": ["6000uscrt"]},
     lambda: P.attr_gt("tx.height", 1250) & P.attr_gt("transfer.amount", "500uscrt")
     | P.attr_eq("tx.height", 150), True),
    # Different values of a list may satisfy different conditions.
    ({"m": ["1u", "9u"]}, lambda: P.attr_gt("m", "8u") & P.attr_lt("m", "2u"), True),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(tx_of, i):
    events, make, expected = CASES[i]
    assert tx_of(events).select(make().alias("v")).first().v is expected


def test_null_values_and_maps_never_give_null(spark):
    rows = [(1, {"a": [None]}), (2, {"a": None}), (3, None)]
    df = spark.createDataFrame(rows, "tx_id long, events map<string,array<string>>")
    filters = [P.attr_exists("a"), P.attr_not_exists("a"), P.attr_eq("a", "x"), P.attr_ne("a", "x")]
    filters += [P.attr_gt("a", 1), P.attr_like("a", "%"), P.attr_in("a", ["x"]), P.attr_not_in("a", ["x"])]
    filters += [P.attr_eq("a*", "x"), P.attr_includes("a", "x"), P.attr_not_like("a", "x")]
    for row in df.select(*[f.alias(str(i)) for i, f in enumerate(filters)]).collect():
        assert all(v is not None for v in row)


def test_paths_are_checked():
    for bad in ["", "a`b", "a\nb", "x" * 513]:
        with pytest.raises(ValueError):
            P.check_path(bad)


def test_random_filters_on_maps_rows_and_in_python(tx_of):
    rng = random.Random(3)
    maps = [model.random_events(rng) for _ in range(150)]
    txs = tx_of(*maps).cache()
    attrs = index_attributes(explode_attributes(txs)).cache()
    conditions = [model.random_condition(rng) for _ in range(60)]

    flags = {f"c{i}": on_map(*c) for i, c in enumerate(conditions)}
    for row in txs.select("tx_id", *[f.alias(n) for n, f in flags.items()]).collect():
        for i, c in enumerate(conditions):
            assert row[f"c{i}"] == model.holds(maps[row.tx_id - 1], *c), (maps[row.tx_id - 1], c)

    for c in conditions[:14]:
        join = tx_antijoin if c[1] == "not exists" else tx_semijoin
        found = {r.tx_id for r in join(txs.select("tx_id"), attrs, on_rows(*c)).collect()}
        assert found == {i + 1 for i, m in enumerate(maps) if model.holds(m, *c)}, c


def test_random_trees_by_flags(tx_of):
    rng = random.Random(4)
    maps = [model.random_events(rng) for _ in range(120)]
    txs = tx_of(*maps).cache()
    attrs = index_attributes(explode_attributes(txs)).cache()
    for _ in range(6):
        groups = [[model.random_condition(rng) for _ in range(rng.randint(1, 3))] for _ in range(2)]
        conditions, ors = {}, []
        for group in groups:
            ands = []
            for c in group:
                name = f"f{len(conditions)}"
                conditions[name] = on_rows(*c)
                ands.append(~F.col(name) if c[1] == "not exists" else F.col(name))
            ors.append(reduce(lambda a, b: a & b, ands))
        where = ors[0] | ors[1]
        found = {r.tx_id for r in tx_outer_flags(txs.select("tx_id"), attrs, conditions, where).collect()}
        mapped = reduce(lambda a, b: a | b, [P.all_of(*[on_map(*c) for c in g]) for g in groups])
        assert found == {r.tx_id for r in txs.where(mapped).select("tx_id").collect()}
        assert found == {
            i + 1 for i, m in enumerate(maps) if any(all(model.holds(m, *c) for c in g) for g in groups)
        }


def test_long_values_are_found_by_fingerprint(tx_of):
    long = "y" * 9000
    txs = tx_of({"a": [long]}, {"a": [long + "!"]}, {"a": [long, "z"]})
    attrs = index_attributes(explode_attributes(txs)).drop("value").withColumn("value", F.lit("not read"))
    for condition, expected in [(R.attr_eq("a", long), {1, 3}), (R.attr_ne("a", long), {2, 3})]:
        assert {r.tx_id for r in tx_semijoin(txs, attrs, condition).select("tx_id").collect()} == expected
    assert {r.tx_id for r in txs.where(P.attr_ne("a", long)).select("tx_id").collect()} == {2, 3}


def test_conditions_reach_the_scan(spark, tmp_path):
    attrs = index_attributes(spark.createDataFrame([(1, "a", "5u")], "tx_id long, path string, value string"))
    attrs.write.parquet(str(tmp_path / "attrs"))
    found = spark.read.parquet(str(tmp_path / "attrs")).where(R.attr_gt("a", "3u")).select("tx_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1].split("]")[0]
    assert all(part in pushed for part in ("EqualTo(path,a)", "EqualTo(unit,u)", "GreaterT"))  # cut off there
