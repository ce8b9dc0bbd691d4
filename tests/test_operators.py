import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from txloom.functions import predicates as P
from txloom.functions import rowwise as R
from txloom.functions import values as V
from txloom.operators import attributes as A
from txloom.operators import delivery as D
from txloom.operators import dictionary as X
from txloom.operators import ids as I
from txloom.operators import matching as M
from txloom.operators import retention as E
from txloom.operators import skew
from txloom.plans import search as S
from txloom.session import stored

LOGS = "tx_id long, result struct<log:string>"


def test_explode_and_build_are_inverse(tx_of):
    maps = [{"a": ["x", "x", "b"], "b": ["1"]}, {"a": ["z"], "empty": []}, {}]
    attrs = A.explode_attributes(tx_of(*maps))
    rebuilt = {r.tx_id: r.events for r in A.build_event_map(attrs).collect()}
    # A path without values has no rows to be rebuilt from.
    assert rebuilt == {1: maps[0], 2: {"a": ["z"]}}


def test_build_event_map_shuffles_once(tx_of):
    attrs = A.explode_attributes(tx_of({"a": ["x"]})).repartition(3)
    plan = A.build_event_map(attrs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_build_event_map_leaves_rows_that_lie_together(tx_of):
    maps = [{"a": ["x", "x", "b"], "b": ["1"]}, {"a": ["z"], "b": ["y", "x"]}]
    attrs = A.explode_attributes(tx_of(*maps))
    rebuilt = A.build_event_map(attrs.repartition(3, "tx_id"), together=True)
    assert rebuilt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    scattered = A.build_event_map(attrs.repartition(3), together=True)
    for found in (rebuilt, scattered):
        assert {r.tx_id: r.events for r in found.collect()} == {1: maps[0], 2: maps[1]}


def test_distinct_paths_counts_empty_lists(tx_of):
    found = A.distinct_paths(tx_of({"a": ["x"], "b": []}, {"a": []})).collect()
    assert {r.path for r in found} == {"a", "b"}


def test_flatten_result_events(spark):
    schema = (
        "tx_id long, result struct<events:array<struct<type:string,"
        "attributes:array<struct<key:string,value:string,index:boolean>>>>>"
    )
    events = [("transfer", [("amount", "5u", True), ("amount", "6u", None)]), ("wasm", []), ("message", None)]
    rows = A.flatten_result_events(spark.createDataFrame([(1, (events,))], schema)).collect()
    assert [(r.event_no, r.path, r.value, r.indexed) for r in rows] == [
        (0, "transfer.amount", "5u", True),
        (0, "transfer.amount", "6u", False),
    ]


def test_parse_logs(spark):
    log = (
        '[{"msg_index":0,"events":[{"type":"t","attributes":[{"key":"k","value":"v"}]}],"note":{"a":1}},'
        '{"log":"only text"}]'
    )
    logs = ["[]", log, "out of gas", '{"an":"object"}', "[broken", "", None]
    df = spark.createDataFrame([(i, (t,)) for i, t in enumerate(logs)], LOGS)
    parsed = A.parse_logs(df)
    rows = {(r.tx_id, r.log_no): r for r in parsed.collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0)}
    assert rows[1, 0].other == {"msg_index": "0", "note": '{"a":1}'} and rows[1, 0].plain is None
    assert rows[1, 1].other == {"log": "only text"} and rows[1, 1].events is None
    assert [rows[i, 0].plain for i in (2, 3, 4, 5)] == logs[2:6]
    assert [(r.path, r.value) for r in A.log_attributes(parsed).collect()] == [("t.k", "v")]


@pytest.mark.parametrize("start", [0, 41])
def test_assign_ids_with_one_frequent_leading_value(spark, start):
    # Almost all rows share the first column of the order.
    df = spark.range(5000).select((F.col("id") % 100 == 0).cast("int").alias("height"), F.xxhash64("id").alias("h"))
    rows = I.assign_ids(df, ["height", "h"], "n", start).collect()
    assert [r.n for r in sorted(rows, key=lambda r: (r.height, r.h))] == list(range(start + 1, start + 5001))


def test_assign_ids_survives_a_second_read_and_a_union(spark):
    df = I.assign_ids(spark.range(2315).select(F.xxhash64("id").alias("h")), ["h"], "n")
    other = spark.createDataFrame([(0, 0)], "h long, n long")
    both = df.unionByName(other)
    assert both.select("n").distinct().count() == 2316
    assert df.join(df.withColumnRenamed("n", "m"), "h").where("n <> m").count() == 0


def test_assign_ids_of_nothing(spark):
    assert I.assign_ids(spark.range(0).toDF("h"), ["h"], "n").count() == 0


def test_assign_ids_by_hash(spark):
    df = spark.range(3000).select(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))).alias("h"))
    rows = I.assign_ids_by_hash(df, "h", "n", 10).collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.h)] == list(range(11, 3011))


def test_row_positions_over_sparse_ids(spark):
    rng = random.Random(5)
    ids = sorted(rng.sample(range(1 << 45), 500)) + list(range(1 << 50, (1 << 50) + 300))
    df = spark.createDataFrame([(i,) for i in ids], "tx_id long")
    rows = sorted(I.row_positions(df, "tx_id").collect(), key=lambda r: r.tx_id)
    assert [r.row_idx for r in rows] == list(range(800)) and {r.row_total for r in rows} == {800}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spreading_hot_keys_changes_nothing(spark, how):
    left = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.col("id").cast("string")).alias("k"),
        "id",
    )
    right = spark.range(400).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    right = right.unionByName(spark.createDataFrame([("hot", -1), ("hot", -2), (None, -3)], "k string, v long"))
    assert [tuple(r) for r in skew.hot_keys(left, "k", 100).collect()] == [("hot", 3)]
    expected = left.join(right, "k", how)
    for spread in (
        skew.join_spreading_hot_keys(left, right, "k", ["id"], how, hot_rows=100),
        skew.join_with_salts(left, right, "k", ["id"], how, hot_rows=100),
    ):
        assert spread.columns == expected.columns
        assert sorted(map(str, spread.collect())) == sorted(map(str, expected.collect()))


def test_every_hot_key_is_spread(spark):
    left = spark.range(9000).select((F.col("id") % 1500).alias("k"), "id")
    left = left.unionByName(spark.range(100).select(F.lit(7).cast("long").alias("k"), (F.col("id") + 9000).alias("id")))
    right = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    salts = {r.k: r["_salts"] for r in skew.hot_keys(left, "k", 6).collect()}
    assert len(salts) == 1500 and salts[7] == 18 and salts[8] == 2
    joined = skew.join_with_salts(left, right, "k", ["id"], "inner", hot_rows=6)
    assert joined.count() == 9100 and joined.where("v != 2 * k").isEmpty()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_rows_of_frequent_keys_are_not_shuffled(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(skew, "FREQUENT_KEYS", 3)
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).when(F.col("id") % 50 != 0, F.col("id")).alias("k"), "id"
    )
    right = spark.range(1, 400, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    right = right.unionByName(spark.createDataFrame([(1, -1), (None, -2)], "k long, v long"))
    joined = skew.join_spreading_hot_keys(left, right, "k", ["id"], how)
    expected = left.join(right, "k", how)
    assert joined.columns == expected.columns
    assert sorted(map(str, joined.collect())) == sorted(map(str, expected.collect()))
    # Frequent keys by broadcast, the others apart from them.
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "LeftAnti" in plan


def test_attributes_are_rehydrated_without_a_shuffle(spark):
    ids = [None, -65, -64, -1, 0, 1, 63, 64, 127, 128, 1 << 40, (1 << 62) + 63]
    attrs = spark.createDataFrame([(i, "p", f"{i}/{j}") for i in ids for j in (1, 2)], "tx_id long, path string, value string")
    for chosen in (ids[::2], ids[1::2], ids, []):
        selected = spark.createDataFrame([(i,) for i in chosen] * 2, "tx_id long")
        found = M.rehydrate(attrs, selected)
        want = sorted(f"{i}/{j}" for i in chosen if i is not None for j in (1, 2))
        assert found.columns == attrs.columns and sorted(r.value for r in found.collect()) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan
    named = attrs.withColumn("tx_id", F.col("tx_id").cast("string"))
    assert M.rehydrate(named, named.limit(0)).count() == 0


def test_as_many_keys_are_frequent_as_may_be(spark):
    counts = spark.createDataFrame([(1, 5000), (2, 300), (3, 300), (4, 70)], "k long, _n long")
    assert [skew.frequent_rows(counts, n) for n in (0, 1, 2, 3, 4)] == [None, 4096, 4096, 256, 64]
    assert skew.frequent_rows(counts.limit(0)) is None


def test_facts_are_coded_without_a_shuffle_by_path(spark, tx_of):
    """Twelve paths would be as many tasks, however many rows there are."""
    attrs = A.explode_attributes(tx_of({"a": ["x", "y"], "b": ["x"]}))
    paths = I.assign_ids(attrs.select(F.col("path").alias("path_text")).distinct(), ["path_text"], "path_id")
    values = I.assign_ids_by_hash(X.value_keys(attrs), "value_hash", "value_id")
    facts = X.encode_attributes(attrs, paths, values)
    back = X.decode_facts(facts, paths, values)
    for coded in (facts, back):
        plan = coded._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join Inner" in line and "path_" in line]
        assert joins and all("strategy=broadcast" in line for line in joins)
    assert sorted(map(tuple, back.collect())) == [(1, "a", "x"), (1, "a", "y"), (1, "b", "x")]


def test_a_machine_local_folder_is_for_local_masters_only():
    from txloom import session

    for master in ("local", "local[4]", "local[*]", "local[2,3]"):
        assert session.local_folder(master)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            session.local_folder(master)


def test_positions_evaluate_their_input_twice(spark, tmp_path):
    spark.range(5000).select((F.col("id") * 3).alias("tx_id")).write.parquet(str(tmp_path / "ids"))
    plan = I.row_positions(spark.read.parquet(str(tmp_path / "ids")), "tx_id")._jdf.queryExecution().executedPlan().toString()
    # The other evaluation is the saved count per range.
    assert plan.count("FileScan parquet") == 1


def test_conditions_are_not_named_like_columns(tx_of):
    txs = tx_of({"a": ["1"]}).withColumn("height", F.lit(1))
    attrs = A.explode_attributes(txs)
    with pytest.raises(ValueError):
        M.tx_outer_flags(txs, attrs, {"height": F.col("value") == "1"}, F.col("height"))


def test_upserts(spark, tx_of):
    txs = tx_of({"b": ["5u", "5u"], "a": ["x"]}, {"c": ["y", "z" * 9000], "a": ["5u"]})
    none = spark.createDataFrame([], "path_id long, path_text string")
    first = X.upsert_paths(X.path_keys(txs.where("tx_id = 1")), none)
    assert {(r.path_id, r.path_text) for r in first.found.collect()} == {(1, "a"), (2, "b")}
    second = X.upsert_paths(X.path_keys(txs.where("tx_id = 2")), first.new)
    # Only the requested keys are returned, known or new.
    assert {(r.path_id, r.path_text) for r in second.found.collect()} == {(1, "a"), (3, "c")}
    assert [(r.path_id, r.path_text) for r in second.new.collect()] == [(3, "c")]

    attrs = A.explode_attributes(txs)
    empty = spark.createDataFrame([], "value_id long, value_hash string, qty_text string, qty_key string, "
                                      "unit string, value_text string, value_bytes binary")
    values = X.upsert_values(X.value_keys(attrs), empty).new
    rows = values.collect()
    assert sorted(r.value_id for r in rows) == [1, 2, 3, 4]
    assert [r.value_id for r in sorted(rows, key=lambda r: r.value_hash)] == [1, 2, 3, 4]
    assert X.upsert_values(X.value_keys(attrs), values).new.count() == 0

    paths = first.new.unionByName(second.new)
    facts = X.encode_attributes(attrs, paths, values)
    assert facts.count() == 6  # repeats stay
    decoded = X.decode_facts(facts, paths, values)
    as_set = lambda df: sorted((r.tx_id, r.path, r.value) for r in df.collect())
    assert as_set(decoded) == as_set(attrs)
    found = M.matching_facts(facts, paths, values, "*", R.attr_ge("*", "5u"))
    assert as_set(found) == [(1, "b", "5u"), (1, "b", "5u"), (2, "a", "5u")]


def test_matches_come_once(tx_of):
    txs = tx_of({"a": ["1", "2", "3"]}, {"a": ["1"]}, {})
    attrs = A.index_attributes(A.explode_attributes(txs))
    assert sorted(r.tx_id for r in M.tx_semijoin(txs, attrs, R.attr_gt("a", 0)).collect()) == [1, 2]
    assert [r.tx_id for r in M.tx_antijoin(txs, attrs, R.attr_gt("a", 0)).collect()] == [3]
    only = M.tx_semijoin(txs, attrs, R.attr_gt("a", 2))
    assert sorted((r.path, r.value) for r in M.rehydrate(attrs, only).collect()) == [("a", "1"), ("a", "2"), ("a", "3")]


def test_attr_in_table(spark, tx_of):
    txs = tx_of({"a": ["1", "2"]}, {"a": ["3"]}, {"b": ["1"]})
    members = spark.createDataFrame([("1",), ("1",), ("9",)], "value string")
    found = M.attr_in_table(txs, A.explode_attributes(txs), "a", members)
    assert [r.tx_id for r in found.collect()] == [1]


def test_flags_become_an_inner_join_where_a_match_is_needed(tx_of):
    txs = tx_of({"a": ["1"]})
    attrs = A.index_attributes(A.explode_attributes(txs))
    conditions = {"x": R.attr_eq("a", 1), "y": R.attr_exists("b")}
    plan = lambda w: M.tx_outer_flags(txs, attrs, conditions, w)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan(F.col("x") & ~F.col("y"))
    assert "Join LeftOuter" in plan(~F.col("y"))


def test_pages(spark):
    df = spark.range(30_000).select((F.col("id") * 3).alias("tx_id")).repartition(7)
    ids = lambda d: [r.tx_id for r in d.collect()]
    assert ids(D.page(df, 5, 10)) == [30, 33, 36, 39, 42]
    assert ids(D.page(df, 4, 20_000)) == [60_000, 60_003, 60_006, 60_009]
    assert ids(D.page(df, 50, 29_998)) == [89_994, 89_997]
    assert ids(D.page(df, 0, 3)) == []
    for limit, offset in [(-1, 0), (1, -1), (1.5, 0), (True, 0)]:
        with pytest.raises(ValueError):
            D.page(df, limit, offset)


def test_list_attributes(spark):
    paths = spark.createDataFrame(
        [(3, "c"), (1, "wasm.x"), (2, "b"), (4, "wasmx"), (5, "d")], "path_id long, path_text string"
    )
    names = lambda *a: [r.path_text for r in D.list_attributes(paths, *a).collect()]
    assert names(1024, 0) == ["b", "c", "wasmx", "d"]
    assert names(2, 1) == ["c", "wasmx"]
    assert names(0, 0) == []
    for limit, offset in [(1025, 0), (-1, 0), (1, -1), (1.0, 0)]:
        with pytest.raises(ValueError):
            D.list_attributes(paths, limit, offset)


@pytest.mark.parametrize("count, batches", [(0, []), (3, [3]), (4, [4]), (9, [4, 4, 1])])
def test_deliver_batches(spark, count, batches):
    df = spark.range(count).select((F.col("id") * 1_000_003).alias("tx_id"))
    rows = sorted(D.deliver_batches(df, 4).collect(), key=lambda r: r.tx_id)
    sizes: dict = {}
    for r in rows:
        sizes[r.batch_no] = sizes.get(r.batch_no, 0) + 1
        assert r.finished == (r.batch_no == len(batches) - 1)
    assert list(sizes.values()) == batches and [r.batch_no for r in rows] == sorted(r.batch_no for r in rows)


def test_retention_keeps_the_boundary(spark):
    now = datetime(2024, 1, 31)
    rows = [(1, datetime(2024, 1, 17)), (2, datetime(2024, 1, 16, 23, 59, 59)), (3, now)]
    kept = E.expire_transactions(spark.createDataFrame(rows, "tx_id long, ts timestamp"), F.lit(now))
    assert sorted(r.tx_id for r in kept.collect()) == [1, 3]
    facts = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "tx_id long, path string")
    assert [r.tx_id for r in E.cascade_expire(facts, kept).collect()] == [1, 1]


def test_result_table(tx_of):
    txs = tx_of(
        {"tx.hash": ["A"], "p": ["2", "1", "2"]}, {"tx.hash": ["B"], "p": []}, {"tx.hash": ["C"]}
    ).withColumn("height", F.col("tx_id") * 10)
    table = S.result_table(txs, P.attr_exists("tx.hash"), ["p", "tx.hash", "p", "tm.event"])
    assert table.columns == ["tx_id", "height", "hash", "p"]
    assert [(r.height, r.hash, r.p) for r in table.collect()] == [
        (30, "C", ["(none)"]), (20, "B", ["(none)"]), (10, "A", ["2", "1"]),
    ]
    assert S.match_count(txs, P.attr_exists("p")).first().matches == 1
    assert [r.tx_id for r in D.height_range(txs, 20, 30).orderBy("tx_id").collect()] == [2, 3]


def test_limits_on_computed_quantities_match_the_pattern_once(spark, tx_of):
    maps = [{"a": ["15u", "x"], "b": ["3"]}, {"a": ["5u", "-0150u"], "b": ["7"]}, {"a": ["ibc/1"], "b": [None, "+4"]}]
    attrs = A.index_attributes(A.explode_attributes(tx_of(*maps)))
    conditions = {"rich": R.attr_gt("a", "9u"), "few": R.attr_le("b", 4)}
    headers = spark.range(1, 4).withColumnRenamed("id", "tx_id")
    found = M.tx_outer_flags(headers, attrs, conditions, F.col("rich") | F.col("few"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1
    assert sorted(r.tx_id for r in found.collect()) == [1, 3]


def test_unit_follows_the_digits(spark):
    long_unit, longest = "ibc/" + "AB12" * 16, "9" * 78
    values = ["5", "-07u", "+3ibc/1", f"1{long_unit}", f"{longest}7", f"{longest}", "u5", "", "5U", "5factory/x é", "5factory/xé", None]
    rows = spark.createDataFrame([(v,) for v in values], "value string").select("value", V.quantity_text("value").alias("t"))
    rows = rows.select("t", V.unit_after("value", "t").alias("after"), V.quantity_unit("value").alias("unit")).collect()
    assert [r.after for r in rows] == [r.unit for r in rows]
    assert [r.t for r in rows][:6] == ["5", "-07", None, "1", longest, longest]
    assert rows[4].unit == "7" and rows[3].unit == long_unit


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_stored_tables_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    counted = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert counted.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_value_dictionary_is_numbered_by_fingerprint(spark):
    values = ["7uscrt", "b", "7uscrt", None, "", "x" * 9000, "-12", "é"]
    attrs = spark.createDataFrame([(i, "p", v) for i, v in enumerate(values)], "tx_id long, path string, value string")
    want = I.assign_ids_by_hash(X.value_keys(attrs), "value_hash", "value_id")
    found = X.value_dictionary(attrs)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("hashed", [True, False])
def test_facts_are_joined_by_a_short_key(spark, monkeypatch, hashed):
    """Neither texts nor fingerprints are shuffled with the facts; null fingerprints meet none."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    attrs = spark.createDataFrame([(i, "p", f"v{i % 5}") for i in range(20)] + [(99, "p", None)], "tx_id long, path string, value string")
    values = X.value_dictionary(attrs).unionByName(
        spark.createDataFrame([(77,)], "value_id long"), allowMissingColumns=True
    )
    paths = spark.createDataFrame([(3, "p")], "path_id long, path_text string")
    if hashed:
        attrs = attrs.withColumn("value_hash", F.when(F.col("tx_id") != 6, V.value_fingerprint("value")))
    found = X.encode_attributes(attrs, paths, values)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(value_hash" in line]
    ids = {r.value_text: r.value_id for r in values.where("value_hash IS NOT NULL").collect()}
    want = sorted((i, 3, ids[f"v{i % 5}"]) for i in range(20) if not (hashed and i == 6))
    assert sorted(map(tuple, found.collect())) == want
