import json
import random
import time
from datetime import datetime, timedelta

import model
import pytest
from pyspark.sql import functions as F

from test_predicates import on_map
from txloom.functions import predicates as P
from txloom.operators.dictionary import decode_facts
from txloom.plans import search as S
from txloom.sources import messages as G
from txloom.sources import store
from txloom.sources import warehouse as W
from txloom.streaming import conditions as C
from txloom.streaming import indexing as N
from txloom.streaming import live as L


def tx_message(height, events, **result):
    body = {"height": str(height), "index": 0, "tx": "dHg=", "result": {"code": 0, "gas_used": "7", **result}}
    data = {"type": "tendermint/event/Tx", "value": {"TxResult": body}}
    return json.dumps({"jsonrpc": "2.0", "id": 1, "result": {"data": data, "events": {"tm.event": ["Tx"], **events}}})


def block_message(height, time="2024-01-01T00:00:00.123456789Z"):
    data = {"type": "tendermint/event/NewBlock", "value": {"block": {"header": {"height": str(height), "time": time}}}}
    return json.dumps({"result": {"data": data, "events": {"tm.event": ["NewBlock"]}}})


BAD = ['{"error": {"code": -5, "message": "no"}}', "{broken", "", '{"result": null}']


def test_messages_are_sorted_out(spark):
    texts = [tx_message(5, {"tx.hash": ["AB"]}), block_message(9), '{"result": {}}', *BAD]
    accepted, rejected = G.parse_messages(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert accepted.count() == 3
    assert sorted((r.reason, r.value) for r in rejected.collect()) == sorted(
        [("error", BAD[0]), ("unreadable", BAD[1]), ("unreadable", BAD[2]), ("unreadable", BAD[3])]
    )
    txs, blocks = G.route_by_type(accepted)
    (row,) = G.transaction_rows(txs).collect()
    assert (row.height, row.tx_hash, bytes(row.tx_bytes), row.result.gas_used) == (5, "AB", b"tx", 7)
    (header,) = G.block_headers(blocks).collect()
    assert (header.height, header.time) == (9, datetime(2024, 1, 1, 0, 0, 0, 123456))


def test_messages_are_parsed_once(spark):
    raw = spark.createDataFrame([("{}",)], "value string")
    rows = G.transaction_rows(G.route_by_type(G.parse_messages(raw)[0])[0])
    assert rows._jdf.queryExecution().executedPlan().toString().count("from_json") == 1


@pytest.mark.parametrize(
    "heights, expected", [([5, 9, 7], (5, 7)), ([0, 4, 2], (4, 2)), ([0], (0, 0)), ([], (0, 0))]
)
def test_height_span(spark, heights, expected):
    df = spark.createDataFrame(list(enumerate(heights)), "arrival long, height long")
    assert tuple(G.height_span(df, "arrival").first()) == expected


def write_lines(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_index_in_two_batches_and_again(spark, tmp_path):
    inbox, root, check = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "check")
    write_lines(inbox, "1.json", [
        tx_message(2, {"tx.hash": ["B"], "m.a": ["5u", "5u"], "wasm.k": ["1"]}),
        tx_message(1, {"tx.hash": ["A"], "m.a": ["6u"], "e": []}), *BAD,
    ])
    arrival = F.to_timestamp(F.lit("2024-01-01"))

    def run():
        raw = G.stream_messages(spark, str(inbox), 1)
        N.stream_index(raw, root, check, arrival).awaitTermination()

    run()
    long = "z" * 9000
    write_lines(inbox, "2.json", [tx_message(3, {"tx.hash": ["C"], "m.a": ["5u", long], "n": ["x"]})])
    run()

    def table(name):
        return store.read_table(spark, root, name)

    assert [(r.tx_id, r.height, r.tx_hash) for r in table("transactions").orderBy("tx_id").collect()] == [
        (1, 1, "A"), (2, 2, "B"), (3, 3, "C"),
    ]
    paths = {r.path_text: r.path_id for r in table("paths").collect()}
    assert sorted(paths.values()) == list(range(1, len(paths) + 1)) and paths["n"] == max(paths.values())
    values = [r.value_id for r in table("values").collect()]
    assert sorted(values) == list(range(1, len(values) + 1))

    def facts():
        decoded = decode_facts(table("facts"), table("paths"), table("values"))
        return sorted((r.tx_id, r.path, r.value) for r in decoded.collect())

    before = facts()
    assert before == sorted((r.tx_id, r.path, r.value) for r in table("attrs").collect())
    assert before.count((2, "m.a", "5u")) == 2 and (3, "m.a", long) in before
    assert table("rejected").count() == 4

    # The second batch once more, as after a failure: nothing changes.
    rows = table("transactions").where("tx_id = 3").drop("tx_id").select(
        "height", "tx_hash", "ts", "tx_bytes", "tx_index", "result", "events"
    )
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    store.index_batch(spark, root, rows, 1)
    assert facts() == before

    found = S.search_txs(table("transactions"), P.attr_eq("m.a", long), "long")
    assert [(r.tx_id, r.tx, r.query) for r in found.collect()] == [(3, "dHg=", "long")]


def test_a_batch_without_transactions(spark, tmp_path):
    root = str(tmp_path / "store")
    for batch, texts in enumerate([BAD, [tx_message(1, {"tx.hash": ["A"]})], [block_message(3)]]):
        raw = spark.createDataFrame([(t,) for t in texts], "value string")
        store.index_batch(spark, root, G.transaction_rows(G.route_by_type(G.parse_messages(raw)[0])[0]), batch)
    assert [r.tx_id for r in store.read_table(spark, root, "transactions").collect()] == [1]
    assert store._last_committed(spark, root).last_tx_id == 1


def test_a_batch_without_progress_is_not_visible(spark, tmp_path):
    root = str(tmp_path / "store")
    raw = spark.createDataFrame([(tx_message(1, {"tx.hash": ["A"]}),)], "value string")
    rows = G.transaction_rows(G.route_by_type(G.parse_messages(raw)[0])[0])
    store.index_batch(spark, root, rows, 0)
    # A later batch that failed half-way.
    store._write(store.append_transactions(rows, 1), root, "transactions", 1)
    assert store.read_table(spark, root, "transactions").count() == 1
    store.index_batch(spark, root, rows, 1)
    assert sorted(r.tx_id for r in store.read_table(spark, root, "transactions").collect()) == [1, 2]


def test_expiry_hides_rows_and_deletes_old_batches(spark, tmp_path):
    root, now = str(tmp_path / "store"), datetime(2024, 1, 31)
    for batch, days in enumerate([[20, 19], [15, 3], [2]]):
        texts = [(tx_message(d, {"tx.hash": [f"{batch}-{d}"]}), now - timedelta(days=d)) for d in days]
        raw = spark.createDataFrame(texts, "value string, at timestamp")
        txs, _ = G.route_by_type(G.parse_messages(raw)[0])
        store.index_batch(spark, root, G.transaction_rows(txs, F.col("at")), batch)
    # Hidden at once, deleted by the next run with a later cutoff.
    assert store.expire_store(spark, root, now) == 0
    assert store.expire_store(spark, root, now) == 0
    assert store.expire_store(spark, root, now + timedelta(seconds=1)) == 1
    assert store.expire_store(spark, root, now + timedelta(seconds=2)) == 0
    # An earlier clock brings nothing back.
    assert store.expire_store(spark, root, now - timedelta(days=30)) == 0
    for name in ("transactions", "attrs", "facts"):
        # The one of height 3 has the lower id of its batch.
        assert {r.tx_id for r in store.read_table(spark, root, name).select("tx_id").collect()} == {3, 5}
    assert not (tmp_path / "store" / "transactions" / "batch_id=0").exists()
    assert (tmp_path / "store" / "transactions" / "batch_id=1").exists()
    assert store.read_table(spark, root, "values").count() > 0
    assert store._last_committed(spark, root, 3).last_tx_id == 5


def test_retention_runs_again_and_again(spark, tmp_path):
    root, now = str(tmp_path / "store"), datetime.now()

    def add(batch, days):
        raw = spark.createDataFrame([(tx_message(1, {"tx.hash": [f"{batch}"]}),)], "value string")
        txs, _ = G.route_by_type(G.parse_messages(raw)[0])
        store.index_batch(spark, root, G.transaction_rows(txs, F.lit(now - timedelta(days=days))), batch)

    add(0, 20)
    add(1, 1)
    folder = tmp_path / "store" / "transactions"
    query = N.stream_retention(spark, root, str(tmp_path / "check"), every="1 second")
    try:
        # The first run hides the old batch, a later one deletes its files.
        assert store.read_table(spark, root, "transactions").count() == 1
        add(2, 16)
        add(3, 1)
        deadline = time.time() + 60
        while any((folder / f"batch_id={i}").exists() for i in (0, 2)) and time.time() < deadline:
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(p.name for p in folder.iterdir()) == ["batch_id=1", "batch_id=3"]


def random_conditions(rng, n):
    held, meaning = [], {}
    for s in range(n):
        clauses = []
        for clause in range(rng.randint(1, 2)):
            parts = [model.random_condition(rng) for _ in range(rng.randint(1, 3))]
            clauses.append(parts)
            for number, (path, op, arg) in enumerate(parts):
                members = arg if isinstance(arg, list) else None
                held.append((f"s{s}", clause, number, path, op, None if members else arg, members))
        meaning[f"s{s}"] = clauses
    return held, meaning


@pytest.mark.parametrize("broadcast_rows, carried", [(10_000, 256), (10_000, 4), (0, 256)])
def test_condition_table_equals_expressions_and_python(spark, tx_of, monkeypatch, broadcast_rows, carried):
    from txloom.operators import skew

    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(C, "CARRIED_VALUES", carried)
    rng = random.Random(6)
    maps = [model.random_events(rng) for _ in range(100)]
    held, meaning = random_conditions(rng, 40)
    txs = tx_of(*maps)
    found = C.fan_out_table(txs, spark.createDataFrame(held, C.CONDITIONS_DDL))
    pairs = [(r.tx_id, r.sub_id) for r in found.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {
        (i + 1, s)
        for i, m in enumerate(maps)
        for s, clauses in meaning.items()
        if any(all(model.holds(m, *c) for c in parts) for parts in clauses)
    }
    filters = {s: P.any_of(*[P.all_of(*[on_map(*c) for c in parts]) for parts in cs]) for s, cs in list(meaning.items())[:12]}
    by_expression = {(r.tx_id, r.sub_id) for r in L.fan_out(txs, filters).select("tx_id", "sub_id").collect()}
    assert by_expression == {p for p in pairs if p[1] in filters}


def test_condition_table_refuses_unknown_operators(spark, tx_of):
    for ops in (["~"], ["=", "matches"]):
        held = [("s", 0, i, "a", op, "x", None) for i, op in enumerate(ops)]
        with pytest.raises(ValueError):
            C.fan_out_table(tx_of({"a": ["x"]}), spark.createDataFrame(held, C.CONDITIONS_DDL))


def test_condition_table_with_single_conditions_and_no_map(spark):
    txs = spark.createDataFrame([(1, {"a": ["5u"]}), (2, None)], "tx_id long, events map<string,array<string>>")
    held = [("gt", 0, 0, "a", ">", "4u", None), ("no", 0, 0, "a", "not exists", None, None)]
    for n in (1, 2):
        found = C.fan_out_table(txs, spark.createDataFrame(held[:n], C.CONDITIONS_DDL)).collect()
        assert sorted((r.tx_id, r.sub_id) for r in found) == [(1, "gt"), (2, "no")][:n]


def test_each_subscription_gets_its_own_copy(tx_of):
    txs = tx_of({"a": ["1"]}, {"a": ["2"]})
    delivered = L.fan_out(txs, {"one": P.attr_eq("a", 1), "again": P.attr_eq("a", 1), "none": P.attr_eq("a", 9)})
    assert sorted((r.tx_id, r.sub_id) for r in delivered.collect()) == [(1, "again"), (1, "one")]
    assert {r.sub_id: r.matches for r in L.match_counts(delivered).collect()} == {"one": 1, "again": 1}


def test_very_many_filters_belong_in_a_table(tx_of):
    with pytest.raises(ValueError):
        L.fan_out(tx_of({"a": ["1"]}), {str(i): P.attr_eq("a", i) for i in range(L.MAX_EXPRESSIONS + 1)})


def test_dedupe_keeps_the_first(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"h{i}") for i in range(300)], "tx_id long, tx_hash string")
    kept = {r.tx_hash: r.tx_id for r in L.dedupe_by_hash(df).collect()}
    assert kept["hot"] == 1 and len(kept) == 101


def test_backfill_then_live_over_several_batches(spark, tmp_path):
    schema = "tx_id long, height long, tx_hash string, events map<string,array<string>>"
    row = lambda i: (i, i, f"h{i}", {"a": [str(i % 2)]})
    history = spark.createDataFrame([row(i) for i in range(10)], schema)
    live = tmp_path / "live"
    # Overlaps history, repeats itself within and across batches.
    for part in [[8, 9, 10, 11, 11], [11, 12, 13], [13, 14, 15, 5]]:
        spark.createDataFrame([row(i) for i in part], schema).coalesce(1).write.mode("append").parquet(str(live))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(live))
    sink = str(tmp_path / "sink")
    L.backfill_then_live(history, stream, P.attr_eq("a", 1), sink, str(tmp_path / "check")).awaitTermination()
    out = spark.read.parquet(sink)
    assert sorted(r.tx_hash for r in out.collect()) == sorted(f"h{i}" for i in range(16) if i % 2)
    assert out.select("batch_id").distinct().count() >= 2


def test_a_live_filter_equals_the_stored_one(spark, tmp_path):
    maps = [model.random_events(random.Random(i)) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(maps)), "tx_id long, events map<string,array<string>>")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    matches = lambda: P.attr_gt("a.x", "16uscrt") | P.attr_not_exists("b.z")
    writer = L.stream_filter(stream, matches()).writeStream.option("checkpointLocation", str(tmp_path / "check"))
    writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    stored = df.where(matches())
    ids = lambda d: sorted(r.tx_id for r in d.select("tx_id").collect())
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == ids(stored)


CONDITIONS = C.CONDITIONS_DDL


def test_wildcard_paths_in_the_condition_table(spark, tx_of):
    txs = tx_of({"w.x": ["1"], "w.y": ["2"]}, {"v": ["1"]}, {"w.x": [], "a*b": ["1"]}, {})
    held = [
        ("two", 0, 0, "w.*", "=", "2", None),
        ("none", 0, 0, "w.*", "not exists", None, None),
        ("more", 0, 0, "*", ">", "1", None),
        ("both", 0, 0, "v", "=", "1", None),
        ("both", 0, 1, "*.x", "not exists", None, None),
    ]
    found = C.fan_out_table(txs, spark.createDataFrame(held, CONDITIONS))
    pairs = {(r.tx_id, r.sub_id) for r in found.collect()}
    assert pairs == {(1, "two"), (1, "more"), (2, "none"), (2, "both"), (3, "none"), (4, "none")}


BAD_CONDITIONS = [
    ("s", 0, 0, "a", ">", "abc", None), ("s", 0, 0, "a", "~", "x", None), ("s", 0, 0, None, "=", "x", None),
    ("s", 0, 0, "", "=", "x", None), ("s", 0, 0, "a", "in", None, None), ("s", 0, 0, "a", "=", None, None),
    ("s", 0, 0, "a", None, "x", None),
]


def test_bad_filters_are_set_aside(spark, tx_of):
    txs = tx_of({"a": ["1"]})
    held = [(f"bad{i}", *c[1:]) for i, c in enumerate(BAD_CONDITIONS)] + [("bad0", 1, 0, "a", "=", "1", None), ("good", 0, 0, "a", "=", "1", None)]
    table = spark.createDataFrame(held, CONDITIONS)
    assert {r.sub_id for r in C.bad_filters(table).collect()} == {f"bad{i}" for i in range(len(BAD_CONDITIONS))}
    assert [tuple(r) for r in C.fan_out_table(txs, table, skip_bad=True).collect()] == [(1, "good")]
    with pytest.raises(ValueError):
        C.fan_out_table(txs, table)


def test_two_large_sets_in_one_clause(spark, tx_of):
    members = [str(i) for i in range(20_000)]
    held = [("s", 0, 0, "a", "in", None, members), ("s", 0, 1, "b", "in", None, members)]
    txs = tx_of({"a": ["5"], "b": ["19999"]}, {"a": ["5"], "b": ["x"]})
    assert [tuple(r) for r in C.fan_out_table(txs, spark.createDataFrame(held, CONDITIONS)).collect()] == [(1, "s")]


def test_filters_come_and_go_on_a_stream_of_rows_without_ids(spark, tmp_path):
    schema = "tx_hash string, height long, events map<string,array<string>>"
    held, live, sink = str(tmp_path / "held"), str(tmp_path / "live"), str(tmp_path / "sink")

    def subscribe(*subs):
        rows = [(s, 0, 0, "a", op, "1", None) for s, op in subs]
        spark.createDataFrame(rows, CONDITIONS).write.mode("overwrite").parquet(held)

    def arrive(*hashes):
        rows = [(h, 1, {"a": ["1"]}) for h in hashes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(live)
        stream = spark.readStream.schema(schema).parquet(live)
        C.stream_fan_out_table(
            stream, lambda s: s.read.parquet(held), sink, str(tmp_path / "check"), "tx_hash",
            whole=True, rejected=str(tmp_path / "rejected"),
        ).awaitTermination()

    subscribe(("one", "="))
    arrive("h1", None)
    subscribe(("one", "="), ("two", "="), ("bad", "~"))
    arrive("h2")
    subscribe(("two", "="))
    arrive("h3")
    out = {(r.tx_hash, r.height, r.sub_id) for r in spark.read.parquet(sink).collect()}
    assert out == {("h1", 1, "one"), ("h2", 1, "one"), ("h2", 1, "two"), ("h3", 1, "two")}
    assert [r.sub_id for r in spark.read.parquet(str(tmp_path / "rejected")).collect()] == ["bad"]


def test_rows_without_a_hash_are_kept_apart(spark, tmp_path):
    schema = "tx_hash string, height long, ts timestamp"
    df = spark.createDataFrame([(None, 1, None), (None, 1, None), ("h", 2, None), ("h", 1, None)], schema)
    assert sorted((r.tx_hash or "", r.height) for r in L.dedupe_by_hash(df).collect()) == [("", 1), ("", 1), ("h", 1)]
    df.withColumn("ts", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    writer = L.dedupe_by_hash(stream).writeStream.option("checkpointLocation", str(tmp_path / "check"))
    writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r.tx_hash or "" for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["", "", "h"]


def test_history_is_delivered_while_the_stream_is_quiet(spark, tmp_path):
    schema = "tx_hash string, height long, events map<string,array<string>>"
    history = spark.createDataFrame([("h1", 1, {"a": ["1"]}), ("h2", 2, {"a": ["2"]})], schema)
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "live"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "live"))
    sink = str(tmp_path / "sink")
    L.backfill_then_live(history, stream, P.attr_eq("a", 1), sink, str(tmp_path / "check")).awaitTermination()
    assert [r.tx_hash for r in spark.read.parquet(sink).collect()] == ["h1"]


def test_click_events_of_one_file_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "EVENTS_PER_TASK", 30)
    events = spark.range(100, numPartitions=1).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 7).alias("user_id")
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = W.stored_events(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 4
    assert sorted(map(str, found.collect())) == sorted(map(str, events.collect()))
    live = W.live_events(spark, str(tmp_path))
    sizes = []
    query = live.writeStream.foreachBatch(lambda b, _: sizes.append((b.rdd.getNumPartitions(), b.count())))
    query.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert sizes == [(4, 100)]
