"""Merged batches hold what the batches held, in few folders."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_streaming import block_message, tx_message

from txloom.operators.dictionary import decode_facts
from txloom.sources import merging, store
from txloom.sources import messages as G

START = datetime(2024, 1, 1, 12)
TABLES = ("transactions", "attrs", "facts", "paths", "values")


def index(spark, root, batch, days):
    """One transaction per day number; its height is ten times the day."""
    texts = [
        (tx_message(10 * d, {"tx.hash": [f"{batch}-{d}"], f"p.{batch % 3}": [str(d), "same"]}), START + timedelta(days=d))
        for d in days
    ] or [(block_message(3), START)]
    raw = spark.createDataFrame(texts, "value string, at timestamp")
    txs, _ = G.route_by_type(G.parse_messages(raw)[0])
    store.index_batch(spark, root, G.transaction_rows(txs, F.col("at")), batch)


def content(spark, root):
    return {t: Counter(str(r) for r in store.read_table(spark, root, t).collect()) for t in TABLES}


def folders(root, table):
    return sorted(p.name for p in (root / table).glob("batch_id=*"))


def test_merges_keep_the_store_and_its_folders_few(spark, tmp_path):
    merged, plain = str(tmp_path / "merged"), str(tmp_path / "plain")
    batches = [[0, 1], [], [1, 2, 3], [2, 3], [4, 0]]
    sizes = []
    for batch, days in enumerate(batches):
        index(spark, merged, batch, days)
        index(spark, plain, batch, days)
        taken = merging.merge_batches(spark, merged)
        assert taken == (1 if batch else 0)
        held = [(m.first_batch, m.last_batch) for m in store.merges(spark, merged)]
        sizes.append(len(held) + len(folders(tmp_path / "merged", "values")))
        if held:
            # Without a gap, up to the last closed batch.
            assert held[0][0] == 0 and held[-1][1] == batch - 1
            assert all(a[1] + 1 == b[0] for a, b in zip(held, held[1:]))
    assert held == [(0, 3)]
    # At most two merges, the last batch, and one that the next run deletes.
    assert max(sizes) <= 2 + 2 and len(folders(tmp_path / "plain", "values")) == 5
    assert content(spark, merged) == content(spark, plain)
    decoded = [decode_facts(*[store.read_table(spark, r, t) for t in TABLES[2:]]) for r in (merged, plain)]
    assert Counter(decoded[0].collect()) == Counter(decoded[1].collect())

    for limits in ((None, 15), (35, None), (None, None), (1000, 2000)):
        ours, theirs = (store.read_heights(spark, r, "transactions", *limits) for r in (merged, plain))
        assert Counter(map(str, ours.collect())) == Counter(map(str, theirs.collect()))

    # The last batch once more, as after a failure; closed ones cannot be changed.
    before = content(spark, merged)
    index(spark, merged, 4, [4, 0])
    assert content(spark, merged) == before
    with pytest.raises(ValueError):
        index(spark, merged, 3, [6])

    # Files of other days are not opened: spoilt ones do no harm.
    first = (START - datetime(1970, 1, 1)).days
    wanted = {f"day={first + 2}", f"day={first + 3}"}
    for file in (tmp_path / "merged" / "merged" / "transactions").glob("*/*/day=*/*.parquet"):
        if file.parent.name not in wanted:
            file.write_bytes(b"spoilt")
    found = store.read_heights(spark, merged, "transactions", 20, 39)
    assert sorted((r.height, r.tx_hash) for r in found.collect()) == [(20, "2-2"), (20, "3-2"), (30, "2-3"), (30, "3-3")]
    with pytest.raises(Exception, match="spoilt|parquet|Parquet|FAILED_READ_FILE"):
        store.read_heights(spark, merged, "transactions", 0, 39).collect()


def test_a_merge_that_was_cut_short_is_not_seen(spark, tmp_path):
    root = str(tmp_path)
    for batch, days in enumerate([[0], [1], [2]]):
        index(spark, root, batch, days)
    before = content(spark, root)
    write = merging._write

    def fails(rows, root, table, *batches):
        if table == "paths":
            raise OSError("lost")
        write(rows, root, table, *batches)

    merging._write = fails
    try:
        with pytest.raises(OSError):
            merging.merge_batches(spark, root)
    finally:
        merging._write = write
    assert store.merges(spark, root) == [] and content(spark, root) == before
    index(spark, root, 3, [])
    # What the failed run left is deleted, and all closed batches are taken.
    assert merging.merge_batches(spark, root) == 3
    assert not (tmp_path / "merged" / "attrs" / "first_batch=0" / "last_batch=1").exists()
    assert content(spark, root) == before
    # The batches are still there for a reader that began before, and go with the next run.
    assert len(folders(tmp_path, "facts")) == 4
    assert merging.merge_batches(spark, root) == 0
    assert folders(tmp_path, "facts") == ["batch_id=3"] and folders(tmp_path, "progress") == ["batch_id=2", "batch_id=3"]
    assert content(spark, root) == before
    assert merging.merge_batches(spark, str(tmp_path / "nothing")) == 0


def test_expiry_drops_days_of_merged_batches(spark, tmp_path):
    root = str(tmp_path)
    for batch, days in enumerate([[0, 9], [1, 8], [9]]):
        index(spark, root, batch, days)
    assert merging.merge_batches(spark, root) == 2
    now = START + timedelta(days=5 + 14)
    assert store.expire_store(spark, root, now) == 0
    kept = lambda: sorted(r.height for r in store.read_table(spark, root, "transactions").collect())
    assert kept() == [80, 90, 90]
    # Two days, and the batches that the merge holds are not old as a whole.
    assert store.expire_store(spark, root, now + timedelta(seconds=1)) == 2
    assert store.expire_store(spark, root, now + timedelta(seconds=2)) == 0
    days = lambda table: len(list((tmp_path / "merged" / table).glob("*/*/day=*")))
    assert [days(t) for t in ("transactions", "attrs", "facts")] == [2, 2, 2] and kept() == [80, 90, 90]
    index(spark, root, 3, [9])
    assert merging.merge_batches(spark, root) == 1 and kept() == [80, 90, 90, 90]
    assert Counter(r.tx_id for r in store.read_table(spark, root, "transactions").collect()) == Counter([2, 4, 5, 6])


def test_the_last_batch_again_after_expiry(spark, tmp_path):
    root = str(tmp_path)
    index(spark, root, 0, [0])
    index(spark, root, 1, [20])
    for second in (0, 1):
        gone = store.expire_store(spark, root, START + timedelta(days=25, seconds=second))
        assert gone == second
    assert folders(tmp_path, "transactions") == ["batch_id=1"]
    before = content(spark, root)
    index(spark, root, 1, [20])
    assert content(spark, root) == before
    # What is kept of the batch before is not counted once more.
    assert store.expire_store(spark, root, START + timedelta(days=25, seconds=2)) == 0
