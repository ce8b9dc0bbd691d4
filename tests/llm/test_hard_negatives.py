"""Hard negatives against plain loops over integers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txloom.llm import hard_negatives as hard


def plain(rows, scale, every, k=5, percent=80):
    """Rows (id, vector, label) as given."""
    good = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((i, [int(np.floor(np.float64(x) * scale)) for x in v], label))
    out, asked = [], {}
    for i, v, label in good:
        if i % every == 0:
            asked.setdefault(i, (v, label))
    for anchor, (v, label) in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i, other == label) for i, w, other in good if i != anchor)
        for minus, positive, same in [s for s in scored if s[2]][:k]:
            near = [s for s in scored if not s[2] and percent * -minus <= 100 * -s[0] <= 100 * -minus]
            for rank, (score, i, _) in enumerate(near[:k], 1):
                out.append((anchor, positive, rank, i, -minus, -score))
    return sorted(out)


@pytest.mark.parametrize("width, scale, blocks", [(64, 256, (1024, 16_384)), (3, 40, (7, 9)), (21, 1e6, (16, 16))])
def test_scores_ranks_and_ties(spark, monkeypatch, width, scale, blocks):
    """Nulls and bad numbers take no part, ties go to smaller ids, short vectors are filled."""
    monkeypatch.setattr(hard, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(hard, "ANCHOR_ROWS", 4)
    rng = random.Random(width)
    rows = []
    for i in range(300):
        v = [rng.choice([-0.5, 0.25, 0.5, 0.75, rng.random()]) for _ in range(width)]
        rows.append((i, v if i % 4 else v[: width - 1], i % 3))
    # A third of the rows are one vector; one row of each kind takes no part.
    rows = [(i, rows[5][1] if i % 3 == 2 else v, label if i % 9 else (label + 1) % 3) for i, v, label in rows]
    rows += [(300, None, 1), (301, rows[1][1], None), (None, rows[1][1], 1), (302, [None] * width, 1)]
    rows += [(303, [float("nan")] * width, 1), (304, [float("inf")] * width, 2), (305, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumn("id", F.lit("own")).withColumn("v", F.lit("own")).withColumn("slice", F.lit("own"))
    vectors = hard.integers(df, "vec_id", "embedding", "label", scale)
    found = hard.mine(vectors, vectors.where("id % 10 = 0"))
    want = plain(rows, scale, 10)
    assert want and sorted(map(tuple, found.collect())) == want


def test_tables_give_the_products():
    rng = np.random.default_rng(1)
    for low, high, width in ((-(1 << 31) + 1, 1 << 31, 9), (-3, 3, 1), (0, 1, 8)):
        anchors, candidates = (rng.integers(low, high, (n, width)).astype(np.int32) for n in (5, 11))
        bits = int(max(candidates.max(), (~candidates).max(), 0)).bit_length() + 1
        found = hard.scores(hard.subset_sums(anchors, np.int64), hard.bit_planes(candidates, bits))
        assert (found == candidates.astype(np.int64) @ anchors.astype(np.int64).T).all()


def test_nothing_and_no_labels_to_share(spark):
    schema = "vec_id long, embedding array<float>, label string"
    for rows in ([], [(0, [1.0], "a")], [(0, [1.0], "a"), (1, [1.0], "b")], [(0, [-1.0], "a"), (1, [1.0], "a"), (2, [1.0], "b")]):
        vectors = hard.integers(spark.createDataFrame(rows, schema), "vec_id", "embedding", "label")
        assert hard.mine(vectors, vectors.where("id % 100 = 0")).count() == 0


def test_repeated_rows_are_each_a_candidate(spark):
    rows = [(0, [2.0], "a"), (0, [2.0], "a"), (1, [2.0], "a"), (2, [2.0], "b"), (2, [2.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    vectors = hard.integers(df, "vec_id", "embedding", "label")
    found = sorted(map(tuple, hard.mine(vectors, vectors.where("id = 0")).collect()))
    assert found == [(0, 1, 1, 2, 4, 4), (0, 1, 2, 2, 4, 4)]


def test_components_beyond_the_range_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e300], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="beyond 2"):
        hard.integers(df, "vec_id", "embedding", "label").collect()
