"""Hard negatives by exact integer scores from lookup tables.

Components are whole numbers, so a candidate is a sum of bit planes: of each plane, the bits
of eight neighbouring dimensions make one byte. For an anchor, a table per group of eight
dimensions has the sums of all 256 subsets of its eight components; the byte of a plane
picks one, the picked ones add up to the plane's product, and the planes' products, shifted
by their weight, to the whole inner product (the Four Russians' method). Tables of a block
of anchors lie side by side, so one lookup serves the block.

Candidates are packed once and stay dealt by block; blocks of anchors, the stated queries,
visit every block of candidates, first to find each anchor's positives and then, with their
scores as bounds, the negatives. A block of candidates sends on a few rows per anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txloom.llm.common import saved

#: Candidates of one block (between these, by the size of the table), those that are scored
#: at once, and anchors of one block.
BLOCK_ROWS = (1024, 16_384)
SCORED_ROWS = 1024
ANCHOR_ROWS = 128
#: Positives of an anchor, negatives of a positive, and the least share, in percent, of the
#: positive's score that a negative has.
POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80

_CANDIDATES = "ids binary, labels binary, planes binary"
_ANCHORS = "ids binary, labels binary, vectors binary, bounds binary"


def integers(df: DataFrame, id_col: str, vector: str, label: str, scale: int = 1) -> DataFrame:
    """(id, label, v) of the rows that take part: floor(scale * x) of each component.

    Rows with a null id, label or vector, or a null or non-finite component, are left out.
    Labels of any type become 64-bit hashes, which are only compared. Components beyond
    2^31 after scaling are an error.
    """
    x = F.col(vector)
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    present = F.col(id_col).isNotNull() & F.col(label).isNotNull() & x.isNotNull()
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    rows = df.where(present).where(finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(label).alias("label"), whole.alias("v"))
    largest = F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))
    too_large = F.raise_error(F.lit("a scaled component is beyond 2^31"))
    return rows.withColumn("v", F.when(largest >= float(1 << 31), too_large).otherwise(F.col("v").cast("array<int>")))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch, filled with zeros up to `width`."""
    vectors = batch.column("v")
    length = np.diff(np.asarray(vectors.offsets))
    matrix = np.zeros((len(batch), width), np.int32)
    matrix[np.arange(width) < length[:, None]] = np.asarray(vectors.flatten())
    return matrix


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, len(batch), size):
            yield batch.slice(first, size)


def _record(schema: str, values: list) -> pa.RecordBatch:
    names = [field.split()[0] for field in schema.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[field.split()[1]] for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)


def bit_planes(matrix: np.ndarray, bits: int) -> np.ndarray:
    """Bytes [plane, group, row] of the components in two's complement of `bits` bits."""
    planes = [np.packbits((matrix >> p & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(bits)]
    return np.ascontiguousarray(np.stack(planes))


def subset_sums(matrix: np.ndarray, kind: type) -> np.ndarray:
    """Sums [group, byte, anchor] of the components that each byte's bits choose."""
    rows, width = matrix.shape
    groups = -(-width // 8)
    filled = np.zeros((rows, groups * 8), kind)
    filled[:, :width] = matrix
    parts = filled.T.reshape(groups, 8, rows)
    sums = np.zeros((groups, 256, rows), kind)
    for bit in range(8):
        half = 1 << bit
        sums[:, half : 2 * half] = sums[:, :half] + parts[:, bit, None]
    return sums


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products [row, anchor] of candidates and anchors, by lookups, shifts and sums."""
    bits, groups, rows = planes.shape
    total = np.zeros((rows, sums.shape[2]), np.int64)
    for p in range(bits):
        product = np.zeros((rows, sums.shape[2]), sums.dtype)
        for g in range(groups):
            product += sums[g][planes[p, g]]
        # The highest plane is the sign's.
        shifted = product.astype(np.int64) << p
        total += -shifted if p == bits - 1 else shifted
    return total


def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both tables have (id, label, v) as `integers` makes them. Rows rank by their inner
    product with the anchor, the highest first and equal ones by the smaller id. An anchor's
    positives are its first rows of the same label, without rows of its own id; for each, the
    first rows of other labels whose score is at most the positive's and at least
    `least_percent` of it are returned (a positive of negative score has none). Fewer are
    returned where there are no more. An anchor id that repeats is asked once, with its least
    label and vector; repeated candidates are each a candidate. Shorter vectors count as
    filled with zeros. Without anchors or candidates there are no rows.
    """
    size = vectors.agg(
        F.count("*").alias("n"),
        F.max(F.size("v")).alias("width"),
        F.max(F.greatest(F.array_max("v"), F.bitwise_not(F.array_min("v")))).alias("largest"),
    ).first()
    once = anchors.groupBy("id").agg(F.min(F.struct("label", "v")).alias("least"))
    once = saved(once.select("id", "least.label", "least.v"), "anchors")
    asked = once.agg(
        F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")
    ).first()
    width = max(size["width"] or 1, asked["width"] or 1, 1)
    bits = max(int(size["largest"] or 0), 0).bit_length() + 1
    # Sums of eight components stay in 32 bits, and scores times a hundred in 64.
    highest = int(asked["largest"] or 0)
    if highest * width << bits >= (1 << 63) // 128:
        raise OverflowError("inner products are beyond 64 bits")
    kind = np.int32 if highest * width < 1 << 31 else np.int64
    block_rows = min(max(-(-size["n"] // 64), BLOCK_ROWS[0]), BLOCK_ROWS[1])

    packed = vectors.mapInArrow(_pack_candidates(width, bits, block_rows), _CANDIDATES)
    blocks = saved(packed, "candidates")
    # Blocks are dealt to about as many slices; each block of anchors goes to every slice.
    slices = max(1, blocks.count())
    blocks = blocks.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)))

    def visits(rows: DataFrame, scan: Callable, schema: str) -> DataFrame:
        """What `scan` finds in each block of candidates for each block of anchors."""
        asking = rows.mapInArrow(_pack_anchors(width, positives), _ANCHORS).select(
            F.col("ids").alias("anchor_ids"), F.col("labels").alias("anchor_labels"), "vectors", "bounds",
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"),
        )
        pairs = blocks.join(asking, "slice").drop("slice")
        return pairs.mapInArrow(_scan(width, bits, kind, scan), schema)

    own = visits(once, _nearest(positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    own = own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    own = saved(own, "positives")
    listed = own.groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("own")
    )
    bounded = once.join(listed.withColumnRenamed("anchor_id", "id"), "id")
    bounded = bounded.select("id", "label", "v", F.col("own.positive_score").alias("bounds"))
    found = visits(
        bounded, _below(negatives, least_percent), "anchor_id long, place int, negative_id long, negative_score long"
    )
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(own, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _pack_candidates(width: int, bits: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _blocks(batches, size):
            planes = bit_planes(_matrix(some, width), bits)
            ids, labels = (np.asarray(some.column(c)).tobytes() for c in ("id", "label"))
            yield _record(_CANDIDATES, [ids, labels, planes.tobytes()])

    return run


def _pack_anchors(width: int, positives: int) -> Callable:
    """Blocks of anchors; `bounds` are the scores of their positives, the first first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _blocks(batches, ANCHOR_ROWS):
            ids, labels = (np.asarray(some.column(c)).tobytes() for c in ("id", "label"))
            bounds = np.full((len(some), positives), -1, np.int64)
            if "bounds" in some.schema.names:
                for row, values in enumerate(some.column("bounds").to_pylist()):
                    bounds[row, : len(values)] = values
            vectors = _matrix(some, width).tobytes()
            yield _record(_ANCHORS, [ids, labels, vectors, bounds.tobytes()])

    return run


def _scan(width: int, bits: int, kind: type, scan: Callable) -> Callable:
    """Score each pair of blocks, and hand one anchor at a time to `scan`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in range(len(batch)):

                def values(name: str, dtype: type) -> np.ndarray:
                    return np.frombuffer(batch.column(name)[pair].as_buffer(), dtype)

                ids, labels = values("ids", np.int64), values("labels", np.int64)
                anchor_ids, anchor_labels = values("anchor_ids", np.int64), values("anchor_labels", np.int64)
                planes = values("planes", np.uint8).reshape(bits, -1, len(ids))
                sums = subset_sums(values("vectors", np.int32).reshape(-1, width), kind)
                bounds = values("bounds", np.int64).reshape(len(anchor_ids), -1)
                parts = [scores(sums, planes[:, :, i : i + SCORED_ROWS]) for i in range(0, len(ids), SCORED_ROWS)]
                total = np.ascontiguousarray(np.concatenate(parts).T)
                for a, anchor in enumerate(anchor_ids):
                    same = labels == anchor_labels[a]
                    yield from scan(anchor, total[a], ids, same, bounds[a])

    return run


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by the smaller id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def _nearest(k: int) -> Callable:
    def scan(anchor, score, ids, same, bounds) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(same & (ids != anchor))
        some = some[_first(score[some], ids[some], k)]
        if len(some):
            arrays = [np.full(len(some), anchor), ids[some], score[some]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), ["anchor_id", "positive_id", "positive_score"])

    return scan


def _below(k: int, percent: int) -> Callable:
    """The first k of other labels for each bound; bounds below zero have none."""

    def scan(anchor, score, ids, same, bounds) -> Iterator[pa.RecordBatch]:
        bounds = bounds[bounds >= 0]
        if not len(bounds):
            return
        near = np.flatnonzero(~same & (score <= bounds[0]) & (100 * score >= percent * bounds[-1]))
        for place, bound in enumerate(bounds):
            some = near[(score[near] <= bound) & (100 * score[near] >= percent * bound)]
            some = some[_first(score[some], ids[some], k)]
            if len(some):
                places = np.full(len(some), place + 1, np.int32)
                arrays = [np.full(len(some), anchor), places, ids[some], score[some]]
                names = ["anchor_id", "place", "negative_id", "negative_score"]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names)

    return scan
