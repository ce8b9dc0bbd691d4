"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of 13 consecutive words (a shorter item is one window). A
window occurs in a document only if all its five-word shingles do, so one of them, the
rarest in the documents, is its necessary prefix: documents post only those shingles
that are some window's prefix, with the words around. The join on the shingle gives
candidates, whose place in the window says where it must start (positional bound) and
whether enough words are left (length bound); the words themselves are then compared.

Which shingles the documents must post is told by a bitmap of fixed size. False hits of it
fall out in the join, so results do not depend on its size, and neither table is ever
broadcast or collected. A window with a shingle that no document has is dropped at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.llm.common import (
    LOWER_BYTES,
    SMALL_CHUNK_BYTES,
    chunks,
    fresh,
    saved,
    shingle_hashes,
    span_hashes,
    text_buffer,
    word_spans,
    worker_tables,
)

WINDOW = 13
SHINGLE = 5
#: Bits of the map of wanted shingles (one megabyte).
MAP_BITS = 1 << 23

# Words after lower-casing: digits, a-z and everything beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
_SPACED = np.where(WORD_BYTE, np.arange(256), 32).astype(np.uint8)


def _words(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, word starts and ends, and each row's first word and the end."""
    low = LOWER_BYTES[data]
    return low, *word_spans(low, offsets, WORD_BYTE)


def _windows(items: DataFrame, item: str, text: str) -> DataFrame:
    """Rows (item, window, length, shingle, size, offset): the shingles of all windows."""
    schema = "window string, length int, shingle long, size int, offset int"
    rows = items.select(F.col(item).alias("item"), F.col(text).alias("text"))
    item_type = rows.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item", "window", "length", "shingle", "size", "offset"]
        for batch in batches:
            for row in range(len(batch)):
                one = batch.slice(row, 1)
                data, offsets = text_buffer(one.column("text"))
                low, starts, ends, _ = _words(data, offsets)
                n = len(starts)
                if not n:
                    continue
                length = min(WINDOW, n)
                size = min(SHINGLE, length)
                each = length - size + 1
                shingles = shingle_hashes(span_hashes(low, starts, ends), size).view(np.int64)
                words = [low[a:b].tobytes().decode() for a, b in zip(starts, ends)]
                # In parts, as a long item has many windows.
                for first in range(0, n - length + 1, 4096):
                    at = np.arange(first, min(first + 4096, n - length + 1))
                    place = (at[:, None] + np.arange(each)).ravel()
                    windows = [" ".join(words[i : i + length]) for i in at]
                    columns = [
                        one.column("item").take(pa.array(np.zeros(len(place), np.int64))),
                        pa.array(windows).take(pa.array(np.repeat(np.arange(len(at)), each))),
                        pa.array(np.full(len(place), length, np.int32)),
                        pa.array(shingles[place]),
                        pa.array(np.full(len(place), size, np.int32)),
                        pa.array(np.tile(np.arange(each, dtype=np.int32), len(at))),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"item {item_type}, {schema}")


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """The map of a `shingle` column: at most MAP_BITS / 64 numbers reach the driver."""
    bit = F.pmod("shingle", F.lit(MAP_BITS))
    one = F.expr(f"shiftleft(1L, cast(pmod(shingle, {MAP_BITS}) & 63 as int))")
    words = shingles.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(one).alias("bits"))
    out = np.zeros(MAP_BITS // 64, np.int64)
    for row in words.collect():
        out[row["at"]] = row["bits"]
    return out.view(np.uint64)


def _wanted(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)) == 1


def _shingles_of(low, starts, ends, first_word, sizes: list[int]):
    """For each size, the hashes of all shingles and whether each lies in one row."""
    words = span_hashes(low, starts, ends)
    row_end = np.repeat(first_word[1:], np.diff(first_word))
    for size in sizes:
        hashes = shingle_hashes(words, size)
        yield size, hashes, np.arange(len(hashes)) + size <= row_end[: len(hashes)]


def _frequencies(docs: DataFrame, text: str, bitmap, sizes: list[int]) -> DataFrame:
    """How often documents have the mapped shingles, counted per batch before it moves."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables("decontaminate")
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for first, last in chunks(offsets, SMALL_CHUNK_BYTES):
                part = data[offsets[first] : offsets[last]]
                words = _words(part, offsets[first : last + 1] - offsets[first])
                for _, hashes, inside in _shingles_of(*words, sizes):
                    hits = hashes[inside & _wanted(hashes, shared.value)]
                    keys, counts = np.unique(hits, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(counts)], ["shingle", "n"]
                    )

    counted = docs.select(text).mapInArrow(run, "shingle long, n long")
    return counted.groupBy("shingle").agg(F.sum("n").alias("n"))


def _postings(docs: DataFrame, text: str, bitmap, sizes: list[int], posts_name: str) -> DataFrame:
    """`docs` with `n_words` and, as `posts_name`, the mapped shingles with the words around them."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    post = pa.struct(
        [("shingle", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("words", pa.string())]
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    reach = WINDOW - SHINGLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables("decontaminate")
        for batch in batches:
            data, offsets = text_buffer(batch.column(text))
            for first, last in chunks(offsets, SMALL_CHUNK_BYTES):
                part = data[offsets[first] : offsets[last]]
                low, starts, ends, first_word = _words(part, offsets[first : last + 1] - offsets[first])
                spaced = _SPACED[low].tobytes()
                posts: list[list[dict]] = [[] for _ in range(last - first)]
                for size, hashes, inside in _shingles_of(low, starts, ends, first_word, sizes):
                    hits = np.flatnonzero(inside & _wanted(hashes, shared.value))
                    rows = np.searchsorted(first_word, hits, side="right") - 1
                    around = reach if size == SHINGLE else 0
                    begins = np.maximum(hits - around, first_word[rows])
                    stops = np.minimum(hits + size + around, first_word[rows + 1])
                    for i, row, a, b in zip(hits.tolist(), rows.tolist(), begins.tolist(), stops.tolist()):
                        words = b" ".join(spaced[starts[a] : ends[b - 1]].split()).decode()
                        posts[row].append(
                            {"shingle": int(hashes[i].view(np.int64)), "at": i - int(first_word[row]), "before": i - a, "words": words}
                        )
                own = batch.slice(first, last - first)
                columns = [*own.columns, pa.array(np.diff(first_word)), pa.array(posts, pa.list_(post))]
                yield pa.RecordBatch.from_arrays(columns, [*own.schema.names, "n_words", posts_name])

    return docs.mapInArrow(
        run,
        f"{fields}, n_words long, {posts_name} array<struct<shingle:long, at:int, before:int, words:string>>",
    )


def _covered(spans):
    """Words in the union of spans (start, length), sorted by start."""

    def step(acc, span):
        start = F.greatest(acc["end"], span["start"])
        end = F.greatest(acc["end"], span["start"] + span["length"])
        return F.struct((acc["n"] + end - F.least(start, end)).alias("n"), end.alias("end"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """`docs` (or its columns `keep`) with `n_words`, `n_hit` (words inside an occurring window), `items` (sorted ids,
    as strings, of the items with occurring windows) and `contaminated` (a twentieth hit).

    Texts of documents and items are taken whole. Null or empty texts have no words and are
    never contaminated; an item without words has no window. Repeated documents are judged
    alike, repeated items count once by their id, and one with a null id is not named but
    hits. Empty tables give no rows or no hits. Input columns named like the added ones are
    replaced. Rows are told apart by a number of their own, so ids may repeat or be null.
    """
    docs = docs.drop("n_words", "n_hit", "items", "contaminated")
    key = fresh(docs, "_row")
    windows = saved(_windows(items, item, item_text), "windows")
    sizes = sorted(row["size"] for row in windows.select("size").distinct().collect())
    counts = _frequencies(docs, text, _bitmap(windows), sizes)
    parts = windows.select("window", "length", "shingle", "size", "offset").distinct()
    # The rarest shingle leads; an absent one rules its window out.
    ranked = parts.join(counts, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = F.min(F.struct("n", "shingle", "offset")).alias("rarest")
    prefix = ranked.groupBy("window", "length").agg(rarest).where("rarest.n > 0")
    prefix = saved(prefix.select("window", "length", "rarest.shingle", "rarest.offset"), "prefixes")
    post_list = fresh(docs, "_posts")
    posted = _postings(docs.withColumn(key, F.monotonically_increasing_id()), text, _bitmap(prefix), sizes, post_list)
    posted = saved(posted.select(*(keep or docs.columns), key, "n_words", post_list), "postings")
    posts = posted.where(F.size(post_list) > 0).select(key, F.explode(post_list).alias("post"))
    candidates = posts.select(key, "post.*").join(prefix, "shingle")
    same = F.array_join(
        F.slice(F.split("words", " "), F.col("before") - F.col("offset") + 1, F.col("length")), " "
    ) == F.col("window")
    # Both bounds first: the window starts inside the words, and enough of them follow.
    found = candidates.where(F.col("offset") <= F.col("before")).where(same)
    found = saved(
        found.select(key, "window", (F.col("at") - F.col("offset")).alias("start"), "length"), "found"
    )
    spans = found.groupBy(key).agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    named = windows.select("window", F.col("item").cast("string").alias("item")).distinct()
    items_of = found.select(key, "window").distinct().join(named, "window")
    items_of = items_of.groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    # Saved, so that Spark knows how small they are: texts are not shuffled to meet a few hits.
    hit = saved(spans.select(key, _covered(F.col("spans")).cast("long").alias("n_hit")).join(items_of, key), "hits")
    none = F.expr("cast(array() as array<string>)")
    out = posted.drop(post_list).join(hit, key, "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0))).withColumn("items", F.coalesce("items", none))
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    return out.withColumn("contaminated", dirty).drop(key)
