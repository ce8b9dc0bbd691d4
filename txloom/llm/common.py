"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.session import discard, scratch

# A-Z to a-z and nothing else.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32

# Bytes of text that are turned into arrays at once; one longer text stays whole.
CHUNK_BYTES = 1 << 21
# The same for work that gains nothing from larger chunks, so that workers stay small.
SMALL_CHUNK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: computed once, kept when executors go."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` (in any case) is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one longer row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray):
    """Runs of word bytes, cut at row ends: starts, ends, and the index of each row's first word.

    `word_byte` says of each of the 256 bytes whether it belongs to words. The third
    array has a last entry more, the number of words.
    """
    inside = word_byte[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (~before[:-1] | cut[:-1]))
    following = np.zeros(len(data) + 1, bool)
    following[: len(data)] = inside
    ends = np.flatnonzero(inside & (~following[1:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# What this Python worker keeps from task to task, by the operator that it is for.
_tables: dict[str, dict] = {}


def worker_tables(owner: str) -> dict:
    """The tables that this worker keeps for one operator.

    Spark uses workers again for whatever comes next, so an operator that begins drops the
    tables of the others and gives their memory back.
    """
    others = [name for name in _tables if name != owner]
    if others:
        for name in others:
            del _tables[name]
        _powers.clear()
        release()
    return _tables.setdefault(owner, {})


def release() -> None:
    """Give unused memory back to the system, where its library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) <= n:
        # Some more than asked for, as chunks of one size differ a little.
        size = n + n // 8 + 1
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
        del _powers[:-2]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    power, inverse = _power_table(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * power[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words, from the words' hashes."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + words[k : k + n])
    return out
