"""Alignment of two tokenizers over a corpus, and how often their ids go together.

Both tokenizers read the same bytes; where a token of each ends, a group ends, and its last
two tokens are linked. Most groups are one token on each side. These have the same bytes, so
an array from A's ids to B's ids, made beforehand, names the pair, and they are counted in
one vector per task, as long as A's vocabulary. Only links of irregular groups become rows
of pairs, counted in the task before they are shuffled.

Texts are cut into chunks that both tokenizers treat alike wherever they stand, and each
worker aligns a distinct chunk once. What a document needs later (the codes of its links) is
saved, so texts are read once. Counts then come back to documents: those of regular links
and the highest of each B id as vectors, those of frequent irregular pairs as a table of
proven size, and the rest by a shuffled join, in which no pair is frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.llm.common import chunks, fresh, saved, text_buffer
from txloom.llm.tokenizers import ByteLevel, Chunks, Pieces, chunk_starts, flat, ragged, worker_copy

#: Irregular pairs whose share of all irregular links is at least one in so many are sent to
#: the workers; there are at most so many of them.
FREQUENT_PAIRS = 1 << 17
#: Aligned chunks that a worker keeps; each takes some hundred bytes.
KEPT_CHUNKS = 150_000
#: Irregular pairs that a task counts before it sends them on.
COUNTED_PAIRS = 1 << 20

_SPACE = np.frombuffer(b" ", np.uint8)


class Aligner:
    """Tokens, groups and links of chunks that begin with a space."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        self.a, self.b = ByteLevel(byte_level), Pieces(pieces)
        self.a_bytes, self.b_bytes = _Bytes(self.a.token_bytes()), _Bytes(self.b.token_bytes())
        # The B id with the same bytes as each A id; none where that is not one id.
        by_bytes: dict[bytes, int] = {}
        for number, token in enumerate(self.b.token_bytes()):
            by_bytes[token] = -1 if token in by_bytes else number
        self.same = np.array([by_bytes.get(token, -1) for token in self.a.token_bytes()], np.int64)
        cuts = (self.a.cuts, self.b.cuts)
        self.cuts = None if any(c is None for c in cuts) else cuts[0] & cuts[1]
        # Numbers in decimal, with what follows each: a comma, a bar or a semicolon.
        digits = [str(i).encode() for i in range(max(self.a.size, self.b.size))]
        self.digits = [_Bytes([d + end for d in digits]) for end in (b",", b"|", b";")]
        self.chunks = Chunks(self._learn, KEPT_CHUNKS)

    def _learn(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per chunk: how many A tokens, B tokens and groups (and whether bytes agree), link
        codes a * |B| + b, which links are regular, and the groups in writing."""
        n = len(texts)
        data = np.frombuffer(b"".join(texts), np.uint8)
        length = np.fromiter(map(len, texts), np.int64, n)
        a, n_a = flat(self.a.encode(texts))
        b, n_b = flat(self.b.encode_spaced(texts))
        agree = self.a_bytes.agree(a, n_a, data, length) & self.b_bytes.agree(b, n_b, data, length)
        # Chunks whose bytes differ have no tokens here.
        a, b = a[np.repeat(agree, n_a)], b[np.repeat(agree, n_b)]
        n_a, n_b = n_a * agree, n_b * agree
        a_ends, b_ends = np.cumsum(self.a_bytes.count[a]), np.cumsum(self.b_bytes.count[b])
        ends, a_last, b_last = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        a_first = np.concatenate([[0], a_last[:-1] + 1]) if len(ends) else a_last
        b_first = np.concatenate([[0], b_last[:-1] + 1]) if len(ends) else b_last
        # The group of each token, and of each group its chunk.
        a_size, b_size = a_last - a_first + 1, b_last - b_first + 1
        chunk_ends = np.cumsum(n_a)
        groups = np.diff(np.concatenate([[0], np.searchsorted(a_last, chunk_ends)]))
        codes = a[a_last] * self.b.size + b[b_last]
        regular = (a_size == 1) & (b_size == 1) & (self.same[a[a_last]] == b[b_last])
        written, n_written = self._written(a, b, a_size, b_size, groups)
        one = np.ones(n, np.int64)
        return [
            (n_a, one), (n_b, one), (groups, one), (agree, one),
            (codes, groups), (regular, groups), (written, n_written),
        ]

    def _written(self, a, b, a_size, b_size, groups) -> tuple[np.ndarray, np.ndarray]:
        """`a1,a2|b1;a3|b2,b3;` of each chunk, end to end, and the bytes of each."""
        # Tokens in the order in which they are written: group by group, A before B.
        at = np.cumsum(a_size + b_size) - a_size - b_size
        ids = np.empty(len(a) + len(b), np.int64)
        end = np.zeros(len(ids), np.int64)
        ids[ragged(at, a_size)] = a
        ids[ragged(at + a_size, b_size)] = b
        end[at + a_size - 1] = 1
        end[at + a_size + b_size - 1] = 2
        # The three tables lie end to end.
        tables = self.digits
        values = np.concatenate([t.values for t in tables])
        shift = np.cumsum([0] + [len(t.values) for t in tables[:-1]])
        begin = np.stack([t.begin + s for t, s in zip(tables, shift)])[end, ids]
        count = tables[0].count[ids]
        before = np.concatenate([[0], np.cumsum(count)])
        group_at = np.concatenate([at, [len(ids)]])
        chunk_at = group_at[np.concatenate([[0], np.cumsum(groups)])]
        return values[ragged(begin, count)], np.diff(before[chunk_at])

    def align(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray | list]:
        """What is known of each text, and codes of the links of all texts end to end."""
        rows = len(offsets) - 1
        length = np.diff(offsets)
        # Each text gets the space before it; an empty one stays empty.
        spaced = length + (length > 0)
        bounds = np.concatenate([[0], np.cumsum(spaced)])
        text = np.empty(int(bounds[-1]), np.uint8)
        text[bounds[:-1][length > 0]] = _SPACE
        text[ragged(bounds[1:] - length, length)] = data
        starts = bounds[:-1][length > 0] if self.cuts is None else chunk_starts(text, bounds, self.cuts)
        if not len(starts):
            return _no_tokens(rows)
        numbers = self.chunks.numbers(text, starts)
        n_a, n_b, groups, agree, codes, regular, written = self.chunks.columns
        first = np.searchsorted(starts, bounds)
        bad = np.concatenate([[0], np.cumsum(~agree.values[numbers])])
        bad = np.diff(bad[first]) > 0
        numbers = numbers[~np.repeat(bad, np.diff(first))]
        first = np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(first)))])

        def sums(column) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(column.values[numbers])])[first])

        letters, n_letters = written.take(numbers)
        line = np.concatenate([[0], np.cumsum(n_letters)])[first]
        letters = letters.astype(np.uint8).tobytes()
        # Without the semicolon at the end; texts without tokens have nothing.
        digests = [
            hashlib.sha256(letters[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(line[:-1], line[1:])
        ]
        return {
            "n_a": sums(n_a), "n_b": sums(n_b), "n_groups": sums(groups),
            "codes": codes.take(numbers)[0], "regular": regular.take(numbers)[0], "digests": digests,
        }


def _no_tokens(rows: int) -> dict[str, np.ndarray | list]:
    zero, none = np.zeros(rows, np.int64), np.zeros(0, np.int64)
    return {"n_a": zero, "n_b": zero, "n_groups": zero, "codes": none, "regular": none > 0, "digests": [""] * rows}


class _Bytes:
    """Byte strings end to end."""

    def __init__(self, tokens: list[bytes]):
        self.values = np.frombuffer(b"".join(tokens), np.uint8)
        self.count = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begin = np.cumsum(self.count) - self.count

    def agree(self, ids: np.ndarray, n_ids: np.ndarray, data: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each chunk whether the bytes of its tokens are its own."""
        total = np.concatenate([[0], np.cumsum(self.count[ids])])
        bounds = np.concatenate([[0], np.cumsum(n_ids)])
        like = np.diff(total[bounds]) == length
        taken = ids[np.repeat(like, n_ids)]
        wrong = self.values[ragged(self.begin[taken], self.count[taken])] != data[np.repeat(like, length)]
        wrong = np.concatenate([[0], np.cumsum(wrong)])
        ends = np.concatenate([[0], np.cumsum(np.where(like, length, 0))])
        return like & (np.diff(wrong[ends]) == 0)


_LINKS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, regular binary, irregular binary"
_NUMBERS = ["n_a", "n_b", "n_groups"]


def align(docs: DataFrame, byte_level: bytes, pieces: bytes, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """`docs` (the columns in `keep`, or all) with what alignment says of each document.

    `byte_level` (A) is the content of a file of the tokenizers library, `pieces` (B) of a
    sentencepiece model that puts a space before texts; A reads a space and the text.
    n_a, n_b, n_groups and n_links count tokens, groups and links; n_best, the links whose
    pair is linked most often, over all documents, of all pairs with its B id (ties
    included); count_sum adds up how often each link's pair is linked; groups_sha256 is the
    digest of the groups, `a1,a2|b1;a3|b2,b3`. A text that is null, empty, or not the same
    bytes for both tokenizers has no tokens: zeros and ''. Special tokens are plain text.
    Rows that repeat count each; input columns named like these are replaced. An empty
    table has no rows.
    """
    new = [*_NUMBERS, "n_links", "groups_sha256", "n_best", "count_sum"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    aligned = _aligned(docs, byte_level, pieces, keep, text)
    spark = docs.sparkSession
    key, code, n = (fresh(aligned, c) for c in ("key", "code", "n"))
    aligned = saved(aligned.withColumn(key, F.monotonically_increasing_id()), "aligned")
    aligner = Aligner(byte_level, pieces)
    a_size, b_size = aligner.a.size, aligner.b.size

    counts = saved(_pair_counts(aligned, a_size, b_size), "pair-counts")
    # One entry per id of A, and of B.
    vector = np.zeros(a_size, np.int64)
    for row in counts.where("regular").groupBy("code").agg(F.sum("n").alias("n")).collect():
        vector[row["code"]] = row["n"]
    irregular = counts.where("not regular").groupBy("code").agg(F.sum("n").alias("n"))
    irregular = saved(irregular, "irregular-pairs")
    best = np.zeros(b_size, np.int64)
    known = np.flatnonzero((vector > 0) & (aligner.same >= 0))
    np.maximum.at(best, aligner.same[known], vector[known])
    for row in irregular.groupBy((F.col("code") % b_size).alias("b")).agg(F.max("n").alias("n")).collect():
        best[row["b"]] = max(best[row["b"]], row["n"])
    total = irregular.agg(F.sum("n")).first()[0] or 0
    # At most FREQUENT_PAIRS rows, since their shares add up to one.
    frequent = irregular.where(F.col("n") * FREQUENT_PAIRS >= total).orderBy("code").collect()
    table = np.array([(row["code"], row["n"]) for row in frequent], np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((vector, aligner.same, best, table, b_size))

    partial = saved(_partial(aligned, shared, key), "partial")
    rest = partial.select(key, F.inline("rest"))
    rare = irregular.where(F.col("n") * FREQUENT_PAIRS < total).withColumnRenamed("n", "linked")
    highest = spark.createDataFrame(
        [(int(b), int(best[b])) for b in np.flatnonzero(best)], "b long, highest long"
    )
    rare = rare.join(F.broadcast(highest), (F.col("code") % b_size) == F.col("b"))
    rare = rare.select("code", "linked", (F.col("linked") == F.col("highest")).alias("is_best"))
    more = rest.join(rare, "code").groupBy(key)
    more = more.agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("linked")).alias("more_count"),
    )
    sums = partial.select(key, "best_links", "link_counts").join(more, key, "left").select(
        key,
        (F.col("best_links") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("link_counts") + F.coalesce("more_count", F.lit(0))).alias("count_sum"),
    )
    return aligned.join(sums, key).select(*[F.col(f"`{c}`") for c in keep], *new)


def _aligned(docs: DataFrame, byte_level: bytes, pieces: bytes, keep: list[str], text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((byte_level, pieces))
    source = fresh(docs, "text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias(source))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{schema}, {_LINKS}" if schema else _LINKS
    names = [*keep, *(field.split()[0] for field in _LINKS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = shared.value
        aligner = worker_copy("aligned", files, lambda: Aligner(*files))
        wide = np.uint32 if aligner.a.size * aligner.b.size <= 1 << 32 else np.uint64
        for batch in batches:
            raw, offsets = text_buffer(batch.column(source))
            for first, last in chunks(offsets):
                part = batch.slice(first, last - first)
                found = aligner.align(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                links = np.concatenate([[0], np.cumsum(found["n_groups"])])
                regular = found["regular"].astype(bool)
                before = np.concatenate([[0], np.cumsum(regular)])[links]
                one = found["codes"][regular] // aligner.b.size
                other = found["codes"][~regular]
                arrays = [pa.array(found[c], pa.int64()) for c in _NUMBERS]
                arrays += [pa.array(found["n_groups"], pa.int64()), pa.array(found["digests"], pa.string())]
                arrays += [_runs(one.astype(np.uint32), before), _runs(other.astype(wide), links - before)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names)

    return rows.mapInArrow(run, schema)


def _runs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of numbers as a binary column."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of `_runs`, and the bounds of its rows."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.int64), (offsets - offsets[0]) // size
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind)
    return values.astype(np.int64), (offsets - offsets[0]) // size


def _pair_counts(aligned: DataFrame, a_size: int, b_size: int) -> DataFrame:
    """(regular, code, n) of each task: codes are A ids where regular, else pairs."""
    wide = np.uint32 if a_size * b_size <= 1 << 32 else np.uint64

    def rows(regular: bool, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(np.full(len(codes), regular)), pa.array(codes), pa.array(counts)]
        return pa.RecordBatch.from_arrays(arrays, ["regular", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(a_size, np.int64)
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            vector += np.bincount(_values(batch.column("regular"), np.uint32)[0], minlength=a_size)
            new, n = np.unique(_values(batch.column("irregular"), wide)[0], return_counts=True)
            merged, place = np.unique(np.concatenate([codes, new]), return_inverse=True)
            # Counts are whole numbers far below 2^53.
            counts = np.bincount(place, np.concatenate([counts, n]), len(merged)).astype(np.int64)
            codes = merged
            if len(codes) > COUNTED_PAIRS:
                yield rows(False, codes, counts)
                codes, counts = codes[:0], counts[:0]
        used = np.flatnonzero(vector)
        yield rows(True, used, vector[used])
        yield rows(False, codes, counts)

    counted = aligned.select("regular", "irregular").mapInArrow(run, "regular boolean, code long, n long")
    return counted.groupBy("regular", "code").agg(F.sum("n").alias("n"))


def _partial(aligned: DataFrame, shared, key: str) -> DataFrame:
    """Sums over the links whose counts are at hand, and the others with their times."""
    schema = f"`{key}` long, best_links long, link_counts long, rest array<struct<code: long, times: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, same, best, table, b_size = shared.value
        wide = np.uint32 if len(vector) * b_size <= 1 << 32 else np.uint64
        # For regular links the pair's count, and whether it is its B id's highest.
        top = (same >= 0) & (vector == best[np.maximum(same, 0)])
        codes, counts = table[:, 0], table[:, 1]
        for batch in batches:
            ids, bounds = _values(batch.column("regular"), np.uint32)
            pairs, pair_bounds = _values(batch.column("irregular"), wide)
            at = np.minimum(np.searchsorted(codes, pairs), max(len(codes) - 1, 0))
            here = codes[at] == pairs if len(codes) else np.zeros(len(pairs), bool)
            linked = np.where(here, counts[at], 0) if len(codes) else np.zeros(len(pairs), np.int64)
            pair_top = here & (linked == best[pairs % b_size])

            def sums(values: np.ndarray, stops: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(values)])[stops])

            best_links = sums(top[ids], bounds) + sums(pair_top, pair_bounds)
            link_counts = sums(vector[ids], bounds) + sums(linked, pair_bounds)
            # The others, once per document with their times.
            row = np.repeat(np.arange(len(batch)), np.diff(pair_bounds))[~here]
            order = np.lexsort((pairs[~here], row))
            row, other = row[order], pairs[~here][order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (other[1:] != other[:-1])
            at = np.flatnonzero(first)
            times = np.diff(np.append(at, len(row)))
            stops = np.searchsorted(row[at], np.arange(len(batch) + 1))
            struct = pa.StructArray.from_arrays([pa.array(other[at]), pa.array(times)], ["code", "times"])
            rest = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), struct)
            arrays = [batch.column(key), pa.array(best_links), pa.array(link_counts), rest]
            yield pa.RecordBatch.from_arrays(arrays, [key, "best_links", "link_counts", "rest"])

    return aligned.select(key, "regular", "irregular").mapInArrow(run, schema)
