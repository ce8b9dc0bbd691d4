"""Near-duplicate detection by an inverted join of MinHash coordinates.

A document's set is the distinct hashes of its word shingles. Documents with equal sets are
one class from the start. A class has a signature of K coordinates, and two sets of
similarity s agree in each with probability s, so similar ones agree in at least T of them
(at 0.85, K = 64 and T = 36 miss fewer than one pair in ten million).

Prefix and skip. Each coordinate and value is a token that classes are posted under. Tokens
that one class has alone are not posted at all; with at most K - T tokens of a class left
out, any T common ones include one of the others, so of the tokens in the order of their
frequency only the first K - T + 1 are its prefix. Classes whose tokens are mostly their own
drop out here, and frequent tokens (boilerplate that many documents share) come last.

Candidates. A group of very many near copies would make all its pairs, so each class is first
compared with one class only: of those that lead a group by having the most frequent tokens,
as the original of many copies has, the one that it meets most often. What that joins is
one component. Later rounds take pairs of different components under one token, the
smaller components' classes against the others: first only against a few delegates of the
largest, which most of those that belong to it meet, then against more of them, and at last
against all. There, a pair also has to share one of the rarest shingles of both sets, early
enough in their order that enough can follow (prefix and position); copies that differ too much
from all others meet none, however many they are. Each set has parity bits: how many of its
members fall on a bit, modulo 2. Two sets' bits differ in at most as many places as the sets
do in members, so a pair whose bits differ in more than a link allows is none. Collisions
are counted on sketches of the signatures, of which a pair needs T. So no link between different
components is lost, and links inside one need not be known.

Links are confirmed on full sets, which are made anew for the classes in question only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.llm.common import (
    LOWER_BYTES,
    SMALL_CHUNK_BYTES,
    chunks,
    saved,
    shingle_hashes,
    span_hashes,
    text_buffer,
    word_spans,
    worker_tables,
)
from txloom.llm.components import components

# Everything but space and the ASCII controls 9 to 13.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[32, 9, 10, 11, 12, 13]] = False


@dataclass(frozen=True)
class Settings:
    """shingle: words of a shingle. percent: least similarity of a link, in percent.
    coordinates, matches: K and T. map_bits: size of the map that says whose sets are made.
    delegates: of the largest component, in the first of the later rounds; eight times as many are
    in the next one. Changes no result."""

    shingle: int = 5
    percent: int = 80
    coordinates: int = 64
    matches: int = 32
    map_bits: int = 1 << 26
    delegates: int = 8


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and summands of the coordinates' hash functions: a fixed function of k."""
    draw = np.random.Generator(np.random.PCG64(20240131)).integers(0, 1 << 63, (2, k), np.int64)
    return (draw[0].astype(np.uint64) << np.uint64(1)) | np.uint64(1), draw[1].astype(np.uint64)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of a text column.

    With fewer words than a shingle has, the whole sequence is one; without words none.
    """
    data, offsets = text_buffer(column)
    for first, last in chunks(offsets, SMALL_CHUNK_BYTES):
        low = LOWER_BYTES[data[offsets[first] : offsets[last]]]
        starts, ends, first_word = word_spans(low, offsets[first : last + 1] - offsets[first], WORD_BYTE)
        words = span_hashes(low, starts, ends)
        shingles = shingle_hashes(words, size)
        for row in range(last - first):
            a, b = int(first_word[row]), int(first_word[row + 1])
            own = shingles[a : b - size + 1] if b - a >= size else shingle_hashes(words[a:b], max(1, b - a))
            yield first + row, np.unique(own)


def signature(values: np.ndarray, seeds) -> np.ndarray:
    """Least hash of a set under each function, as 32 bits."""
    times, plus = seeds
    least = np.full(len(times), np.uint64(0xFFFFFFFFFFFFFFFF))
    for first in range(0, len(values), 512):
        part = values[first : first + 512]
        np.minimum(least, (part[:, None] * times + plus).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _class_id(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signed(docs: DataFrame, id_col: str, text: str, s: Settings) -> DataFrame:
    """(id, n, class, sketch) per document and, in `coordinates`, the signature."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables("minhash")
        seeds = _seeds(s.coordinates)
        for batch in batches:
            sizes, classes, coordinates = [], [], []
            for _, values in shingle_sets(batch.column("text"), s.shingle):
                sizes.append(len(values))
                classes.append(_class_id(values) if len(values) else None)
                coordinates.append(signature(values, seeds).view(np.int32) if len(values) else None)
            arrays = [
                batch.column("id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()),
                pa.array(coordinates, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "class", "coordinates"])

    return rows.mapInArrow(run, f"id {id_type}, n long, class long, coordinates array<int>")


def _postings(classes: DataFrame, s: Settings) -> DataFrame:
    """(class, token, weight) for the prefix of each class that shares enough tokens.

    `weight` is the sum of the frequencies of all its tokens.
    """
    each = classes.select("class", F.posexplode("coordinates").alias("at", "value"))
    token = F.shiftleft(F.col("at").cast("long"), 32) + F.col("value")
    tokens = each.select("class", token.alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    own = tokens.join(shared, "token").groupBy("class")
    # At most K entries.
    lists = own.agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    length = F.size("tokens") - s.matches + 1
    prefix = F.slice("tokens", F.lit(1), F.greatest(length, F.lit(0)))
    weight = F.aggregate("tokens.n", F.lit(0).cast("long"), lambda acc, n: acc + n)
    return lists.select("class", weight.alias("weight"), F.explode(prefix).alias("t")).select("class", "t.token", "weight")


def _map_of(classes: DataFrame, bits: int) -> np.ndarray:
    """A map of `bits` bits with those of a column `class` set; its size bounds what is collected."""
    at = F.expr(f"pmod(class, {bits})")
    word = F.shiftright(at, 6).alias("word")
    words = classes.groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(class, {bits}) & 63 as int))")).alias("b"))
    found = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("b").to_numpy()
    return out.view(np.uint64)


def _sets(docs: DataFrame, text: str, wanted: DataFrame, s: Settings) -> DataFrame:
    """(class, members) of the `wanted` classes, made again from the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(_map_of(wanted, s.map_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        sent: set[int] = set()
        for batch in batches:
            classes, sets = [], []
            for _, values in shingle_sets(batch.column(0), s.shingle):
                if not len(values):
                    continue
                one = _class_id(values)
                bit = one % s.map_bits
                if int(words[bit >> 6]) >> (bit & 63) & 1 and one not in sent:
                    # Copies in one task are sent once; the memory for that is bounded.
                    if len(sent) < 1_000_000:
                        sent.add(one)
                    classes.append(one)
                    sets.append(values.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], ["class", "members"])

    made = docs.select(text).mapInArrow(run, "class long, members binary")
    return made.groupBy("class").agg(F.first("members").alias("members"))


# Parity bits of a set, and the columns of 64 that hold them.
PARITY_BITS = 512
PARITIES = [f"p{k}" for k in range(PARITY_BITS // 64)]


def _with_parities(sets: DataFrame) -> DataFrame:
    """`sets` with their parity bits in the columns PARITIES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((len(batch), PARITY_BITS), bool)
            for row, members in enumerate(batch.column("members")):
                place = (np.frombuffer(members.as_buffer(), np.uint64) & np.uint64(PARITY_BITS - 1)).astype(np.int64)
                bits[row] = np.bincount(place, minlength=PARITY_BITS) & 1
            words = np.packbits(bits, axis=1).view(np.int64)
            columns = [batch.column("class"), batch.column("members"), *[pa.array(words[:, k]) for k in range(len(PARITIES))]]
            yield pa.RecordBatch.from_arrays(columns, ["class", "members", *PARITIES])

    schema = ", ".join(f"{name} long" for name in PARITIES)
    return sets.mapInArrow(run, f"class long, members binary, {schema}")


def _confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    first = pairs.join(sets.select(F.col("class").alias("a"), F.col("members").alias("set_a")), "a")
    both = first.join(sets.select(F.col("class").alias("b"), F.col("members").alias("set_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= s.percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _rarest(sets: DataFrame, s: Settings) -> DataFrame:
    """(class, token, place): the members that one of must be common to two similar sets.

    In the order of their frequency in all `sets`, with members that one set has alone
    first. A set of n members leaves out so many of its last that any similar one has
    another in common; `place` counts from 0 over all of its members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, members in zip(batch.column("class").to_pylist(), batch.column("members")):
                values = np.frombuffer(members.as_buffer(), np.int64)
                columns = [np.full(len(values), one), np.full(len(values), len(values)), values]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["class", "size", "token"])

    each = sets.select("class", "members").mapInArrow(run, "class long, size long, token long")
    several = each.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    lists = each.join(several, "token").groupBy("class", "size")
    # As many as the set has.
    lists = lists.agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    alone = (F.col("size") - F.size("tokens")).cast("int")
    last = F.expr(f"cast(size - (size * {s.percent} + 99) div 100 as int)")
    prefix = F.slice("tokens", F.lit(1), F.greatest(last - alone + 1, F.lit(0)))
    rows = lists.select("class", alone.alias("alone"), F.posexplode(prefix).alias("at", "t"))
    return rows.select("class", "t.token", (F.col("alone") + F.col("at")).alias("place"))


def _sketch(coordinates, part: int):
    """Four bits of each of 16 coordinates, as one number."""
    values = F.slice(coordinates, part * 16 + 1, 16)
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, 4).bitwiseOR(v.bitwiseAND(15).cast("long")))


def _agreements(left: list[str], right: list[str]):
    """How many of the sketched coordinates agree; at least as many as coordinates that agree."""
    total = F.lit(0)
    for a, b in zip(left, right):
        x = F.col(a).bitwiseXOR(F.col(b))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(0x1111111111111111)
        total = total + 16 - F.bit_count(x)
    return total


def _meetings(postings: DataFrame, joined: DataFrame) -> DataFrame:
    """`postings` with their `component`, and the largest (`most`) under their token; only of
    tokens under which different components meet."""
    placed = postings.join(joined.withColumnRenamed("node", "class"), "class", "left")
    placed = placed.withColumn("component", F.coalesce("component", "class"))
    counted = placed.groupBy("token", "component").agg(F.count("*").alias("size"))
    largest = F.max_by("component", F.struct("size", "component")).alias("most")
    mixed = counted.groupBy("token").agg(largest, F.count("*").alias("kinds")).where("kinds > 1")
    return placed.join(mixed.select("token", "most"), "token")


def _pairs(there: DataFrame, sketches: list[str], delegates: int | None, s: Settings) -> DataFrame:
    """Pairs (a, b) of classes of different components under one token, as far as sizes,
    places and collisions allow links; with `delegates`, only those with the
    heaviest classes of the largest component, one of each of so many parts."""
    few, other = there.where("component != most"), there
    if delegates is not None:
        part = F.pmod(F.xxhash64("class"), F.lit(delegates))
        own = [c for c in there.columns if c != "token"]
        heaviest = F.max_by(F.struct(*own), F.struct("weight", "class")).alias("h")
        other = there.where("component = most").groupBy("token", part).agg(heaviest).select("token", "h.*")
    renamed = [F.col(c).alias(f"{c}_b") for c in ("class", "component", "n", "place", *PARITIES, *sketches)]
    pairs = few.drop("most").join(other.select("token", "most", *renamed), "token")
    # Members that similar sets of these sizes have in common at least.
    needed = F.expr(f"((n + n_b) * {s.percent} + {99 + s.percent}) div {100 + s.percent}")
    apart = F.lit(0)
    for c in PARITIES:
        apart = apart + F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b")))
    pairs = pairs.where(
        (F.col("component") != F.col("component_b"))
        # Pairs of two smaller components stand on both sides: one of them is enough.
        & ((F.col("component_b") == F.col("most")) | (F.col("class") < F.col("class_b")))
        & (100 * F.least("n", "n_b") >= s.percent * F.greatest("n", "n_b"))
        & (F.col("n") - F.col("place") >= needed)
        & (F.col("n_b") - F.col("place_b") >= needed)
        & (apart <= F.col("n") + F.col("n_b") - 2 * needed)
        & (_agreements(sketches, [f"{c}_b" for c in sketches]) >= s.matches)
    )
    return pairs.select(F.col("class").alias("a"), F.col("class_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of `docs`.

    `component_id` is the least id that can be reached over links, `kept` says whether it is the
    row's own. Rows without words have no shingles and are linked with nothing, so each is its
    own component and kept. Null ids take part in links but name no component they share with
    an id; alone, they are kept under a null component. Repeated rows are kept alike. An empty
    table gives no rows; other columns are not looked at.
    """
    s = settings
    signed = saved(_signed(docs, id_col, text, s), "signed")
    some = signed.where("class is not null")
    classes = some.groupBy("class").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("coordinates").alias("coordinates")
    )
    classes = saved(classes, "classes")
    postings = saved(_postings(classes, s), "postings")
    leader = F.max_by("class", F.struct("weight", "class")).alias("leader")
    groups = postings.groupBy("token").agg(leader, F.count("*").alias("size")).where("size > 1")
    met = postings.join(groups.select("token", "leader"), "token").where("class != leader")
    met = met.groupBy("class", "leader").agg(F.count("*").alias("times"))
    stars = met.groupBy("class").agg(F.max_by("leader", F.struct("times", "leader")).alias("leader"))
    stars = saved(stars.select(F.col("class").alias("a"), F.col("leader").alias("b")), "stars")
    ends = stars.select(F.col("a").alias("class")).unionByName(stars.select(F.col("b").alias("class")))
    links = saved(_confirmed(stars, _sets(docs, text, ends.distinct(), s), s), "links")
    joined = saved(components(links), "components")

    sketches = [f"s{k}" for k in range(s.coordinates // 16)]
    short = classes.select("class", "n", *[_sketch("coordinates", k).alias(name) for k, name in enumerate(sketches)])
    meeting = _meetings(postings, joined).select("class").distinct()
    sets = saved(_with_parities(_sets(docs, text, meeting, s)), "sets")
    weights = postings.select("class", "weight").distinct()
    about = short.join(sets.select("class", *PARITIES), "class").join(weights, "class")
    rare = saved(_rarest(sets, s).join(about, "class"), "rarest")
    for delegates in (s.delegates, 8 * s.delegates, None):
        there = saved(_meetings(rare, joined), "there")
        pairs = saved(_pairs(there, sketches, delegates, s), "pairs")
        links = saved(_confirmed(pairs, sets, s), "links").unionByName(
            joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
        )
        joined = saved(components(links), "components")
    joined = joined.withColumnRenamed("node", "class")
    named = classes.select("class", "id").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = named.join(least, "component").select("class", "component_id")
    out = signed.select("id", "n", "class").join(of_class, "class", "left")
    name = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), name.alias("component_id"),
        F.col("id").eqNullSafe(name).alias("kept"),
    )
