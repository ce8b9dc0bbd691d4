"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams that both have, for all n of a
blended spectrum, over the geometric mean of the numbers that each has: presence, not
counts. The n-grams of some landmark texts span the kernel's space (Nyström): a text
is mapped to its kernel values with the landmarks, whitened by the inverse root of the
landmarks' own kernel matrix. On that map one ridge regression per language is trained
against the rest.

Training takes a bounded sample of labelled rows (`Settings.train_rows`, spread evenly over
languages), landmarks are a part of it, and both are documented bounds. Prediction takes
every whole text, where it lies, in batches of two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txloom.llm.common import CHUNK_BYTES, chunks, text_buffer, worker_tables

#: The answer for texts without letters.
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds and parameters.

    spectrum: lengths of the n-grams.
    features: n-grams are told apart by a hash into so many presence bits.
    train_rows: most labelled texts that are used, shared out evenly over languages.
    train_languages: most languages that are learned, those with the most texts.
    landmarks: most landmark texts, taken evenly from all languages.
    ridge: weight of the penalty.
    """

    spectrum: tuple[int, ...] = (1, 2, 3)
    features: int = 1 << 13
    train_rows: int = 4000
    train_languages: int = 200
    landmarks: int = 200
    ridge: float = 0.1


_tables: dict[str, np.ndarray] = {}


def _folded() -> np.ndarray:
    """Code point tables: its lower case if a letter, else 0 (one table, 4 bytes per code point)."""
    if "fold" not in _tables:
        fold = np.zeros(0x110000, np.uint32)
        # One character at a time: a string joined of all takes a worker some 80 MB.
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                fold[i] = ord(low) if len(low) == 1 else i
        _tables["fold"] = fold
    return _tables["fold"]


def presence(data: bytes, offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Presence bits (rows by features, as floats) of UTF-8 texts end to end, and letter counts.

    Letters are lower-cased, runs of anything else are one break, and n-grams do not cross
    texts.
    """
    rows = len(offsets) - 1
    out = np.zeros((rows, settings.features), np.float32)
    letters = np.zeros(rows, np.int64)
    if not len(data):
        return out, letters
    raw = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    points = _folded()[np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)]
    row = np.repeat(np.arange(rows), np.diff(np.searchsorted(starts, offsets)))
    letters += np.bincount(row, points > 0, rows).astype(np.int64)
    # Only the first of a run of breaks stays.
    stays = points > 0
    stays[1:] |= (points[1:] == 0) & ((points[:-1] > 0) | (row[1:] != row[:-1]))
    stays[0] = True
    points, row = points[stays], row[stays]
    flat = out.reshape(-1)
    key = np.zeros(len(points), np.uint32)
    for n in range(1, max(settings.spectrum) + 1):
        # The key of the n-gram that starts here, from that of the one a letter shorter.
        if len(points) < n:
            break
        key = key[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(n)
        if n in settings.spectrum:
            mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            place = (mixed ^ (mixed >> np.uint32(13))) % np.uint32(settings.features)
            same = row[: len(key)] == row[n - 1 :]
            flat[row[: len(key)][same] * settings.features + place[same]] = 1.0
    return out, letters


def _normal(present: np.ndarray) -> np.ndarray:
    return present / np.sqrt(np.maximum(present.sum(1, keepdims=True), 1.0))


@dataclass
class Model:
    """Landmarks (rows of normalised presence), what maps kernel values to scores, languages."""

    landmarks: np.ndarray
    weights: np.ndarray
    languages: list[str]
    settings: Settings

    def scores(self, present: np.ndarray) -> np.ndarray:
        return (_normal(present) @ self.landmarks.T) @ self.weights


def train(labelled: DataFrame, text: str, lang: str, settings: Settings = Settings()) -> Model:
    """A model of `labelled`; rows without text or language are not used.

    Of each language its share of `train_rows` is taken, or all distinct texts if there are
    fewer: those with the lowest hashes, equal texts once. So the sample does not depend on how
    rows are spread, and copies can neither fill it nor empty it. Only presence bits of
    the sampled, whole texts come to the driver: `train_rows * features / 8` bytes at most.
    Without labelled rows every prediction is `und`.
    """
    s = settings
    usable = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    usable = usable.withColumn("h", F.xxhash64("text"))
    distinct = usable.groupBy("lang", "h").agg(F.count("*").alias("n"))
    counts = distinct.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    top = counts.orderBy(F.desc("n"), "lang").limit(s.train_languages).collect()
    top = {row.lang: row.texts for row in sorted(top, key=lambda row: row.lang)}
    if not top:
        return Model(np.zeros((1, s.features), np.float32), np.zeros((1, 0), np.float32), [], s)
    quota = max(1, s.train_rows // len(top))
    # Of the distinct hashes, enough are below the rate that fewer than the quota have a chance
    # below 1e-15; a language with few has all of them.
    rates = usable.sparkSession.createDataFrame(
        [(name, min(1.0, (2.0 * quota + 64) / n)) for name, n in top.items()], "lang string, rate double"
    )
    unit = F.shiftrightunsigned("h", 11) / float(1 << 53)
    # One row per learned language, `train_languages` at most.
    some = usable.join(F.broadcast(rates), "lang").where(unit < F.col("rate"))
    some = some.groupBy("lang", "h").agg(F.first("text").alias("text"))
    lowest = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "h")
    some = some.withColumn("rank", F.row_number().over(lowest)).where(F.col("rank") <= quota)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables("language")
        for batch in batches:
            for first, last, present, _ in _presence_parts(batch.column("text"), s, small=True):
                packed = np.packbits(present > 0, axis=1)
                part = batch.slice(first, last - first)
                rows = pa.array([row.tobytes() for row in packed], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("rank"), rows], ["lang", "rank", "bits"]
                )

    sample = some.select("lang", "rank", "text").mapInArrow(bits, "lang string, rank int, bits binary")
    rows = sorted(sample.collect(), key=lambda row: (row["rank"], row["lang"]))
    packed = np.frombuffer(b"".join(bytes(row.bits) for row in rows), np.uint8).reshape(len(rows), -1)
    normal = _normal(np.unpackbits(packed, axis=1, count=s.features).astype(np.float32))
    languages = list(top)
    truth = np.array([languages.index(row.lang) for row in rows])
    # Sorted by rank first, so the landmarks are even over languages.
    marks = normal[: s.landmarks]
    values, vectors = np.linalg.eigh(marks.astype(np.float64) @ marks.T)
    solid = values > values.max() * 1e-6
    whiten = vectors[:, solid] / np.sqrt(values[solid])
    mapped = (normal @ marks.T) @ whiten
    target = np.where(truth[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Each language's rows weigh alike in total, however many could be had.
    weight = 1.0 / np.bincount(truth, minlength=len(languages))[truth]
    gram = mapped.T @ (mapped * weight[:, None])
    penalty = s.ridge * np.trace(gram) / len(gram) * np.eye(len(gram))
    beta = np.linalg.solve(gram + penalty, mapped.T @ (target * weight[:, None]))
    return Model(marks, (whiten @ beta).astype(np.float32), languages, s)


#: Texts that are scored in one product. Their number shows in the last digits of a score.
BATCH_ROWS = 1024
#: A smaller number, and bytes of so many texts: a worker holds the arrays of these at a time.
SMALL_BATCH_ROWS = 128
SMALL_BATCH_BYTES = 1 << 17


def _presence_parts(column: pa.Array, settings: Settings, small: bool):
    """Row ranges of a text column, `small` ones or larger, with their presence bits and letter counts."""
    rows, size = (SMALL_BATCH_ROWS, SMALL_BATCH_BYTES) if small else (BATCH_ROWS, CHUNK_BYTES)
    data, offsets = text_buffer(column)
    if len(offsets) == 1:
        return
    for begin, end in chunks(offsets, size):
        for first in range(begin, end, rows):
            last = min(first + rows, end)
            part = data[offsets[first] : offsets[last]].tobytes()
            yield first, last, *presence(part, offsets[first : last + 1] - offsets[first], settings)


def predict(
    docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, small: bool = False
) -> DataFrame:
    """`docs` (or its columns `keep`) with `lang_pred` and `score` (0 to 1: the margin of the best
    language, halved and shifted).

    A null or empty text, or one without letters, is `und` with score 0, and so is every
    text if the model knows no language. Ties go to the language that sorts first. Repeated
    rows are predicted alike; input columns named like the two are replaced. With `small`, workers
    score fewer texts at a time and take less memory.
    """
    # A table of landmarks by features, bounded by the settings.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    kept = docs.columns if keep is None else keep
    schema = ", ".join(f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in kept)
    # No column before the first added one, if none is kept.
    schema = ", ".join([schema] * bool(kept) + ["lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables("language")
        known = shared.value
        names = np.array([*known.languages, UNDETERMINED], object)
        for batch in batches:
            for first, last, present, letters in _presence_parts(batch.column(text), known.settings, small):
                best = np.full(last - first, len(known.languages))
                score = np.zeros(last - first)
                if known.languages:
                    margin = known.scores(present)
                    best = np.where(letters > 0, margin.argmax(1), best)
                    score = np.where(letters > 0, np.clip((margin.max(1) + 1) / 2, 0, 1), 0.0)
                part = batch.slice(first, last - first)
                columns = [part.column(name) for name in kept]
                columns += [pa.array(names[best], pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
