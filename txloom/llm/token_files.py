"""Token ids of a corpus as flat binary files.

A folder holds, for every part, three files without headers, all little-endian: `.ids`, the
token ids of its documents end to end as unsigned 16- or 32-bit integers; `.offsets`, one
64-bit integer per document and one more, where each starts in that file; and `.docs`, the
64-bit ids of the documents. Documents are in ascending order of their ids across parts. A
Parquet table `parts` names the files and gives each part's base, the prefix sum of the
parts before it, so the place of a document in the whole corpus is its part's base plus its
offset, and any of it can be read by mapping files into memory.

Texts are range-sorted by document id and each task streams its range through the tokenizer
into its files, under a name of its own that is changed when they are whole: running a task
again gives the same files. `parts` is written last; without it there is nothing to read.
"""

from __future__ import annotations

import math
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txloom.llm.common import chunks, text_buffer
from txloom.llm.tokenizers import ByteLevel, Encoder, worker_copy

#: Bytes of text for one part, and of ids that one task of a reader takes.
PART_BYTES = 64 << 20
READ_BYTES = 32 << 20

_STATS = "part int, name string, itemsize int, n_docs long, n_null long, n_ids long"
_ROWS = "doc_id long, start long, n_tokens long, ids binary"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path there."""
    if re.match(r"(file:)?/", folder):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", folder)
    return fs.FileSystem.from_uri(folder)


def write(
    docs: DataFrame,
    tokenizer: bytes,
    folder: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    part_bytes: int = PART_BYTES,
) -> None:
    """Encode every whole text, append `end_id`, and write the files to a new `folder`.

    `tokenizer` is the content of a file of the tokenizers library; special tokens are not
    added, and their strings in texts are plain text. `folder` is one that all executors
    share. Ids are 16-bit if the vocabulary allows it. A null or empty text has the end id
    alone. Rows without an id come first; rows that repeat, or share an id, are all
    written, next to each other. Other columns are not read. An empty table gives no parts.
    """
    spark = docs.sparkSession
    files, root = _place(folder)
    files.create_dir(root, recursive=True)
    shared = spark.sparkContext.broadcast(tokenizer)
    size = max(ByteLevel(tokenizer).size, end_id + 1)
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    # The place of a row splits a range of equal ids; rows with equal texts are alike.
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = rows.select("*", *[k.alias(n) for k, n in zip(keys[1:], ("same", "place"))])
    order = [keys[0], "same", "place"]
    parts = max(1, math.ceil(total / part_bytes))
    sorted_rows = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_copy("ids", (shared.value,), lambda: Encoder(ByteLevel(shared.value)))
        part = TaskContext.get().partitionId()
        out, path = _place(folder)
        name = f"part-{part:06d}"
        own = f"{path}/_{name}-{uuid.uuid4().hex}"
        n_docs, n_null, n_ids = 0, 0, 0
        with (
            out.open_output_stream(f"{own}.ids") as ids_file,
            out.open_output_stream(f"{own}.offsets") as offsets_file,
            out.open_output_stream(f"{own}.docs") as docs_file,
        ):
            offsets_file.write(np.zeros(1, "<u8"))
            for batch in batches:
                numbers = batch.column("doc_id")
                n_null += numbers.null_count
                docs_file.write(np.asarray(numbers.fill_null(0)).astype("<i8"))
                raw, offsets = text_buffer(batch.column("text"))
                for first, last in chunks(offsets):
                    some = offsets[first : last + 1] - offsets[first]
                    ids, count = encoder.encode(raw[offsets[first] : offsets[last]], some)
                    ends = np.cumsum(count + 1)
                    with_end = np.full(int(ends[-1]), end_id, kind)
                    keep = np.ones(len(with_end), bool)
                    keep[ends - 1] = False
                    with_end[keep] = ids
                    ids_file.write(with_end)
                    offsets_file.write((n_ids + ends).astype("<u8"))
                    n_ids += len(with_end)
                    n_docs += last - first
        for end in ("ids", "offsets", "docs"):
            out.move(f"{own}.{end}", f"{path}/{name}.{end}")
        values = [part, name, kind.itemsize, n_docs, n_null, n_ids]
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, values))], _SCHEMA)

    sorted_rows.mapInArrow(run, _STATS).where("n_docs > 0").write.parquet(f"{folder}/written")
    # One row per part.
    before = F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")
    written = spark.read.schema(_STATS).parquet(f"{folder}/written")
    written.withColumn("base", before).write.parquet(f"{folder}/parts")


_NAMES = [field.split()[0] for field in _STATS.split(", ")]
_SCHEMA = pa.schema(list(zip(_NAMES, [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])))


def _mapped(files: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A flat file as an array: mapped into memory, or, in a remote store, read."""
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with files.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


def read(spark: SparkSession, folder: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files of `folder`.

    `start` is the number of ids of all documents before it, `n_tokens` counts its ids with
    the end id, and `ids` holds them as little-endian unsigned 32-bit integers. A part is
    read in ranges of its documents, so tasks are of like size whatever parts hold.
    """
    parts = spark.read.schema(f"{_STATS}, base long").parquet(f"{folder}/parts")
    # Documents of a part in as many ranges as its ids need.
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_ids") * 4 / read_bytes)).cast("long")
    step = F.ceil(F.col("n_docs") / ranges).cast("long")
    pieces = parts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, step)).alias("first"))
    pieces = pieces.withColumn("last", F.least(F.col("first") + step, "n_docs"))
    columns = ["part", "name", "itemsize", "n_null", "base", "first", "last"]
    tasks = max(1, pieces.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _place(folder)
        for batch in batches:
            for piece in batch.to_pylist():
                path = f"{root}/{piece['name']}"
                offsets = _mapped(files, f"{path}.offsets", "<u8")
                numbers = _mapped(files, f"{path}.docs", "<i8")
                ids = _mapped(files, f"{path}.ids", f"<u{piece['itemsize']}")
                bounds = offsets[piece["first"] : piece["last"] + 1].astype(np.int64)
                for a, b in chunks(bounds * 4):
                    first, last = piece["first"] + a, piece["first"] + b
                    own = ids[bounds[a] : bounds[b]].astype("<u4")
                    places = (bounds[a : b + 1] - bounds[a]) * 4
                    null = np.arange(first, last) < piece["n_null"]
                    binary = [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(own)]
                    arrays = [
                        pa.array(np.array(numbers[first:last]), pa.int64(), mask=null),
                        pa.array(piece["base"] + bounds[a:b]),
                        pa.array(np.diff(bounds[a : b + 1])),
                        pa.Array.from_buffers(pa.binary(), b - a, binary),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids"])

    return pieces.select(columns).repartition(tasks).mapInArrow(run, _ROWS)
