"""Library tokenizers by chunks, their alignment, and token files, against plain loops."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from txloom.llm import alignment, token_files
from txloom.llm.queries import tokenizer_bytes
from txloom.llm.tokenizers import ByteLevel, Encoder, Pieces, chunk_starts
from txloom.session import scratch

ALPHABET = [
    " ", "  ", "\n", "\t", "a", "B", "é", "漢", "\xa0", "　", " ", "'s", "'", "1", "2", "!", "...", "word",
    "▁", "\x85", "\x1c", "\x00", "ß", "٣", "​", "<|endoftext|>", "\r\n", "𝕏", "🙂", "ა", "か", "'ll", "\n\n", "—",
]


@pytest.fixture(scope="module")
def files():
    return tokenizer_bytes("byte_bpe_50k.json"), tokenizer_bytes("piece_bpe_32k.model")


def noise(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def laid(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def test_chunks_are_encoded_like_whole_texts(files):
    tokenizer, pieces = ByteLevel(files[0]), Pieces(files[1])
    texts = noise(4000)
    ids, counts = Encoder(tokenizer).encode(*laid(texts))
    want = [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    for text in texts:
        data, offsets = laid([" " + text])
        bounds = [*chunk_starts(data, offsets, pieces.cuts), len(data)]
        chunks = [data[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        if text and "▁" not in text:
            assert sum(pieces.encode_spaced(chunks), []) == pieces.model.encode(text)


def test_a_vocabulary_without_safe_cuts_is_asked_for_whole_texts(files):
    tokenizer = ByteLevel(files[0])
    tokenizer.cuts = None
    texts = noise(300, 2)
    ids, counts = Encoder(tokenizer).encode(*laid(texts))
    want = [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(ids) == sum(want, []) and list(counts) == [len(w) for w in want]


def plain_files(rows, tokenizer, end_id):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("end_id", [0, 50256, 70_000])
def test_token_files(spark, awkward, files, end_id):
    """Nulls first, repeats side by side; parts of any size; ids that need 32 bits."""
    tokenizer = ByteLevel(files[0]).tokenizer
    folder = scratch(spark, "files")
    token_files.write(awkward, files[0], folder, end_id=end_id, part_bytes=1 << 16)
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    read = token_files.read(spark, folder, read_bytes=1 << 14)
    found = read.select("doc_id", "start", "n_tokens", F.crc32("ids")).orderBy("start").collect()
    want = plain_files(rows, tokenizer, end_id)
    # Rows of one id come in any order; their places follow from their lengths.
    key = str
    assert sorted([(r[0], r[2], r[3]) for r in found], key=key) == sorted([(w[0], w[2], w[3]) for w in want], key=key)
    assert [r[0] for r in found] == [w[0] for w in want]
    assert [r[1] for r in found] == [0, *np.cumsum([r[2] for r in found])[:-1]]


def test_token_files_of_nothing_and_of_one_id(spark, nothing, files):
    folder = scratch(spark, "files")
    token_files.write(nothing, files[0], folder)
    assert token_files.read(spark, folder).count() == 0
    folder = scratch(spark, "files")
    hot = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("some equal text").alias("text"))
    token_files.write(hot, files[0], folder, part_bytes=1 << 14)
    found = token_files.read(spark, folder)
    assert found.count() == 3000 and found.select("ids").distinct().count() == 1
    parts = spark.read.parquet(f"{folder}/parts")
    # One id does not end up in one part.
    assert parts.count() > 3 and parts.agg(F.max("n_docs")).first()[0] < 1500


def plain_alignment(texts, files):
    a_side, b_side = ByteLevel(files[0]), Pieces(files[1])
    a_bytes, b_bytes = a_side.token_bytes(), b_side.token_bytes()
    out, count = [], Counter()
    for text in texts:
        n, groups = (0, 0), []
        if text:
            a = a_side.tokenizer.encode(" " + text, add_special_tokens=False).ids
            b = b_side.model.encode(text)
            whole = (" " + text).encode()
            if b"".join(a_bytes[i] for i in a) == whole == b"".join(b_bytes[i] for i in b):
                n, left, right, ours, theirs = (len(a), len(b)), 0, 0, [], []
                rest = list(b)
                for i in a:
                    left += len(a_bytes[i])
                    ours.append(i)
                    while right < left:
                        right += len(b_bytes[rest[0]])
                        theirs.append(rest.pop(0))
                    if left == right:
                        groups.append((ours, theirs))
                        ours, theirs = [], []
        links = [(x[-1], y[-1]) for x, y in groups]
        count.update(links)
        out.append((n, groups, links))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    rows = []
    for n, groups, links in out:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(line.encode()).hexdigest() if groups else ""
        high = sum(count[p] == best[p[1]] for p in links)
        rows.append((*n, len(groups), len(links), high, sum(count[p] for p in links), digest))
    return rows


@pytest.mark.parametrize("frequent", [1 << 17, 20])
def test_alignment(spark, awkward, files, monkeypatch, frequent):
    """The same whichever pairs are sent to the workers."""
    monkeypatch.setattr(alignment, "FREQUENT_PAIRS", frequent)
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(noise(400, 3))], "doc_id long, text string")
    docs = awkward.unionByName(more, allowMissingColumns=True)
    found = alignment.align(docs, *files)
    assert set(awkward.columns) <= set(found.columns)
    columns = ["text", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    texts = [r.text for r in docs.select("text").collect()]
    want = [(t, *row) for t, row in zip(texts, plain_alignment(texts, files))]
    assert sorted(map(str, map(tuple, found.select(columns).collect()))) == sorted(map(str, want))
    assert any(row[1] == 0 and row[0] for row in want) and any(row[4] > row[5] for row in want)


def test_alignment_of_nothing(spark, nothing, files):
    assert alignment.align(nothing, *files).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    found = alignment.align(empty, *files).select("n_a", "n_links", "count_sum", "groups_sha256").distinct()
    assert [tuple(r) for r in found.collect()] == [(0, 0, 0, "")]
