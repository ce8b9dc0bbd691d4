"""Byte-level BPE encoding and decoding by a rank file.

Texts are cut into pieces without a regular expression. Each code point becomes a symbol
(letter, number, space and so on, with what follows it), each symbol is a transition
function of a small automaton, and a scan that composes these functions gives the state
before every code point of a whole batch of texts; a piece starts where the state and the
symbol say so. Function composition is associative, so the scan runs on rows of the array
at once. Pieces are then merged by rank, with a bounded cache, and tokens keep the byte
offsets that decoding and alignment need.

Texts are encoded where they lie: no shuffle, a batch of texts at a time.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from txloom.llm.common import CHUNK_BYTES, chunks, span_hashes, text_buffer, worker_tables

# Code point classes.
_LETTER, _NUMBER, _OTHER, _SPACE, _WHITE = range(5)
# States: nothing open, a run of each class, one space waiting for its run, and a
# contraction with one or two letters to come.
_E, _L, _N, _O, _S, _P, _C1, _C2 = range(8)
# Symbols: the classes, an apostrophe that opens a contraction of one or two letters, a
# space or other white space before something else, and white space before white space.
_SYMBOLS = 8
# Next state and whether a piece starts, by symbol and then state.
_STEP = np.array(
    [
        #   E    L    N    O    S    P    C1   C2
        [_L, _L, _L, _L, _L, _L, _E, _C1],  # letter
        [_N, _N, _N, _N, _N, _N, _N, _N],  # number
        [_O, _O, _O, _O, _O, _O, _O, _O],  # other
        [_C1, _C1, _C1, _O, _C1, _O, _C1, _C1],  # apostrophe and one letter
        [_C2, _C2, _C2, _O, _C2, _O, _C2, _C2],  # apostrophe and two letters
        [_P, _P, _P, _P, _P, _P, _P, _P],  # last space
        [_S, _S, _S, _S, _S, _S, _S, _S],  # last other white space
        [_S, _S, _S, _S, _S, _S, _S, _S],  # white space before more
    ],
    np.uint8,
)
_STARTS = np.array(
    [
        [1, 0, 1, 1, 1, 0, 0, 0],
        [1, 1, 0, 1, 1, 0, 1, 1],
        [1, 1, 1, 0, 1, 0, 1, 1],
        [1, 1, 1, 0, 1, 0, 1, 1],
        [1, 1, 1, 0, 1, 0, 1, 1],
        [1, 1, 1, 1, 1, 1, 1, 1],
        [1, 1, 1, 1, 1, 1, 1, 1],
        [1, 1, 1, 1, 0, 1, 1, 1],
    ],
    bool,
)
_ROWS = 64

#: Pieces that a Python worker keeps with their tokens before it starts anew, the longest
#: that are merged side by side, and how many of them at once.
CACHE_PIECES = 400_000
CACHE_PIECE_BYTES = 64
MERGED_PIECES = 20_000
# No such pair of tokens.
_NONE = 1 << 60


def code_point_classes() -> np.ndarray:
    """The class of every code point, by the properties that the tokenizer's library knows.

    Properties change with Unicode versions; asking that library for the characters that a
    property matches keeps both alike. One byte per code point, 1.1 MB.
    """
    import tiktoken

    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    out = np.full(0x110000, _OTHER, np.uint8)
    single = {bytes([i]): i for i in range(256)}
    for pattern, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _WHITE)):
        own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        matched = bytes(own.encode_ordinary(every)).decode()
        out[np.frombuffer(matched.encode("utf-32-le"), np.uint32)] = kind
    out[32] = _SPACE
    return out


def _contains(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of `some` are in the sorted `keys`."""
    if not len(keys):
        return np.zeros(len(some), bool)
    return keys[np.minimum(np.searchsorted(keys, some), len(keys) - 1)] == some


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions that symbols generate: their table, their products, and the symbols' own.

    After the plain symbols come those at the start of a text, which forget the state.
    """
    own = [tuple(row) for row in _STEP.tolist()] + [tuple([int(row[_E])] * 8) for row in _STEP]
    functions = [tuple(range(8))]
    number = {functions[0]: 0}
    for f in functions:
        for g in own:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(functions)
                functions.append(h)
    table = np.array(functions, np.uint8)
    assert len(functions) ** 2 <= 256, "products are looked up by one byte"
    products = np.array([[number[tuple(b[s] for s in a)] for b in functions] for a in functions], np.uint8)
    return table, products, np.array([number[g] for g in own], np.uint8)


_FUNCTIONS, _PRODUCTS, _OF_SYMBOL = _monoid()
_FROM_E = _FUNCTIONS[:, _E].copy()
_FLAT, _COUNT = _PRODUCTS.ravel(), np.uint8(len(_FUNCTIONS))


def _compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _FLAT[a * _COUNT + b]


def _prefix_products(f: np.ndarray) -> np.ndarray:
    """The product of all functions up to and with each."""
    n = len(f)
    if n <= _ROWS:
        out = f.copy()
        for k in range(1, n):
            out[k] = _FLAT[int(out[k - 1]) * int(_COUNT) + int(f[k])]
        return out
    rows = -(-n // _ROWS)
    padded = np.zeros(rows * _ROWS, np.uint8)
    padded[:n] = f
    inner = padded.reshape(rows, _ROWS).T.copy()
    for k in range(1, _ROWS):
        inner[k] = _compose(inner[k - 1], inner[k])
    before = np.zeros(rows, np.uint8)
    before[1:] = _prefix_products(inner[-1])[:-1]
    return _compose(before[None, :], inner).T.ravel()[:n]


def piece_starts(text: bytes, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces start, in UTF-8 texts that lie end to end.

    `offsets` are the starts of the texts and the end of the last; no piece spans two.
    """
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes[points]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    first = first[at]
    # What follows, with white space after the last code point of a text.
    following = np.full(len(kind), _WHITE, np.uint8)
    following[:-1] = np.where(first[1:], _WHITE, kind[1:])
    symbol = np.where(kind < _SPACE, kind, np.uint8(7))
    last = (kind >= _SPACE) & (following < _SPACE)
    symbol[last] = 5 + (kind[last] == _WHITE)
    quotes = np.flatnonzero((points == 39) & (following == _LETTER))
    if len(quotes):
        one = points[quotes + 1]
        more = np.minimum(quotes + 2, len(points) - 1)
        two = np.where(first[more] | (quotes + 2 >= len(points)), 0, points[more])
        symbol[quotes[np.isin(one, [115, 116, 109, 100])]] = 3
        pair = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        symbol[quotes[pair]] = 4
    products = _prefix_products(_OF_SYMBOL[symbol + first * np.uint8(_SYMBOLS)])
    state = np.zeros(len(symbol), np.uint8)
    state[1:] = _FROM_E[products[:-1]]
    state[first] = _E
    return at[_STARTS.ravel()[symbol * np.uint8(8) + state]]


class Vocabulary:
    """Tokens by rank, and the pieces merged so far."""

    def __init__(self, file: bytes):
        self.ranks = _read(file)
        self.tokens = _tokens(self.ranks)
        self.lengths = np.array([len(t) for t in self.tokens], np.int32)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        # Every pair of tokens that make a token, as one number, and the token.
        made = []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    made.append((left << 32 | right, rank))
        made.sort()
        self.pairs = np.array([key for key, _ in made] + [1 << 62], np.int64)
        self.made = np.array([rank for _, rank in made] + [_NONE], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.begin = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Token ids of all pieces end to end, and how many each has.

        Equal pieces, told by a 64-bit hash, are merged once and kept while they fit.
        """
        keys, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_PIECES:
            self._forget()
        missing = ~_contains(self.keys, keys)
        if missing.any():
            self._learn(data, keys[missing], starts[first[missing]], ends[first[missing]])
        place = np.searchsorted(self.keys, keys)[back]
        count = self.count[place]
        total = np.cumsum(count)
        take = np.repeat(self.begin[place] - total + count, count)
        take += np.arange(len(take))
        return self.pool[take], count

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Merge new pieces, those of like length together, and add them to the kept ones."""
        length = ends - starts
        order = np.argsort(length, kind="stable")
        rows, counts, at = [], [], 0
        while at < len(order):
            longest = int(length[order[at]])
            if longest > CACHE_PIECE_BYTES:
                break
            stop = min(at + MERGED_PIECES, int(np.searchsorted(length[order], longest + longest // 8, side="right")))
            some = order[at:stop]
            ids, n = self._merged(data, starts[some], length[some])
            rows.append(ids)
            counts.append(n)
            at = stop
        for i in order[at:]:
            ids = np.array(self._merged_long(data[starts[i] : ends[i]].tobytes()), np.int32)
            rows.append(ids)
            counts.append(np.array([len(ids)]))
        count = np.concatenate(counts)
        begin = len(self.pool) + np.cumsum(count) - count
        keys = np.concatenate([self.keys, keys[order]])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.begin = np.concatenate([self.begin, begin])[order]
        self.count = np.concatenate([self.count, count])[order]
        self.pool = np.concatenate([self.pool, *rows])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.made[at], _NONE)

    def _merged(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray):
        """Pieces of like length, merged side by side: ids end to end, and counts.

        In each round every piece merges its pair of the lowest rank, the leftmost of equal
        ones, until no piece has such a pair.
        """
        width = int(length.max())
        column = np.arange(width)
        inside = column < length[:, None]
        raw = data[np.minimum(starts[:, None] + column, len(data) - 1)]
        ids = np.where(inside, self.single[raw], 0)
        left = np.minimum(length, width)
        rank = np.full((len(ids), width), _NONE)
        if width > 1:
            rank[:, :-1] = np.where(inside[:, 1:], self._rank(ids[:, :-1], ids[:, 1:]), _NONE)
        live = np.arange(len(ids))
        while len(live):
            now = rank[live]
            at = now.argmin(1)
            least = now[np.arange(len(live)), at]
            open_ = least < _NONE
            live, at, least, now = live[open_], at[open_], least[open_], now[open_]
            if not len(live):
                break
            row = np.arange(len(live))
            moved = np.minimum(column + (column > at[:, None]), width - 1)
            these = np.take_along_axis(ids[live], moved, 1)
            these[row, at] = least
            # The rank of a pair stands at its left part: that of the right part moves up.
            now = np.take_along_axis(now, moved, 1)
            now[:, -1] = _NONE
            left[live] -= 1
            after = np.minimum(at + 1, width - 1)
            has = at + 1 < left[live]
            now[row, at] = np.where(has, self._rank(these[row, at], these[row, after]), _NONE)
            prior = np.maximum(at - 1, 0)
            fresh_rank = self._rank(these[row, prior], these[row, at])
            now[row, prior] = np.where(at > 0, fresh_rank, now[row, prior])
            ids[live], rank[live] = these, now
        return ids[column < left[:, None]].astype(np.int32), left

    def _merged_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap, for long pieces, on which rounds would be quadratic."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                rank = ranks.get(piece[i : end[stop]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (k := before[i]) >= 0:
                rank = ranks.get(piece[k:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)


def _read(file: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in file.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _vocabulary(file: bytes) -> Vocabulary:
    """The worker's vocabulary; one at a time is kept, with its cache."""
    kept, key = worker_tables("bpe"), hash(file)
    if key not in kept:
        kept.clear()
        kept[key] = Vocabulary(file)
    return kept[key]


def _with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in new]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(new.values()), names + list(new))


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(
    docs: DataFrame, ranks: bytes, text: str = "text", offsets: bool = True, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """`docs` with `token_ids` (array of int) and, if wanted, `token_offsets`.

    `ranks` is the content of a rank file, a fixed table that is sent to the workers.
    An offset is the byte of the UTF-8 text at which a token starts. Whole texts are
    encoded, special tokens are ordinary text, a null or empty text has no tokens, rows
    that repeat are encoded alike, and input columns named like the two are replaced. Smaller
    chunks take less of a worker's memory and more of its time.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks, code_point_classes().tobytes()))
    docs = docs.drop("token_ids", "token_offsets")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema += ", token_ids array<int>" + (", token_offsets array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, classes = shared.value
        vocabulary = _vocabulary(file)
        classes = np.frombuffer(classes, np.uint8)
        for batch in batches:
            raw, starts = text_buffer(batch.column(text))
            if not len(starts) - 1:
                continue
            for first, last in chunks(starts, chunk_bytes):
                data = raw[starts[first] : starts[last]]
                rows = starts[first : last + 1] - starts[first]
                cuts = piece_starts(data.tobytes(), rows, classes)
                stops = np.append(cuts[1:], len(data)) if len(cuts) else cuts
                ids, counts = vocabulary.encode_pieces(data, cuts, stops)
                before = np.concatenate([[0], np.cumsum(counts)])
                row_ends = before[np.searchsorted(cuts, rows)].astype(np.int32)
                part = batch.slice(first, last - first)
                new = {"token_ids": pa.ListArray.from_arrays(row_ends, ids)}
                if offsets:
                    length = vocabulary.lengths[ids]
                    place = np.cumsum(length) - length
                    row = np.repeat(np.arange(last - first), np.diff(row_ends))
                    place = (place - rows[row]).astype(np.int32)
                    new["token_offsets"] = pa.ListArray.from_arrays(row_ends, place)
                yield _with_columns(part, new)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: bytes, ids: str = "token_ids") -> DataFrame:
    """`encoded` with `decoded`, the bytes of its tokens end to end; null ids give none.

    An id outside the vocabulary is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    encoded = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Decoding needs the tokens alone, not the pairs.
        tokens = _tokens(_read(shared.value))
        for batch in batches:
            out = []
            for row in range(len(batch)):
                values = batch.column(ids).slice(row, 1).flatten().tolist()
                out.append(b"".join([tokens[i] for i in values]))
                if len(out) == 256 or row == len(batch) - 1:
                    part = batch.slice(row + 1 - len(out), len(out))
                    yield _with_columns(part, {"decoded": pa.array(out, pa.binary())})
                    out = []

    return encoded.mapInArrow(run, schema + ", decoded binary")
