"""Library tokenizers over batches of texts, asked once for each distinct chunk.

Texts are cut into chunks where a tokenizer's tokens end whatever stands on both sides, as
far as the two bytes beside the cut tell; tokens of a chunk then do not depend on what is
around it. The distinct chunks of a batch are found by a 64-bit hash, and the library
encodes those that this worker has not met yet. A vocabulary for which the cuts are not
safe is asked for whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

from txloom.llm.common import span_hashes, worker_tables

#: Chunks that a worker keeps, and bytes of what is kept for them, before it starts anew.
KEPT_CHUNKS = 400_000
KEPT_BYTES = 32 << 20

_LETTER, _DIGIT, _SIGN, _QUOTE, _SPACE, _WHITE, _UNKNOWN = range(7)
_KIND = np.full(256, _UNKNOWN)
_KIND[0x21:0x7F] = _SIGN
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x27], _KIND[0x20] = _QUOTE, _SPACE
_KIND[0x09:0x0E] = _WHITE
# Last bytes of characters beyond ASCII that are surely no white space (which is U+0085,
# U+00A0, U+1680, U+2000 to U+205F and U+3000) and not U+2581, a space for some models.
_NO_SPACE = np.zeros(256, bool)
_NO_SPACE[0x21:0x7F] = True
_NO_SPACE[0x8B:0xC0] = True
_NO_SPACE[[0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


def _cut_table(pairs: Iterable[tuple[int, int]]) -> np.ndarray:
    """For every two bytes whether texts are cut between them, by their kinds."""
    kinds = np.zeros((7, 7), bool)
    kinds[tuple(np.array(list(pairs)).T)] = True
    return kinds[_KIND[:, None], _KIND[None, :]]


#: A space after anything else is a cut for models of pieces with a space at their front.
SPACE_CUTS = np.zeros((256, 256), bool)
SPACE_CUTS[:, 0x20] = _NO_SPACE
#: The usual pattern of byte-level tokenizers also ends pieces between letters, digits and
#: signs, and before any white space.
PATTERN_CUTS = SPACE_CUTS | _cut_table(
    [(a, b) for a in (_LETTER, _DIGIT) for b in (_LETTER, _DIGIT, _SIGN, _QUOTE) if a != b]
    + [(_SIGN, _LETTER), (_SIGN, _DIGIT)]
)
PATTERN_CUTS[:, 0x09:0x0E] = _NO_SPACE[:, None]


def chunk_starts(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where chunks start in texts that lie end to end; `offsets` are their n + 1 bounds."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        cut[1:-1] = cuts.ravel()[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]]
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, … of every run, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids end to end, and how many each has."""
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(count.sum())), count


class Column:
    """Runs of values, one for each chunk known, end to end."""

    def __init__(self, values: np.ndarray, count: np.ndarray):
        self.values, self.count = values, count
        self.begin = np.cumsum(count) - count

    def grown(self, values: np.ndarray, count: np.ndarray) -> Column:
        return Column(np.concatenate([self.values, values]), np.concatenate([self.count, count]))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[numbers]
        return self.values[ragged(self.begin[numbers], count)], count


class Chunks:
    """What `learn` said of the distinct chunks met so far, as columns of runs.

    `learn` takes the chunks' bytes and gives (values, counts) per column.
    """

    def __init__(self, learn: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]], kept: int = KEPT_CHUNKS):
        self.learn, self.kept = learn, kept
        self._forget()

    def _forget(self) -> None:
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.columns: list[Column] = []

    def numbers(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The place in the columns of each chunk of `data`; good until the next call."""
        ends = np.append(starts[1:], len(data))
        hashes = span_hashes(data, starts, ends)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.kept or sum(c.values.nbytes for c in self.columns) > KEPT_BYTES:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        if not known.all():
            new = first[~known]
            found = self.learn([data[s:e].tobytes() for s, e in zip(starts[new], ends[new])])
            if self.columns:
                self.columns = [c.grown(*f) for c, f in zip(self.columns, found)]
            else:
                self.columns = [Column(*f) for f in found]
            # Both lists are sorted; the new keys are put between the old ones.
            place = np.arange(len(self.keys), len(self.keys) + len(new))
            self.keys = np.insert(self.keys, at[~known], keys[~known])
            self.number = np.insert(self.number, at[~known], place)
        return self.number[np.searchsorted(self.keys, keys)][back]


# One piece for the usual pattern, and the character that stands for the byte of a space.
_ONE_PIECE = re.compile(rb" ?[A-Za-z]+")
_SPACE_CHARACTER = chr(256 + 32)


class ByteLevel:
    """A byte-level BPE tokenizer of the tokenizers library; special tokens are plain text."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.decode("utf-8"))
        self.tokenizer.encode_special_tokens = True
        before = json.loads(file).get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True)
        plain = plain and not before.get("add_prefix_space") and self.tokenizer.normalizer is None
        self.cuts = PATTERN_CUTS if plain else None
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of each text; the library's model is asked at once for what is one piece."""
        encode, model = self.tokenizer.encode, self.tokenizer.model.tokenize
        out = []
        for text in texts:
            if self.cuts is not None and _ONE_PIECE.fullmatch(text):
                out.append([token.id for token in model(text.decode().replace(" ", _SPACE_CHARACTER))])
            else:
                out.append(encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        return out

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id: characters stand for bytes, and added tokens for themselves."""
        # Bytes that stand for themselves; the others follow from 256 on.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(own)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
        out = [b""] * self.size
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            known = all(c in byte for c in token)
            out[number] = bytes(byte[c] for c in token) if known else token.encode("utf-8")
        return out


class Pieces:
    """A sentencepiece model, which puts a space before the text itself."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.size = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.space = self.model.piece_to_id("▁")
        safe = self.space != self.model.unk_id() and not any(re.search("[^▁]▁", piece) for piece in self.pieces)
        self.cuts = SPACE_CUTS if safe else None

    def encode_spaced(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of texts that begin with a space: the one that the model itself puts there."""
        found = self.model.encode([t[1:].decode("utf-8", "replace") for t in texts], num_threads=1)
        return [ids or [self.space] for ids in found]

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id: U+2581 is a space, and <0xHH> the byte HH."""
        out = []
        for number, piece in enumerate(self.pieces):
            if self.model.is_byte(number):
                out.append(bytes([int(piece[3:5], 16)]))
            else:
                out.append(piece.replace("▁", " ").encode("utf-8"))
        return out


def worker_copy(kind: str, files: tuple[bytes, ...], make: Callable[[], object]) -> object:
    """What `make` makes, kept by this Python worker for the same kind and files."""
    kept, key = worker_tables(kind), hashlib.sha256(b"\0".join(files)).digest()
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


class Encoder:
    """Token ids of batches of texts."""

    def __init__(self, tokenizer: ByteLevel):
        self.tokenizer = tokenizer
        self.chunks = Chunks(self._learn)

    def _learn(self, chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        ids, count = flat(self.tokenizer.encode(chunks))
        return [(ids.astype(np.uint32), count)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts = text_chunks(data, offsets, self.tokenizer.cuts)
        numbers = self.chunks.numbers(data, starts)
        ids, count = self.chunks.columns[0].take(numbers)
        before = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(before[np.searchsorted(starts, offsets)])


def text_chunks(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None) -> np.ndarray:
    """`chunk_starts`, or where whole texts start if there are no safe cuts."""
    if cuts is None:
        return offsets[:-1][np.diff(offsets) > 0]
    return chunk_starts(data, offsets, cuts)
