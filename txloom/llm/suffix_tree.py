"""Language-model scoring with a probabilistic suffix tree over words.

The root is the smoothed distribution of single tokens. A context (one or more preceding
tokens of the text, or its start) becomes a state if the distribution that follows it
diverges from that of its longest shorter state by more than the corpus's description
length allows; it and its transitions need to occur `least_count` times, a number that is
the same at every size. Next-symbol distributions interpolate with the shorter state's, so
each is a proper distribution. A token is scored by the longest suffix state of what
precedes it.

Counts of tokens and of runs of tokens are exact over the whole training corpus, and the
tree is a distributed table of them. What a run adds to a score is one number for each time
it occurs, so a score is a sum over the text's runs. Tokens and transitions with a share of
at least `least_share` are summed where the text is: at most 1 / least_share a level, the
proven size of what the workers get. All others come by a join of the (document, run) pairs,
counted per document, with the table; a bitmap of at most MAP_BITS bits keeps back runs that
the tree does not have. Both change the speed and never the result. Texts themselves are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.llm.common import LOWER_BYTES, chunks, discard, fresh, mix, saved, span_hashes, text_buffer, word_spans

# Everything but space and the ASCII controls 9 to 13.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[32, 9, 10, 11, 12, 13]] = False
#: The hash that stands for the end of a text, and for its start as a context.
END = np.uint64(0x9D39247E33776D41)
#: Most bits of a bitmap of runs, and the bits of one piece of it.
MAP_BITS = 1 << 28
PIECE_BITS = 1 << 18


@dataclass(frozen=True)
class Settings:
    """depth: longest context. least_count: what contexts and transitions need to occur.
    least_share: share of all tokens from which on tokens and transitions are sent to the
    workers; rarer ones are joined. divergence: a state's log-likelihood gain, in nats, per
    transition kept, relative to half the logarithm of the corpus length."""

    depth: int = 2
    least_share: float = 5e-7
    least_count: int = 3
    divergence: float = 1.0


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """Token hashes of texts end to end, an END after each, and each text's first token."""
    low = LOWER_BYTES[data]
    starts, ends, first = word_spans(low, offsets, WORD_BYTE)
    out = np.full(len(starts) + len(first) - 1, END)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out[np.arange(len(starts)) + row] = span_hashes(low, starts, ends)
    return out, first + np.arange(len(first))


def _parts(column: pa.Array):
    data, offsets = text_buffer(column)
    for first, last in chunks(offsets):
        part = data[offsets[first] : offsets[last]]
        yield first, last, *_tokens(part, offsets[first : last + 1] - offsets[first])


def _runs(tokens: np.ndarray, first: np.ndarray, depth: int):
    """For each level, of the run that ends at each token: the hashes of its context, of its
    suffix (the run without its first token) and of itself, and whether it is within the text."""
    start = np.zeros(len(tokens), bool)
    start[first[:-1]] = True
    whole = np.ones(len(tokens), bool)
    key = tokens
    for k in range(depth):
        suffix, context = key, np.empty_like(key)
        context[1:] = suffix[:-1]
        if k:
            whole = whole & ~start & np.append(False, whole[:-1])
            context[:1] = 0
        else:
            context[start] = END
        key = mix(mix(context * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)) + suffix)
        yield context, suffix, key, whole


class _Counter:
    """Counts of keys, with columns that follow from the key; merged now and then so that
    memory follows distinct keys."""

    LIMIT = 2_000_000

    def __init__(self) -> None:
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, *others: np.ndarray) -> None:
        keys, at, counts = np.unique(keys, return_index=True, return_counts=True)
        self.parts.append((keys, *(x[at] for x in others), counts))
        self.size += len(keys)
        if self.size > self.LIMIT:
            self._merge()

    def _merge(self) -> None:
        if not self.parts:
            return
        keys, *others, counts = (np.concatenate(x) for x in zip(*self.parts))
        keys, at, back = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(back, counts, len(keys)).astype(np.int64)
        self.parts, self.size = [(keys, *(x[at] for x in others), counts)], len(keys)

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        self._merge()
        for first in range(0, self.size, 50_000):
            part = [x[first : first + 50_000].view(np.int64) for x in self.parts[0]]
            # The key itself moves only if it is named.
            part = part[-len(names) :]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], names)
        self.parts, self.size = [], 0


def _counted(docs: DataFrame, text: str, keys_of, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Counts (`by`, n) of what `keys_of(tokens, first)` gives for each chunk of texts: the
    keys, and if `by` are other columns, these."""
    names = [*by, "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            for _, _, tokens, first in _parts(batch.column(0)):
                counter.add(*keys_of(tokens, first))
                if counter.size > counter.LIMIT // 2:
                    yield from counter.batches(names)
        yield from counter.batches(names)

    schema = ", ".join(f"{name} long" for name in names)
    return docs.select(text).mapInArrow(run, schema).groupBy(*by).agg(F.sum("n").alias("n"))


def _bitmap(keys: DataFrame, rows: int) -> np.ndarray:
    """A bitmap of the low bits of the column `key`, about 16 bits for each of `rows` keys, but
    MAP_BITS at most."""
    bits = min(MAP_BITS, max(PIECE_BITS, 1 << int(16 * rows).bit_length()))
    place = F.col("key").bitwiseAND(bits - 1)
    dealt = keys.select(place.alias("place"), F.floor(place / PIECE_BITS).alias("piece")).repartition("piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            place, piece = (batch.column(k).to_numpy() for k in (0, 1))
            for k in np.unique(piece).tolist():
                full = pieces.setdefault(k, np.zeros(PIECE_BITS, bool))
                full[place[piece == k] - k * PIECE_BITS] = True
        for k, full in pieces.items():
            packed = pa.array([np.packbits(full, bitorder="little").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), packed], ["piece", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    # MAP_BITS / PIECE_BITS rows, MAP_BITS / 8 bytes at most.
    for piece, packed in dealt.mapInArrow(run, "piece long, bits binary").collect():
        out[piece * PIECE_BITS // 8 : (piece + 1) * PIECE_BITS // 8] = np.frombuffer(packed, np.uint8)
    return out


def _wanted(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1) == 1


@dataclass
class Level:
    """Frequent contexts of one length, judged by all their transitions.

    `keys` are transitions, (context number, token number) in one integer, sorted; a
    transition's place is the number of the next level's context. `gain` is its log10
    probability less the root's; `back` is, per context, the log10 weight of the shorter state
    (0 where the context is no state); `state` says which are.
    """

    keys: np.ndarray
    gain: np.ndarray
    back: np.ndarray
    state: np.ndarray


@dataclass
class Model:
    """What workers get: frequent tokens with their counts, the levels of frequent
    transitions, and a bitmap of the others that add to a score."""

    tokens: np.ndarray
    counts: np.ndarray
    levels: list[Level]
    total: int
    distinct: int
    others: np.ndarray | None = None

    def root(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def _numbers(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key, -1 if it is not there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _at(values: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The value of each number, 0 for -1."""
    return np.where(numbers >= 0, values[np.maximum(numbers, 0)], 0.0) if len(values) else np.zeros(len(numbers))


def _contexts(numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Token number before each token; before a text's first token, that of END."""
    out = np.empty_like(numbers)
    out[1:] = numbers[:-1]
    # The token before a text's first one is the END of the text before.
    out[0] = numbers[first[1] - 1]
    return out


def _joined(context: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    known = (context >= 0) & (numbers >= 0)
    return np.where(known, context << 32 | np.maximum(numbers, 0), -1)


def _walk(model: Model, tokens: np.ndarray, first: np.ndarray):
    """For each level, the context number before each token and the transition's (-1: none)."""
    numbers = _numbers(model.tokens, tokens)
    context = _contexts(numbers, first)
    start = np.zeros(len(tokens), bool)
    start[first[:-1]] = True
    for level in model.levels:
        taken = _numbers(level.keys, _joined(context, numbers))
        yield context, taken
        # A longer context is this transition, seen from the next token; it does not reach
        # into the text before.
        following = np.full(len(tokens), -1)
        following[1:] = taken[:-1]
        following[start] = -1
        context = following


def _judged(level: DataFrame, shorter: DataFrame, total: int, settings: Settings) -> tuple[DataFrame, ...]:
    """Of transitions (context, suffix, n): what they are scored by, the states, and the saved
    table that the first is computed from.

    `shorter` has (key, n, logp) of the runs one shorter. The first result has `logp`, the log10
    probability by the longest state, and `adds`, what the run adds to a score that its
    suffix and its context's `back` have made. The second has (context, occurs, back).
    """
    kinds = level.groupBy("context").agg(F.sum("n").alias("kept"), F.count("*").alias("kinds"))
    about = kinds.join(shorter.select(F.col("key").alias("context"), F.col("n").alias("occurs")), "context")
    # What is not kept, and one count for each kept kind, goes to the shorter state.
    left = F.greatest(F.col("occurs") - F.col("kept"), F.lit(0))
    about = about.withColumn("left", left).withColumn("rest", F.col("left") + F.col("kinds") + 1)
    about = about.withColumn("share", F.col("kept") + F.col("rest"))
    own = F.log10((F.col("n") + F.col("rest") * F.pow(F.lit(10.0), F.col("shorter"))) / F.col("share"))
    suffixes = shorter.select(F.col("key").alias("suffix"), F.col("logp").alias("shorter"))
    with_own = saved(
        level.join(suffixes, "suffix").join(about.select("context", "rest", "share"), "context")
        .withColumn("own", own).drop("rest", "share"),
        "transitions",
    )
    gained = with_own.groupBy("context").agg(F.sum(F.col("n") * (F.col("own") - F.col("shorter"))).alias("gained"))
    # Log-likelihood that the state adds over its shorter one, against its description.
    back = F.log10(F.col("rest") / F.col("share"))
    price = settings.divergence * 0.5 * float(np.log10(max(total, 2)))
    states = about.join(gained, "context").withColumn("back", back)
    states = states.where(F.col("gained") + F.col("left") * F.col("back") > F.col("kinds") * price)
    states = saved(states.select("context", "occurs", "back"), "states")
    found = with_own.join(states.select("context", "back"), "context", "left")
    logp = F.when(F.col("back").isNotNull(), F.col("own")).otherwise(F.col("shorter"))
    adds = F.coalesce(F.col("own") - F.col("shorter") - F.col("back"), F.lit(0.0))
    return found.select("context", "suffix", "n", logp.alias("logp"), adds.alias("adds")), states, with_own


def _keyed(transitions: DataFrame) -> DataFrame:
    """(context, suffix, n, logp, adds) with the hash `key` of the whole run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, suffix = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            key = mix(mix(context * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)) + suffix)
            columns = [*batch.columns, pa.array(key.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "key"])

    return transitions.mapInArrow(run, "context long, suffix long, n long, logp double, adds double, key long")


def train(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """The model of whole texts, and a table (key, n, adds): the exact counts of all tokens, and
    what tokens and runs outside the model's levels add to a score (n is null for runs).

    One pass per level, and one before to find the pairs that occur often enough. Null and
    empty texts are a single END. Without texts every token has the root's probability of an
    unknown one.
    """
    s = settings
    vocabulary = saved(_counted(docs, text, lambda tokens, first: (tokens,)), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = max(s.least_count, int(np.ceil(total * s.least_share)))
    # At most 1 / least_share rows.
    frequent = vocabulary.where((F.col("n") >= hot) | (F.col("key") == int(END.view(np.int64))))
    rows = frequent.toArrow()
    keys, counts = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    if not len(keys):
        # Without training texts; END is a context all the same.
        keys, counts = np.array([END]), np.zeros(1, np.int64)
    order = np.argsort(keys)
    model = Model(keys[order], counts[order], [], int(total), int(distinct))
    spark = docs.sparkSession
    root = F.log10((F.col("n") + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    often = F.col("n") >= s.least_count
    shorter = vocabulary.where(often).select("key", "n", root.alias("logp"))
    # A token is a context as often as it occurs: END stands before each text's first token.
    runs_of = lambda tokens, first: [x[2] for x in _runs(tokens, first, 1)]
    seen = saved(_counted(docs, text, runs_of).where(often).select("key"), "pairs") if s.depth else None
    known, parts, dead = seen, [], [vocabulary]
    # Of the level before: hashes of its transitions, in the order of their numbers, and tokens.
    hashes, tokens_of = model.tokens, np.arange(len(model.tokens))
    for depth in range(1, s.depth + 1):
        shared = spark.sparkContext.broadcast(_bitmap(known, known.count()))
        if depth == 1:
            discard(seen)

        def keys_of(tokens, first, shared=shared, depth=depth):
            *_, (context, suffix, key, whole) = _runs(tokens, first, depth)
            bitmap = shared.value
            if depth == 1:
                taken = _wanted(bitmap, key)
            else:
                taken = whole & _wanted(bitmap, context) & _wanted(bitmap, suffix)
            return key[taken], context[taken], suffix[taken]

        level = saved(_counted(docs, text, keys_of, ("context", "suffix")).where(often), "level")
        judged, states, transitions = _judged(level, shorter, total, s)
        judged = saved(_keyed(judged), "judged")
        shared.unpersist()
        discard(level, transitions)
        dead += [judged, states]
        # At most 1 / least_share rows each.
        found = judged.where(F.col("n") >= hot).select("context", "suffix", "key", "logp").toArrow()
        backs = states.where((F.col("occurs") >= hot) | (F.col("context") == int(END.view(np.int64)))).toArrow()
        context, suffix, key = (found.column(k).to_numpy().view(np.uint64) for k in ("context", "suffix", "key"))
        order = np.argsort(hashes)
        number = lambda x: order[_numbers(hashes[order], x)]  # noqa: B023, E731
        token = tokens_of[number(suffix)]
        back, state = np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        at = number(backs.column("context").to_numpy().view(np.uint64))
        back[at], state[at] = backs.column("back").to_numpy(), True
        packed = number(context).astype(np.int64) << 32 | token
        place = np.argsort(packed)
        gain = found.column("logp").to_numpy() - model.root(model.counts[token])
        model.levels.append(Level(packed[place], gain[place], back, state))
        hashes, tokens_of = key[place], token[place]
        # What the workers do not have: rare transitions, and the rare contexts' states.
        parts.append(judged.where((F.col("n") < hot) & (F.col("adds") != 0)).select("key", "adds"))
        rare_states = states.where((F.col("occurs") < hot) & (F.col("context") != int(END.view(np.int64))))
        parts.append(rare_states.select(F.col("context").alias("key"), F.col("back").alias("adds")))
        known, shorter = judged.select("key"), judged.select("key", "n", "logp")
    table = vocabulary.withColumn("adds", F.lit(0.0))
    for part in parts:
        table = table.unionByName(part.select("key", F.lit(None).cast("long").alias("n"), "adds"))
    table = saved(table.groupBy("key").agg(F.sum("n").alias("n"), F.sum("adds").alias("adds")), "tree")
    discard(*dead)
    runs = table.where(F.col("n").isNull()).select("key")
    model.others = _bitmap(runs, runs.count())
    return model, table


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` of `docs` (all columns, if not said) with `n_tokens`, `n_known`, `base_score` and
    `score`: the log10 probabilities of whole texts by the root alone and by the tree.

    Null and empty texts are scored as their END. Repeated rows are scored alike; input
    columns with the names of the added ones are replaced.
    """
    added = ["n_tokens", "n_known", "base_score", "score"]
    docs = docs.drop(*added)
    kept = keep or docs.columns
    key = fresh(docs, "_row")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.withColumn(key, F.monotonically_increasing_id())
    frequent, base_sum, gain_sum, rare_list = (fresh(rows, c) for c in ("_frequent", "_base", "_gain", "_rare"))
    row_no, rare_base, rare_known, rare_gain = (
        fresh(rows, c) for c in ("_row_no", "_rare_base", "_rare_known", "_rare_gain")
    )
    names = [*kept, key]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            for begin, end, tokens, first in _parts(batch.column(text)):
                numbers = _numbers(tree.tokens, tokens)
                known = numbers >= 0
                counts = np.where(known, tree.counts[np.maximum(numbers, 0)], 0)
                base = np.where(known, tree.root(counts), 0.0)
                gain = np.zeros(len(tokens))
                for level, (context, taken) in zip(tree.levels, _walk(tree, tokens, first)):
                    gain = np.where(taken >= 0, _at(level.gain, taken), gain + _at(level.back, context))
                row = np.repeat(np.arange(end - begin), np.diff(first))
                rare = ~known
                found_row, found_key, found_run = [row[rare]], [tokens[rare]], [np.zeros(rare.sum(), bool)]
                for (_, taken), (_, _, run_key, whole) in zip(_walk(tree, tokens, first), _runs(tokens, first, len(tree.levels))):
                    rare_run = np.flatnonzero((taken < 0) & whole & _wanted(tree.others, run_key))
                    found_row.append(row[rare_run])
                    found_key.append(run_key[rare_run])
                    found_run.append(np.ones(len(rare_run), bool))
                rare_row, rare_key, is_run = map(np.concatenate, (found_row, found_key, found_run))
                # Each text's rare tokens and runs, repeated ones once with their count.
                order = np.lexsort((rare_key, rare_row))
                rare_row, rare_key, is_run = rare_row[order], rare_key[order], is_run[order]
                new = np.ones(len(order), bool)
                new[1:] = (rare_row[1:] != rare_row[:-1]) | (rare_key[1:] != rare_key[:-1])
                at = np.flatnonzero(new)
                ends = np.searchsorted(rare_row[at], np.arange(end - begin + 1)).astype(np.int32)
                entries = pa.StructArray.from_arrays(
                    [pa.array(rare_key[at].view(np.int64)), pa.array(np.diff(np.append(at, len(order)))), pa.array(is_run[at])],
                    ["key", "times", "is_run"],
                )
                size = end - begin
                part = batch.slice(begin, size)
                columns = [
                    *[part.column(n) for n in names],
                    pa.array(np.diff(first)),
                    pa.array(np.bincount(row, counts > 0, size).astype(np.int64)),
                    pa.array(np.bincount(row, base, size)),
                    pa.array(np.bincount(row, gain, size)),
                    pa.ListArray.from_arrays(ends, entries),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_tokens", frequent, base_sum, gain_sum, rare_list])

    schema = f"{fields}, n_tokens long, {frequent} long, {base_sum} double, {gain_sum} double, {rare_list} array<struct<key:long, times:long, is_run:boolean>>"
    passed = saved(rows.mapInArrow(run, schema), "scored")
    # Rare tokens and runs only: what is left of the corpus after the frequent ones.
    rare = passed.select(key, F.explode(rare_list).alias("r")).select(F.col(key).alias(row_no), "r.*")
    root = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(model.total + 0.5 * (model.distinct + 1)))
    token = ~F.col("is_run")
    seen = rare.join(vocabulary, "key", "left").groupBy(row_no).agg(
        F.sum(F.when(token, F.col("times") * root).otherwise(0.0)).alias(rare_base),
        F.sum(F.when(token & (F.col("n") > 0), F.col("times")).otherwise(0)).alias(rare_known),
        F.sum(F.col("times") * F.coalesce("adds", F.lit(0.0))).alias(rare_gain),
    )
    out = passed.drop(rare_list).join(seen, F.col(key) == F.col(row_no), "left")
    base = F.col(base_sum) + F.coalesce(rare_base, F.lit(0.0))
    return out.select(
        *kept,
        "n_tokens",
        (F.col(frequent) + F.coalesce(rare_known, F.lit(0))).alias("n_known"),
        base.alias("base_score"),
        (base + F.col(gain_sum) + F.coalesce(rare_gain, F.lit(0.0))).alias("score"),
    )
