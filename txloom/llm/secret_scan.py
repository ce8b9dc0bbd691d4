"""Secret scan that links the parts of a credential.

Strong patterns (an assignment to a secret's name, an access key, a long hex string) are
reported wherever they stand. Weak candidates, such as a user name, a host or a random
string, are reported only where parts that complete each other stand within one scope:
an identifier with a secret, a secret with an identifier, an endpoint with both.

A scope lies within one text, so the interval join is two running extremes over the sorted
parts of a row: the furthest end of each role so far and the least start still to come. A
text of n parts takes about n log n steps. Nothing is shuffled, a text never meets another, and
frequent or repeated texts cost what their rows cost. Everything is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txloom.llm.common import fresh

# Names of secrets, and the three strong patterns.
_NAMES = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = rf"""((?i:{"|".join(_NAMES)}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
# A run of these characters is one match, so the least length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

# Weak parts; each begins where no word goes on.
_START = "(?<![A-Za-z0-9_])"
_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
IDENTIFIER = rf"""{_START}(?i:user(?:_?name)?|login|client_?id|access_?key_?id|account_?id){_VALUE}[A-Za-z0-9._@-]{{3,}}"""
SECRET = r"(?<![A-Za-z0-9+_-])(?=[A-Za-z+_-]*[0-9])(?=[0-9+_-]*[A-Za-z])[A-Za-z0-9+_-]{16,}"
ENDPOINT = rf"""{_START}(?i:host(?:name)?|endpoint|server|base_?url){_VALUE}[A-Za-z0-9][A-Za-z0-9.:/-]{{3,}}"""

#: Kinds in the order in which spans of one start are listed.
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
_ROLE = {"assign": "s", "access": "i", "hex": "s", "identifier": "i", "secret": "s", "endpoint": "e"}
#: Most code points between two parts of one credential.
SCOPE = 200
# Code points of a block that texts are cut from.
BLOCK = 1024

_SPAN = "struct<start:int,kind:int,end:int>"
_FAR = 1 << 30


def _scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What `join`, an associative function, makes of each value and all before it.

    Values are joined with the ones 1, 2, 4, … places before, so n of them take log2(n)
    passes and no array grows by one element at a time.
    """
    steps = F.array(*[F.lit(1 << k) for k in range(31)])

    def step(acc: Column, d: Column) -> Column:
        joined = F.transform(acc, lambda v, i: F.when(i >= d, join(v, F.get(acc, i - d))).otherwise(v))
        return F.when(d < F.size(acc), joined).otherwise(acc)

    return F.aggregate(steps, values, step)


def _spans(text: Column, pattern: str, kind: int, value_least: int = 0) -> Column:
    """Spans of the leftmost matches of `pattern`, in code points.

    Texts between matches and the matches give the positions. With `value_least`, matches
    whose second group is shorter are left out (after they have used up their text).
    """
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(found, F.length)
    skips = F.slice(F.transform(pieces, F.length), F.lit(1), F.size(found))
    ends = _scan(F.zip_with(skips, lengths, lambda skip, length: skip + length), lambda a, b: a + b)
    spans = F.zip_with(
        ends,
        lengths,
        lambda end, length: F.struct((end - length).alias("start"), F.lit(kind).alias("kind"), end.alias("end")),
    )
    if value_least:
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        # A match that is left out becomes null for a moment.
        spans = F.zip_with(spans, value, lambda span, v: F.when(F.length(v) >= value_least, span))
        spans = F.filter(spans, lambda span: span.isNotNull())
    empty = F.expr(f"cast(array() as array<{_SPAN}>)")
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _apart(spans: Column, kinds: list[int]) -> Column:
    """For each of `spans`, sorted by start, the distance to the nearest other span of `kinds`.

    Below 0 they overlap. The furthest end before a span and the least start after it tell
    all; of two spans with one start the first in order counts as before. With none, far away.
    """

    def of(name: str, other: int) -> Column:
        return F.transform(spans, lambda s: F.when(s["kind"].isin(kinds), s[name]).otherwise(F.lit(other)))

    ends = _scan(of("end", -_FAR), F.greatest)
    starts = F.reverse(_scan(F.reverse(of("start", _FAR)), F.least))
    around = F.arrays_zip(
        spans.alias("span"),
        F.concat(F.array(F.lit(-_FAR)), ends).alias("before"),
        F.concat(F.slice(starts, 2, _FAR), F.array(F.lit(_FAR))).alias("after"),
    )
    around = F.slice(around, F.lit(1), F.size(spans))
    return F.transform(
        around, lambda r: F.least(r["span"]["start"] - r["before"], r["after"] - r["span"]["end"])
    )


_STRONG = [0, 1, 2]
_WEAK = {name: KINDS.index(name) for name in ("identifier", "secret", "endpoint")}


def _outside(spans: Column) -> Column:
    """`spans`, sorted by start, without the weak secrets that overlap a strong one."""
    rows = F.arrays_zip(spans.alias("span"), _apart(spans, _STRONG).alias("gap"))
    rows = F.filter(rows, lambda r: (r["span"]["kind"] != _WEAK["secret"]) | (r["gap"] >= 0))
    return F.transform(rows, lambda r: r["span"])


def _linked(spans: Column, scope: int) -> Column:
    """Strong parts, and the weak ones that complete another within the scope."""
    near = {
        role: _apart(spans, [k for k, name in enumerate(KINDS) if _ROLE[name] == role]) for role in "is"
    }
    rows = F.arrays_zip(spans.alias("span"), *[near[role].alias(role) for role in "is"])

    def keep(row: Column) -> Column:
        kind = row["span"]["kind"]
        close = {role: row[role] <= scope for role in "is"}
        return (
            (kind < _WEAK["identifier"])
            | ((kind == _WEAK["identifier"]) & close["s"])
            | ((kind == _WEAK["secret"]) & close["i"])
            | ((kind == _WEAK["endpoint"]) & close["i"] & close["s"])
        )

    return F.transform(F.filter(rows, keep), lambda row: row["span"])


def find_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """`docs` with `secrets`: array of (start, kind, end) by start, then kind.

    `kind` is an index into KINDS; positions are code points, `end` exclusive. A weak
    secret inside a strong span is left out. Whole texts are searched; a null or empty
    text has an empty array, repeated rows are searched alike, and a column of the input
    called `secrets` is replaced.
    """
    docs = docs.drop("secrets") if text.lower() != "secrets" else docs
    body = F.coalesce(F.col(text), F.lit(""))
    strong, weak = fresh(docs, "_strong"), fresh(docs, "_weak")
    base = F.concat(
        _spans(body, ASSIGN, 0, ASSIGN_LEAST), _spans(body, ACCESS, 1), _spans(body, HEX, 2)
    )
    out = docs.withColumn(strong, base)
    # A weak part completes a credential only beside another part with a name.
    named = body.rlike(f"{IDENTIFIER}|{ENDPOINT}") | F.exists(strong, lambda s: s["kind"] == 1)
    parts = F.concat(
        _spans(body, IDENTIFIER, 3), _spans(body, SECRET, 4), _spans(body, ENDPOINT, 5)
    )
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    out = out.withColumn(weak, F.when(named, parts).otherwise(none))
    # Steps with a column of their own: an expression used twice is computed twice.
    out = out.withColumn(weak, F.array_sort(F.concat(strong, weak)))
    some = F.exists(weak, lambda s: s["kind"] >= 3)
    out = out.withColumn(weak, F.when(some, _outside(F.col(weak))).otherwise(F.col(weak)))
    return out.withColumn("secrets", F.when(some, _linked(F.col(weak), scope)).otherwise(F.col(weak))).drop(strong, weak)


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.concat_ws(",", one)


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """`docs` with each found span, or run of overlapping spans, of `text` replaced by `mask`."""
    found = find_secrets(docs, text, scope)
    blocks, gaps = fresh(found, "_blocks"), fresh(found, "_gaps")
    body = F.col(text)
    # Blocks of equal length in code points: a cut reads the blocks it touches and no others.
    found = found.withColumn(blocks, F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    gap = "struct<start:int,end:int>"
    ends = F.concat(F.array(F.lit(0)), _scan(F.transform("secrets", lambda s: s["end"]), F.greatest))
    starts = F.concat(F.transform("secrets", lambda s: s["start"]), F.array(F.length(body)))
    found = found.withColumn(gaps, F.arrays_zip(ends.alias("start"), starts.alias("end")).cast(f"array<{gap}>"))

    def cut(gap: Column) -> Column:
        first = F.floor(gap["start"] / BLOCK).cast("int")
        several = F.slice(F.col(blocks), first + 1, F.ceil(gap["end"] / BLOCK).cast("int") - first)
        return F.array_join(several, "").substr(gap["start"] - first * BLOCK + 1, gap["end"] - gap["start"])

    # A span that overlaps an earlier one has no gap of its own, nor a mask; the last gap,
    # to the end of the text, may be empty.
    last = F.size(gaps) - 1
    numbered = F.transform(F.col(gaps), lambda g, i: F.struct(g.alias("gap"), (i == last).alias("last")))
    kept = F.filter(numbered, lambda g: (g["gap"]["end"] >= g["gap"]["start"]) | g["last"])
    cuts = F.transform(kept, lambda g: F.when(g["gap"]["end"] > g["gap"]["start"], cut(g["gap"])).otherwise(F.lit("")))
    clean = F.array_join(cuts, mask)
    return found.withColumn(text, F.when(F.size("secrets") > 0, clean).otherwise(body)).drop("secrets", blocks, gaps)
