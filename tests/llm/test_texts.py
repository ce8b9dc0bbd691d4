"""Operators on single texts against plain Python."""

import base64
import math
import random
import time
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from txloom.llm import bpe, decontaminate, language, minhash, secret_scan, suffix_tree
from txloom.llm.queries import tokenizer_file

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS = bpe.read_ranks(tokenizer_file())


def python_spans(text):
    """Strong spans of a text, with the standard library."""
    out = []
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, pattern in enumerate((assign, "AKIA[A-Z0-9]+", "[0-9a-f]+")):
        for m in re.finditer(pattern, text or "", re.ASCII):
            size = len(m[1]) if kind == 0 else len(m[0])
            if size >= (6, 20, 24)[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_secrets_on_awkward_rows(awkward, nothing):
    rows = secret_scan.find_secrets(awkward).select("text", "secrets", "_row").collect()
    assert len(rows) == awkward.count() and {r["_row"] for r in rows} == {"own"}
    for r in rows:
        assert [tuple(s) for s in r.secrets if s.kind < 3] == python_spans(r.text)
    assert secret_scan.find_secrets(nothing).count() == 0


def test_strong_secrets_like_plain_python(spark):
    rng = random.Random(3)
    bits = ["token=", "token:token:", "api_key = '", "AKIA", "ABCDEFGH12345678", "secret", '"', " ", "=", "deadbeef" * 3, "é", "abc", "😀", "\n", "0123456789abcdef", "Pass", "PASSWD: "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    rows = secret_scan.find_secrets(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in rows:
        assert [tuple(s) for s in r.secrets if s.kind < 3] == python_spans(r.text)


def test_weak_parts_need_their_complement(spark):
    def kinds(text):
        found = secret_scan.find_secrets(spark.createDataFrame([(text,)], "text string")).first()
        return [secret_scan.KINDS[s.kind] for s in found.secrets]

    secret, gap = "Zx81kQ0vLmN7rT2w", "word " * 60
    assert kinds(f"user = alice {secret}") == ["identifier", "secret"]
    assert kinds("user = alice and nothing else") == []
    assert kinds(f"a random {secret} alone") == []
    assert kinds(f"user = alice {gap} {secret}") == []
    assert kinds(f"host: db.example.org user = alice {secret}") == ["endpoint", "identifier", "secret"]
    assert kinds(f"host: db.example.org {secret}") == []
    assert kinds("user = alice password = 'hunter22'") == ["identifier", "assign"]


def plain_links(spans, scope=secret_scan.SCOPE):
    """Which of all spans, strong and weak, are reported, by comparing all of them."""
    strong = [s for s in spans if s[1] < 3]
    spans = sorted(s for s in spans if s[1] != 4 or not any(b[0] < s[2] and s[0] < b[2] for b in strong))
    role = {0: "s", 1: "i", 2: "s", 3: "i", 4: "s", 5: "e"}

    def beside(at, r):
        a = spans[at]
        return any(role[b[1]] == r and max(a[0], b[0]) - min(a[2], b[2]) <= scope for k, b in enumerate(spans) if k != at)

    needs = {0: "", 1: "", 2: "", 3: "s", 4: "i", 5: "is"}
    return [s for k, s in enumerate(spans) if all(beside(k, r) for r in needs[s[1]])]


def test_links_like_all_pairs(spark):
    rng = random.Random(11)
    patterns = {3: secret_scan.IDENTIFIER, 4: secret_scan.SECRET, 5: secret_scan.ENDPOINT}
    bits = ["user = alice ", "host: db.example.org ", "Zx81kQ0vLmN7rT2w ", "token=abc123 ", "password: Zx81kQ0vLmN7rT2w ", "word " * 15, "é😀 ", "AKIA" + "A1" * 8 + " "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(60)]
    rows = secret_scan.find_secrets(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in rows:
        weak = [(m.start(), k, m.end()) for k, p in patterns.items() for m in re.finditer(p, r.text)]
        named = any(k != 4 for _, k, _ in weak) or any(k == 1 for _, k, _ in python_spans(r.text))
        assert [tuple(s) for s in r.secrets] == plain_links(python_spans(r.text) + (weak if named else []))


def test_many_spans_in_one_text(spark):
    """The time follows the number of spans, not its square."""
    n = 100_000
    line = "user = alice token=abcdef12\n"
    df = spark.createDataFrame([(line * n,)], "text string")
    begun = time.monotonic()
    spans = secret_scan.find_secrets(df).first().secrets
    clean = secret_scan.redact(df).first().text
    assert time.monotonic() - begun < 60
    assert len(spans) == 2 * n and tuple(spans[-1]) == ((n - 1) * len(line) + 13, 0, n * len(line) - 1)
    assert clean == "[SECRET] [SECRET]\n" * n


def test_redaction_masks_overlapping_spans_once(spark):
    text = 'é token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'
    clean = secret_scan.redact(spark.createDataFrame([(text,), (None,), ("plain",)], "text string"))
    assert [r.text for r in clean.collect()] == ['é [SECRET]" end', None, "plain"]


def reference_encoding():
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_like_the_library(spark, awkward, nothing):
    rng = random.Random(1)
    letters = "ab stmdrevl''' \n\t\r 12  é漢!?.'\x1c\u1c89٣𝟛😀\u00a0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [t for (t,) in awkward.select("text").collect()] + ["a" * 3000, " " * 999 + "x", "'" * 300 + "s"]
    encoding = reference_encoding()
    encoded = bpe.encode(spark.createDataFrame([(t,) for t in texts], "text string"), RANKS)
    for r in bpe.decode(encoded, RANKS).collect():
        text = r.text or ""
        assert r.token_ids == encoding.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
        pieces = [encoding.decode_single_token_bytes(i) for i in r.token_ids]
        assert all(text.encode()[o : o + len(p)] == p for o, p in zip(r.token_offsets, pieces))
    assert bpe.encode(nothing, RANKS).count() == 0
    assert {r["_row"] for r in bpe.encode(awkward, RANKS).collect()} == {"own"}


def test_tokens_do_not_depend_on_the_kept_pieces(monkeypatch, spark):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    text = " ".join(f"word{i} thing{i % 7}" for i in range(500))
    vocabulary = bpe.Vocabulary(RANKS)
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    cuts = bpe.piece_starts(text.encode(), np.array([0, len(data)]), bpe.code_point_classes())
    for _ in range(2):
        ids, _counts = vocabulary.encode_pieces(data, cuts, np.append(cuts[1:], len(data)))
        assert ids.tolist() == reference_encoding().encode_ordinary(text)


def test_language_accuracy_and_awkward_rows(spark, awkward, nothing):
    rng = random.Random(5)
    syllables = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ein", "keit"], "cc": ["éa", "oui", "que", "ção"]}
    rows = [
        (k, lang, " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(30)))
        for lang, s in syllables.items()
        for k in range(60)
    ]
    df = spark.createDataFrame(rows, "k long, lang string, text string")
    small = language.Settings(train_rows=90, landmarks=30, features=1 << 10)
    model = language.train(df.where("k % 4 <> 2"), "text", "lang", small)
    found = language.predict(df.where("k % 4 = 2"), model).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in found)
    odd = language.predict(awkward, model).select("text", "lang_pred", "score", "_row").collect()
    assert len(odd) == awkward.count()
    for r in odd:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in syllables
    empty = language.train(nothing, "text", "lang", small)
    assert {r.lang_pred for r in language.predict(awkward, empty).collect()} == {"und"}
    assert language.predict(nothing, model).count() == 0


def test_copies_do_not_empty_a_language(spark):
    """A language of few texts in many copies is learned, and so is a table of one text."""
    small = language.Settings(train_rows=20, landmarks=10, features=1 << 10)
    copies = spark.range(20000).selectExpr("'ein einziger Satz ' || (id % 4) as text", "'de' as lang")
    others = spark.range(200).selectExpr("'some quite other words ' || id || chr(97 + id % 26) as text", "'en' as lang")
    model = language.train(copies.union(others), "text", "lang", small)
    assert model.languages == ["de", "en"]
    found = language.predict(copies.union(others), model).where("lang_pred <> lang").count()
    assert found == 0
    for words in ("ein Satz", "un deux trois", "one two", "uno due", "raz dwa trzy"):
        one = spark.range(20000).select(F.lit(words).alias("text"), F.lit("xx").alias("lang"))
        assert language.train(one, "text", "lang", small).languages == ["xx"]


def test_kernel_is_shared_presence():
    import numpy as np

    s = language.Settings(features=1 << 12)
    texts = ["abc", "ab", "xyz", "aBc", "a b"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t) for t in texts])
    bits, letters = language.presence(data, offsets, s)
    assert letters.tolist() == [3, 2, 3, 3, 2]
    # a, b, c, ab, bc, abc; and a, b, ab.
    assert bits.sum(1).tolist()[:2] == [6.0, 3.0]
    assert (bits[0] == bits[3]).all() and bits[0] @ bits[2] == 0 and bits[0] @ bits[1] == 3


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base_scores(train, texts):
    tokens = lambda t: WORDS.findall((t or "").translate(LOW)) + [None]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for t in texts]


def test_suffix_tree_scores(spark, awkward, nothing):
    rng = random.Random(2)
    follow = {"a": "b", "b": "c", "c": "a"}
    texts = []
    for _ in range(300):
        w, out = rng.choice("abc"), []
        for _ in range(20):
            out.append(w)
            w = follow.get(w, "a") if rng.random() < 0.8 else rng.choice("abcdefg" if rng.random() < 0.9 else ["rare%d" % rng.randint(0, 999)])
        texts.append(" ".join(out))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model, vocabulary = suffix_tree.train(df, settings=suffix_tree.Settings(least_share=1e-3))
    assert model.levels[0].state.any()
    for rows in (df.limit(50), awkward):
        scored = suffix_tree.score(rows, model, vocabulary).collect()
        expected = base_scores(texts, [r.text for r in scored])
        for r, (n, known, base) in zip(scored, expected):
            assert (r.n_tokens, r.n_known) == (n, known) and r.base_score == pytest.approx(base)
    better = suffix_tree.score(df, model, vocabulary).agg(F.sum("score"), F.sum("base_score")).first()
    assert better[0] > better[1]
    assert suffix_tree.score(nothing, model, vocabulary).count() == 0
    untaught, none = suffix_tree.train(nothing)
    assert all(r.score == pytest.approx(r.base_score) for r in suffix_tree.score(awkward, untaught, none).collect())


def tree_scores(texts, of, least=3):
    """Scores by a suffix tree of contexts of up to two tokens, built with dictionaries."""
    sequence = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    count, pairs, triples = Counter(), Counter(), Counter()
    for t in texts:
        before, run = None, None
        for w in sequence(t):
            count[w] += 1
            pairs[before, w] += 1
            if run is not None:
                triples[run, w] += 1
            before, run = w, (before, w)
    total = sum(count.values())
    root = lambda w: math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1)))
    price = 0.5 * math.log10(max(total, 2))

    def judged(runs, occurs, shorter):
        logp, back = {}, {}
        by_context = {}
        for (context, w), n in runs.items():
            if n >= least:
                by_context.setdefault(context, {})[w] = n
        for context, following in by_context.items():
            kept, kinds = sum(following.values()), len(following)
            left = max(occurs[context] - kept, 0)
            rest = left + kinds + 1
            own = {w: math.log10((n + rest * 10 ** shorter(context, w)) / (kept + rest)) for w, n in following.items()}
            weight = math.log10(rest / (kept + rest))
            gained = sum(n * (own[w] - shorter(context, w)) for w, n in following.items()) + left * weight
            state = gained > kinds * price
            if state:
                back[context] = weight
            logp |= {(context, w): own[w] if state else shorter(context, w) for w in following}
        return logp, back

    one, back_one = judged(pairs, count, lambda context, w: root(w))
    two, back_two = judged(triples, pairs, lambda context, w: one[context[1], w])
    scores = []
    for t in of:
        score, before, run = 0.0, None, None
        for w in sequence(t):
            p = one.get((before, w), root(w) + back_one.get(before, 0.0))
            if run is not None:
                p = two.get((run, w), p + back_two.get(run, 0.0))
            score += p
            before, run = w, (before, w)
        scores.append(score)
    return scores, back_one, back_two


@pytest.mark.parametrize("least_share", [1e-3, 0.2])
def test_suffix_tree_equals_one_of_dictionaries(spark, awkward, least_share):
    """However much of the tree is sent to the workers, and however much is joined."""
    rng = random.Random(5)
    # What follows "and" depends on the token before it too.
    parts = ["a b c", "a and e", "Rare%d and y", "x and z", "q"]
    texts = [" ".join(rng.choice(parts).replace("%d", str(rng.randint(0, 40))) for _ in range(rng.randint(0, 9))) for _ in range(250)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    model, vocabulary = suffix_tree.train(df, settings=suffix_tree.Settings(least_share=least_share))
    for rows in (df, awkward):
        found = suffix_tree.score(rows, model, vocabulary).collect()
        expected, one, two = tree_scores([*texts, None], [r.text for r in found])
        assert one and two
        assert [r.score for r in found] == pytest.approx(expected)


def test_suffix_tree_is_a_distribution(spark):
    """After any context, the probabilities of all next tokens add up to one."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["x y z", "x y w", "u v"]) for _ in range(8)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model, _ = suffix_tree.train(df, settings=suffix_tree.Settings(least_share=1e-3, divergence=0.1))
    assert sum(level.state.sum() for level in model.levels) > 3
    words = [*range(len(model.tokens)), -1]
    for context in ([], [0], [1, 2], [3, 4, 5], [-1, 2], [2, -1]):
        for depth in range(1, len(model.levels) + 1):
            short = suffix_tree.Model(model.tokens, model.counts, model.levels[:depth], model.total, model.distinct)
            assert sum(10 ** next_log(short, context, w) for w in words) == pytest.approx(1)


def test_suffix_tree_is_the_same_at_every_size(spark):
    """A context that occurs often enough is a state, whatever its share of the corpus: what
    share is sent to the workers changes no score."""
    rng = random.Random(5)
    texts = ["p q r s", "p q r s", "q t", *["p q r s u"] * 60, *["r q v"] * 40, *["w q r"] * 30]
    texts += [" ".join("abcdefghij"[rng.randint(0, 9)] for _ in range(40)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    scores = []
    for share in (1e-9, 1e-2, 1.0):
        model, table = suffix_tree.train(df, settings=suffix_tree.Settings(least_share=share))
        scores.append([r.score for r in suffix_tree.score(df, model, table).orderBy("k").collect()])
    assert scores[1] == pytest.approx(scores[0]) and scores[2] == pytest.approx(scores[0])


def next_log(model, context, word):
    """log10 probability of a token number (-1: unknown) after token numbers."""
    import numpy as np

    unknown = np.uint64(12345)
    sequence = np.array([model.tokens[w] if w >= 0 else unknown for w in [*context, word]] + [suffix_tree.END], np.uint64)
    at, first = len(context), np.array([0, len(sequence)])
    count = model.counts[word] if word >= 0 else 0
    gain = 0.0
    for level, (before, taken) in zip(model.levels, suffix_tree._walk(model, sequence, first)):
        if taken[at] >= 0:
            gain = level.gain[taken[at]]
        elif before[at] >= 0:
            gain += level.back[before[at]]
    return float(model.root(np.array(count))) + gain


def python_overlap(texts, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall((t or "").translate(LOW))
    windows = {}
    for i, t in items:
        w = words(t)
        size = min(13, len(w))
        for k in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, named = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    named |= windows[tuple(w[k : k + size])]
        out.append((len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_overlaps_like_plain_python(spark, awkward, nothing):
    rng = random.Random(7)
    make = lambda n: " ".join(rng.choice(["the", "of", "A", "b1", "Ünï", "cat", "dog"]) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([20, 15, 13, 12, 5, 4, 2, 40])] + [(8, None), (9, ""), (0, "again, the ITEM's own number: b1")]
    texts = [make(rng.randint(0, 200)) for _ in range(30)]
    texts += [f"{make(3)}... {t}! {make(40)}" for _, t in items if t] + [t for _, t in items if t]
    texts += [t for (t,) in awkward.select("text").collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string")
    found = decontaminate.overlaps(docs, bench, keep=["k"]).orderBy("k").collect()
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in found] == python_overlap(texts, items)
    kept = decontaminate.overlaps(awkward, bench)
    assert kept.count() == awkward.count() and set(kept.columns) == set(awkward.columns)
    assert decontaminate.overlaps(nothing, bench).count() == 0
    assert {r.n_hit for r in decontaminate.overlaps(docs, bench.limit(0)).collect()} == {0}


def test_overlaps_do_not_depend_on_the_map(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAP_BITS", 64)
    docs = [("a b c d e f g h i j k l m n o",), ("a b c d e f g h i j k l x m n o",)]
    bench = spark.createDataFrame([(1, "b c d e f g h i j k l m n o p")], "item_id long, text string")
    found = decontaminate.overlaps(spark.createDataFrame(docs, "text string"), bench).collect()
    assert sorted(r.n_hit for r in found) == [0, 14]


def test_workers_hold_few_arrays(spark):
    """The memory of a Python worker for a batch of texts, and what comes back from it."""
    import tracemalloc

    import pyarrow as pa

    column = pa.array([f"some words of text {i} " * 100 for i in range(1024)])
    language._tables.clear()
    peaks = []
    for work in (
        lambda: [present.sum() for _, _, present, _ in language._presence_parts(column, language.Settings(), small=True)],
        lambda: [len(values) for _, values in minhash.shingle_sets(column, 3)],
    ):
        tracemalloc.start()
        work()
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert max(peaks) < 30, peaks
    rows = spark.createDataFrame([(1, "ein Satz"), (2, None)], "k long, text string")
    model = language.train(rows.selectExpr("text", "'de' as lang"), "text", "lang")
    found = language.predict(rows, model, keep=["k"], small=True)
    assert found.columns == ["k", "lang_pred", "score"]
    assert [r.lang_pred for r in found.orderBy("k").collect()] == ["de", "und"]
    assert language.predict(rows, model, keep=[]).columns == ["lang_pred", "score"]


def test_copies_that_just_miss_a_link_make_no_pairs(spark, monkeypatch):
    """Copies that share an edit but not enough of them are told apart by bits, not by their sets."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words)]
    for _ in range(400):
        own = list(words)
        for at in rng.sample(range(3, 118, 4), 4):
            own[at] = f"edit{at}"
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(118)} for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
                links += 1
    made, before = [], minhash._pairs

    def pairs(*args):
        out = before(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_pairs", pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = minhash.near_duplicates(df, settings=minhash.Settings(shingle=3, percent=85, matches=36)).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: find(i) for i in range(len(sets))}
    assert sum(made) <= 2 * links + 400, (made, links)


def test_texts_are_not_shuffled_to_meet_the_hits(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, passage), (1, "x y z"), (None, f"a {passage}"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("i", passage)], "item_id string, text string")
    found = decontaminate.overlaps(docs, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    rows = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect()]
    assert sorted(rows, key=str) == [(1, 14, 14, ["i"], True), (1, 3, 0, [], False), (2, 0, 0, [], False), (None, 15, 14, ["i"], True)]
