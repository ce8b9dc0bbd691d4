"""Fixtures of the llm tests: awkward rows that every operator has to take."""

import pytest

CLASHING = [
    "_row", "_strong", "_weak", "secrets", "token_ids", "token_offsets", "decoded", "n_words", "n_hit",
    "items", "contaminated", "lang_pred", "score", "base_score", "n_tokens", "n_known", "hilbert",
    "shard", "slot", "_key_0", "_cell_0", "_cell_number", "_place_no", "class", "n", "kept", "host", "path",
    "posts", "_posts", "base", "frequent", "gain", "rare", "_base", "_frequent", "_gain", "_rare", "_row_no", "rare_base",
    "rare_known", "rare_gain", "_rejected", "_shape", "_place", "_part", "_before", "_n", "key", "times", "is_run", "start",
    "length", "window", "shingle", "spans", "template", "purity", "rule", "verdict", "label", "segments", "segment", "prefix",
]
LONG = ("lorem ipsum dolor " * 12000).strip()
TEXTS = [
    (1, "Password: hunter22 and the the the quick brown fox jumps over the lazy dog again"),
    (2, None),
    (3, ""),
    (4, " \t\r\n\x0b "),
    (5, LONG),
    (6, "12345 !!! ???"),
    (7, "Ça va? Größe 漢字 's don't 'll 12 3 \u00a0x"),
    (8, "Ça va? Größe 漢字 's don't 'll 12 3 \u00a0x"),
    (8, "Ça va? Größe 漢字 's don't 'll 12 3 \u00a0x"),
    (None, "no id at all but still some words in a row here"),
    (None, None),
    (9, "x" * 5000),
    (10, "one"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """(doc_id, text, lang, source, n_chars) with nulls, repeats, a long text and other columns."""
    rows = [(i, t, None if i == 7 else "en", "s" if (i or 0) % 2 else None, len(t) if t else None) for i, t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("own") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
