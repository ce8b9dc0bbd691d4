"""A training-data pipeline over `documents`: each stage's rows are the next one's input.

Stages take all documents that their predecessor kept, with the columns of `documents`, and
return these columns; the last returns tokens. Columns beside these are ignored. Rows without
a doc_id are documents like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.llm import bpe, decontaminate, language, minhash, secret_scan
from txloom.llm.common import SMALL_CHUNK_BYTES, saved, table
from txloom.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


# Number of a row of a stage's documents; ids may repeat or be null.
ROW = "row_number"
# Texts go to Python in small batches, as long ones do not share a worker's memory well.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def small_batches(spark: SparkSession) -> None:
    """Set what `run` sets back; a stage's result is written after the stage returns."""
    for setting, value in BATCHES.items():
        spark.conf.set(setting, value)


def numbered(docs: DataFrame) -> DataFrame:
    """The documents saved with a number each, by which a later step finds them again."""
    small_batches(docs.sparkSession)
    return saved(docs.select(COLUMNS).withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (no text, or no letters in it) go.

    Documents without a label get the predicted one. Texts go to Python and do not come
    back; its verdicts are joined where they change a document.
    """
    rows = numbered(docs)
    model = language.train(rows, "text", "lang")
    judged = rows.select(ROW, F.col("lang").isNull().alias("unlabelled"), "text")
    found = language.predict(judged, model, keep=[ROW, "unlabelled"], small=True)
    changed = (F.col("lang_pred") == language.UNDETERMINED) | F.col("unlabelled")
    verdicts = saved(found.where(changed).select(ROW, "lang_pred"), "verdicts")
    kept = F.col("lang_pred").isNull() | (F.col("lang_pred") != language.UNDETERMINED)
    judged = rows.join(verdicts, ROW, "left").where(kept)
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the first row stays.

    Rows are told apart by their numbers, so null and repeated ids are judged by their texts.
    """
    rows = numbered(docs)
    found = minhash.near_duplicates(rows, ROW)
    gone = saved(found.where(~F.col("kept")).select(ROW), "copies")
    # Few numbers, and no text, are on the right; Spark broadcasts them if they measure small.
    return rows.join(gone, ROW, "left_anti").select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in the benchmark go."""
    small_batches(spark)
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where(~F.col("contaminated")).select(COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked, and n_chars follows; every document stays."""
    clean = secret_scan.redact(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens and their byte offsets; `lossless` says that decoding gives the text again."""
    ranks = bpe.read_ranks(tokenizer_file())
    # Tokens of long texts are wide rows: batches between Spark and Python stay small, and
    # only a digest of the text goes along to the decoder.
    small_batches(spark)
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    digested = docs.select(*COLUMNS, F.sha2(text, 256).alias("text_sha256"))
    encoded = bpe.encode(digested, ranks, chunk_bytes=SMALL_CHUNK_BYTES).drop("text", "n_chars")
    decoded = bpe.decode(encoded, ranks)
    return decoded.select(
        "doc_id", "lang", "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids", "token_offsets",
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("lossless"),
    )


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]

# Language classification and tokenising are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; the session's settings are as before when it returns."""
    docs = table(spark, sf_dir, "documents")
    before = {setting: spark.conf.get(setting) for setting in BATCHES}
    try:
        for name, stage in STAGES:
            docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)
    return docs
