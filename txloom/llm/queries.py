"""The registered queries of this subpackage: thin digests of its operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.llm import (
    alignment,
    alignment,
    bpe,
    decontaminate,
    hard_negatives,
    hilbert,
    language,
    minhash,
    secret_scan,
    suffix_tree,
    token_files,
    topk,
    url_filter,
    warc,
)
from txloom.llm.common import table
from txloom.session import scratch

URL_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]


def remainder(doc_id: str, divisor: int):
    """crc32 of the id as text, modulo `divisor`; null for a null id."""
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")), F.lit(divisor))


def op1_url_template_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, "url", URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op2_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, vocabulary = suffix_tree.train(docs.where(remainder("doc_id", 5) != 1))
    scored = suffix_tree.score(docs, model, vocabulary, keep=["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 1, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op3_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = language.train(docs.where(remainder("doc_id", 4) != 2), "text", "lang")
    found = language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_norm_bucket_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("id") % 20 == 0), k=20)


def op5_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs).select("doc_id", "secrets")

    def of_kind(k: int):
        return F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")

    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("secrets")).alias("spans"),
    )


CRAWL_DATE = "2024-01-31T00:00:00Z"


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = warc.responses(table(spark, sf_dir, "pages"), CRAWL_DATE)
    return warc.derivatives(source, keep=["page_id"])


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = docs.select(
        "doc_id", "lang", "source", "n_chars",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    dims = [F.col("lang"), F.col("source"), hilbert.size_class(F.col("n_chars"))]
    ties = [F.col("text_crc32"), F.col("doc_id")]
    placed = hilbert.shard(rows, dims, ties)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.read_ranks(tokenizer_file())
    encoded = bpe.encode(docs, ranks, offsets=False).select("doc_id", "token_ids")
    decoded = bpe.decode(encoded, ranks)
    return decoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_coordinate_join_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    settings = minhash.Settings(shingle=3, percent=85, matches=36)
    return minhash.near_duplicates(docs, settings=settings)


def op10_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Only n_words leaves the texts, so they are dropped after the pass over them.
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def tokenizer_bytes(name: str) -> bytes:
    with open(tokenizer_file(name), "rb") as file:
        return file.read()


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = tokenizer_bytes("byte_bpe_50k.json"), tokenizer_bytes("piece_bpe_32k.model")
    return alignment.align(docs, *files, keep=["doc_id"]).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.integers(rows.withColumn("label", label), "vec_id", "embedding", "label", scale=256)
    return hard_negatives.mine(rows, rows.where(F.col("id") % 100 == 0))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch(spark, "token-files")
    token_files.write(docs, tokenizer_bytes("byte_bpe_50k.json"), folder)
    read = token_files.read(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_template_filter,
        op2_suffix_tree_score,
        op3_string_kernel_language,
        op4_norm_bucket_top_k,
        op5_secret_links,
        op6_warc_derivatives,
        op7_hilbert_shards,
        op8_byte_bpe,
        op9_coordinate_join_dedup,
        op10_benchmark_overlap,
        op11_tokenizer_alignment,
        op12_hard_negatives,
        op13_token_files,
    )
}
