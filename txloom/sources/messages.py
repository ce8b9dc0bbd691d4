"""Upstream messages: parsing, routing and the rows made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.functions import values as V
from txloom.functions.predicates import attr_eq
from txloom.model import BLOCK_TYPE, MESSAGE_DDL, TX_TYPE
from txloom.operators.ids import assign_ids


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as a table with the text in `value`."""
    return spark.read.text(path)


def stream_messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same as a stream over arriving files."""
    reader = spark.readStream.format("text")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """The same from a Kafka topic (needs Spark's Kafka package on the cluster)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribe", topic).options(**options)
    return reader.load().select(F.col("value").cast("string").alias("value"), "timestamp")


def decode_messages(raw: DataFrame) -> DataFrame:
    """Raw text with its parsed `result` and `error`.

    As a generated row, which later filters on the parts cannot pass: pushed down
    they would parse each message again for every part they look at.
    """
    return raw.select("*", F.inline(F.array(F.from_json("value", MESSAGE_DDL))))


def split_messages(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded messages with a result, and apart from them those with an error, unreadable
    ones, and transactions without the hash or height that they are stored and found by."""
    read = F.col("result").isNotNull()
    height = F.col("result.data.value.TxResult.height").try_cast("long")
    reason = (
        F.when(~read, F.when(F.col("error").isNotNull(), F.lit("error")).otherwise(F.lit("unreadable")))
        .when(_is_transaction() & V.tx_hash(F.col("result.events")).isNull(), F.lit("no hash"))
        .when(_is_transaction() & height.isNull(), F.lit("no height"))
    )
    judged = decoded.withColumn("reason", reason)
    accepted = judged.where("reason IS NULL").drop("value", "error", "reason")
    return accepted, judged.where("reason IS NOT NULL").drop("result")


def _is_transaction() -> Column:
    by_type = F.coalesce(F.col("result.data.type") == TX_TYPE, F.lit(False))
    return attr_eq("tm.event", "Tx", F.col("result.events")) | by_type


def parse_messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages that can be used, and apart from them the others, with a reason and the
    raw text."""
    return split_messages(decode_messages(raw))


def route_by_type(accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transaction messages and block messages; anything else (such as the
    acknowledgement of a subscription) is neither."""
    events = F.col("result.events")
    kind = F.col("result.data.type")
    is_block = attr_eq("tm.event", "NewBlock", events) | F.coalesce(kind == BLOCK_TYPE, F.lit(False))
    return accepted.where(_is_transaction()), accepted.where(is_block)


def block_headers(blocks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Height and time of each block."""
    header = F.col("result.data.value.block.header")
    return blocks.select(
        *keep,
        header["height"].try_cast("long").alias("height"),
        F.try_to_timestamp(header["time"]).alias("time"),
    )


def height_span(headers: DataFrame, arrival: str | Column) -> DataFrame:
    """First and latest height in order of arrival.

    A first height of zero counts as not yet seen. Works on streams in complete mode.
    """
    arrival = F.col(arrival) if isinstance(arrival, str) else arrival
    height = F.col("height")
    return headers.agg(
        F.coalesce(F.min_by(height, F.when(height != 0, arrival)), F.lit(0)).alias("earliest"),
        F.coalesce(F.max_by(height, arrival), F.lit(0)).alias("latest"),
    )


def transaction_rows(txs: DataFrame, arrival: Column | None = None) -> DataFrame:
    """One row per transaction message, before it has an id."""
    body = F.col("result.data.value.TxResult")
    res = body["result"]
    stored_result = F.struct(
        res["code"].alias("code"),
        res["codespace"].alias("codespace"),
        res["info"].alias("info"),
        res["log"].alias("log"),
        res["gas_wanted"].try_cast("long").alias("gas_wanted"),
        res["gas_used"].try_cast("long").alias("gas_used"),
        F.try_to_binary(res["data"], F.lit("base64")).alias("data"),
        res["events"].alias("events"),
    )
    events = F.col("result.events")
    return txs.select(
        body["height"].try_cast("long").alias("height"),
        V.tx_hash(events).alias("tx_hash"),
        (F.current_timestamp() if arrival is None else arrival).alias("ts"),
        F.try_to_binary(body["tx"], F.lit("base64")).alias("tx_bytes"),
        body["index"].alias("tx_index"),
        stored_result.alias("result"),
        events.alias("events"),
    )


def append_transactions(rows: DataFrame, start: int | Column = 0) -> DataFrame:
    """Give new transactions their ids, after `start`, in chain order."""
    numbered = assign_ids(rows, ["height", "tx_index", "tx_hash"], "tx_id", start)
    return numbered.select("tx_id", *rows.columns)
