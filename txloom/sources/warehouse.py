"""Orders, line items, documents and click events seen as transactions.

An order is a transaction, its line items give lists of amounts with units, and
the document with its number is its memo. Click events become one transaction
each, with a time that suits streams and retention.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.model import BLOCK_TYPE, TX_TYPE

# Click events of a task: short as rows, but some thousand bytes each as messages.
EVENTS_PER_TASK = 50_000
MODULES = {"F": "compute", "O": "bank", "P": "gov"}
UNITS = {"A": "uscrt", "N": "uatom"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _ibc_unit() -> Column:
    return F.concat(F.lit("ibc/"), F.upper(F.sha2(F.lit("R"), 256)))


def _choose(column: str | Column, names: dict[str, str], other: Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    chosen = None
    for code, name in names.items():
        hit = column == code
        chosen = F.when(hit, name) if chosen is None else chosen.when(hit, name)
    return chosen.otherwise(other)


def _height() -> Column:
    return (F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) + 1).cast("long")


def _order_columns() -> dict[str, Column]:
    number = F.col("o_orderkey").cast("string")
    return {
        "tx_id": F.col("o_orderkey"),
        "height": _height(),
        "ts": F.col("o_orderdate").cast("timestamp"),
        "tx_hash": F.upper(F.sha2(number, 256)),
    }


def _order_values() -> dict[str, Column]:
    """Single-valued paths of an order."""
    return {
        "tm.event": F.lit("Tx"),
        "tx.height": _height().cast("string"),
        "tx.hash": F.upper(F.sha2(F.col("o_orderkey").cast("string"), 256)),
        "message.module": _choose("o_orderstatus", MODULES, F.lit(None).cast("string")),
        "message.sender": F.concat(F.lit("addr"), F.col("o_custkey").cast("string")),
        "message.priority": F.col("o_orderpriority"),
    }


def _item_values() -> dict[str, Callable[[Column], Column]]:
    """Paths to which each line item, given as a struct, adds a value (or NULL for none)."""

    def amount(item: Column) -> Column:
        cents = F.round(item["l_extendedprice"] * 100).cast("long").cast("string")
        return F.concat(cents, _choose(item["l_returnflag"], UNITS, _ibc_unit()))

    return {
        "transfer.amount": amount,
        "transfer.recipient": lambda item: F.concat(F.lit("supp"), item["l_suppkey"].cast("string")),
        "transfer.huge": lambda item: F.concat(item["l_partkey"].cast("string"), F.lit("7" * 40)),
        "wasm.quantity": lambda item: item["l_quantity"].cast("int").cast("string"),
        "wasm.refund": lambda item: F.when(item["l_discount"] >= 0.09, item["l_linenumber"].cast("string")),
    }


def order_headers(spark: SparkSession, folder: str) -> DataFrame:
    """tx_id, height, ts and tx_hash of each order."""
    return table(spark, folder, "orders").select(*[c.alias(n) for n, c in _order_columns().items()])


def _rows(df: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(p).alias("path"), v.alias("value")) for p, v in values.items()])
    rows = df.select(F.col(key).alias("tx_id"), F.inline(pairs))
    return rows.where("value IS NOT NULL")


def order_attrs(spark: SparkSession, folder: str) -> DataFrame:
    """tx_id, path and value of all orders: one scan per table, no shuffle."""
    documents = table(spark, folder, "documents")
    items = table(spark, folder, "lineitem")
    item_values = {path: value(items) for path, value in _item_values().items()}
    memos = documents.select(
        F.col("doc_id").alias("tx_id"), F.lit("memo.text").alias("path"), F.col("text").alias("value")
    )
    return (
        _rows(table(spark, folder, "orders"), "o_orderkey", _order_values())
        .unionByName(_rows(items, "l_orderkey", item_values))
        .unionByName(memos)
    )


def order_txs(spark: SparkSession, folder: str) -> DataFrame:
    """The same with an event map per order; lists are in order of value.

    Line items are gathered by order as they are, which is also how they join their order;
    their values, far longer, are written afterwards. An order without line items has empty lists.
    """
    used = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]
    gathered = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    gathered = gathered.agg(F.collect_list(F.struct(*used)).alias("_items"))
    items = gathered.select(
        "o_orderkey",
        *[F.array_sort(F.array_compact(F.transform("_items", v))).alias(p) for p, v in _item_values().items()],
    )
    memos = table(spark, folder, "documents").select(F.col("doc_id").alias("o_orderkey"), F.array("text").alias("memo.text"))
    joined = table(spark, folder, "orders").join(items, "o_orderkey", "left").join(memos, "o_orderkey", "left")
    lists = {path: F.array(value) for path, value in _order_values().items()}
    lists |= {path: F.col(f"`{path}`") for path in (*_item_values(), "memo.text")}
    empty = F.array().cast("array<string>")
    entries = [e for path, values in lists.items() for e in (F.lit(path), F.coalesce(values, empty))]
    return joined.select(*[c.alias(n) for n, c in _order_columns().items()], F.create_map(*entries).alias("events"))


def _event_amount() -> Column:
    return F.concat(F.round(F.col("value") * 100).cast("long").cast("string"), F.lit("uscrt"))


def event_txs(events: DataFrame) -> DataFrame:
    """Click events as transactions; works on stored rows and on a stream."""
    number = F.col("event_id").cast("string")
    height = (F.datediff("ts", F.lit("2024-01-01").cast("date")) + 1).cast("long")
    digest = F.upper(F.sha2(number, 256))
    paths = {
        "tm.event": F.lit("Tx"),
        "tx.height": height.cast("string"),
        "tx.hash": digest,
        "message.action": F.col("event_type"),
        "message.sender": F.concat(F.lit("user"), F.col("user_id").cast("string")),
        "transfer.amount": _event_amount(),
        "wasm.k": F.get_json_object("props", "$.k"),
    }
    entries = [e for p, v in paths.items() for e in (F.lit(p), F.array(v))]
    return events.select(
        F.col("event_id").alias("tx_id"),
        height.alias("height"),
        F.col("ts").cast("timestamp").alias("ts"),
        digest.alias("tx_hash"),
        F.create_map(*entries).alias("events"),
    )


def _spread(events: DataFrame, rows: int) -> DataFrame:
    """Dealt out by rows; a file of few bytes is one task otherwise."""
    tasks = -(-rows // EVENTS_PER_TASK)
    return events.repartition(tasks, "event_id", "ts") if tasks > 1 else events


def stored_events(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return _spread(events, events.count())


def live_events(spark: SparkSession, folder: str) -> DataFrame:
    """The same table as a stream, be it one file or a folder of them.

    As a glob, because a stream takes a plain path to be a folder.
    """
    events = table(spark, folder, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/event[s].parquet")
    return _spread(stream, events.count())


def event_messages(events: DataFrame) -> DataFrame:
    """Click events as raw JSON messages in `value`, with their time in `ts`.

    A click of type `error` arrives as an upstream error, one of type `signup` cut
    off in the middle; the others as transaction messages with a log and result.
    """
    tx = event_txs(events)
    kind = F.get(tx["events"]["message.action"], F.lit(0))
    sender = F.get(tx["events"]["message.sender"], F.lit(0))
    amount = F.get(tx["events"]["transfer.amount"], F.lit(0))

    def attribute(key: str, value: Column, index: bool) -> Column:
        return F.struct(F.lit(key).alias("key"), value.alias("value"), F.lit(index).alias("index"))

    transfer = F.struct(
        F.lit("transfer").alias("type"),
        F.array(attribute("sender", sender, True), attribute("amount", amount, False)).alias("attributes"),
    )
    entry = F.struct(F.lit(0).alias("msg_index"), F.array(transfer).alias("events"))
    # Clicks log JSON, purchases plain text, views nothing.
    log = (
        F.when(kind == "click", F.to_json(F.array(entry)))
        .when(kind == "purchase", F.concat(F.lit("paid by "), sender))
        .otherwise(F.lit(""))
    )
    result = F.struct(
        F.lit(0).alias("code"),
        log.alias("log"),
        F.lit("200000").alias("gas_wanted"),
        tx["tx_id"].cast("string").alias("gas_used"),
        F.array(transfer).alias("events"),
    )
    body = F.struct(
        tx["height"].cast("string").alias("height"),
        F.lit(0).alias("index"),
        F.base64(tx["tx_id"].cast("string").cast("binary")).alias("tx"),
        result.alias("result"),
    )
    message = F.to_json(
        F.struct(
            F.struct(
                F.struct(
                    F.lit(TX_TYPE).alias("type"),
                    F.struct(body.alias("TxResult")).alias("value"),
                ).alias("data"),
                tx["events"].alias("events"),
            ).alias("result")
        )
    )
    failure = F.to_json(
        F.struct(F.struct(F.lit(-32603).alias("code"), sender.alias("message")).alias("error"))
    )
    cut = F.concat(F.lit('{"result": {"data": '), sender)
    text = F.when(kind == "error", failure).when(kind == "signup", cut).otherwise(message)
    return tx.select(text.alias("value"), tx["ts"], tx["tx_id"])


def block_messages(events: DataFrame) -> DataFrame:
    """A block message per click event, its height the day of the click."""
    height = (F.datediff("ts", F.lit("2024-01-01").cast("date")) + 1).cast("string")
    time = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = F.struct(F.struct(F.struct(height.alias("height"), time.alias("time")).alias("header")).alias("block"))
    message = F.struct(
        F.struct(
            F.struct(F.lit(BLOCK_TYPE).alias("type"), header.alias("value")).alias("data"),
            F.create_map(F.lit("tm.event"), F.array(F.lit("NewBlock"))).alias("events"),
        ).alias("result")
    )
    arrival = F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return events.select(F.to_json(message).alias("value"), arrival.alias("arrival"))
