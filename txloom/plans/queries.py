"""One query per operator, over the warehouse tables seen as transactions.

All of them return scalar columns; lists are joined into text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.functions import predicates as P
from txloom.functions import rowwise as R
from txloom.functions import values as V
from txloom.operators import attributes as A
from txloom.operators import delivery as D
from txloom.operators import dictionary as X
from txloom.operators import ids as I
from txloom.operators import matching as M
from txloom.operators import postings as O
from txloom.operators import retention as E
from txloom.operators.wildcards import extend, facts_under, resolve
from txloom.plans import search as S
from txloom.session import scratch, stored
from txloom.sources import messages as G
from txloom.sources import store
from txloom.sources import warehouse as W
from txloom.streaming import conditions as C
from txloom.streaming import indexing as N
from txloom.streaming import live as L

Query = Callable[[SparkSession, str], DataFrame]
HUGE = "1000" + "7" * 40
EXPLORER = "https://explorer.example/{chainShort}/tx/{hash}"
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(values: Column) -> Column:
    return F.array_join(values, "|")


def _at(day: str) -> Column:
    """Midnight of a day in the session's time zone, as the stored times are."""
    return F.to_timestamp(F.lit(day))


def _shown(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(ts)


def _text(column: str) -> Column:
    return F.coalesce(column, F.lit("")).alias(column)


def _indexed(spark: SparkSession, folder: str) -> DataFrame:
    return A.index_attributes(W.order_attrs(spark, folder))


def _without_empty(txs: DataFrame) -> DataFrame:
    return txs.withColumn("events", F.map_filter("events", lambda _, v: F.size(v) > 0))


def _longest_document(spark: SparkSession, folder: str) -> str:
    longest = W.table(spark, folder, "documents").orderBy(F.desc(F.length("text")), "doc_id")
    return longest.select("text").first()[0]


# --- values and attributes --------------------------------------------------


@query
def explode_attributes(spark, folder):
    rows = A.explode_attributes(W.order_txs(spark, folder))
    return rows.select("tx_id", "path", F.col("val_ord").cast("long").alias("val_ord"), "value")


@query
def build_event_map(spark, folder):
    attrs = A.explode_attributes(W.order_txs(spark, folder))
    rebuilt = A.build_event_map(attrs, together=True).select("tx_id", F.explode("events").alias("path", "_values"))
    return rebuilt.select("tx_id", "path", _joined("_values").alias("joined"))


@query
def parse_quantity(spark, folder):
    rows = W.order_attrs(spark, folder)
    rows = rows.withColumns({"qty_text": V.quantity_text("value"), "unit": V.quantity_unit("value")})
    return rows.select("tx_id", "path", _text("qty_text"), _text("unit"))


@query
def quantity_key(spark, folder):
    rows = W.order_attrs(spark, folder).withColumn("qty_text", V.quantity_text("value"))
    keyed = rows.where("qty_text IS NOT NULL").select("qty_text").distinct()
    return keyed.select("qty_text", V.quantity_key("qty_text").alias("qty_key"))


@query
def split_long_values(spark, folder):
    return W.order_attrs(spark, folder).select(
        "tx_id",
        "path",
        F.coalesce(V.value_text("value"), F.lit("")).alias("value_text"),
        F.coalesce(F.octet_length(V.value_bytes("value")), F.lit(-1)).cast("long").alias("n_bytes"),
    )


@query
def value_fingerprint(spark, folder):
    return A.distinct_values(W.order_attrs(spark, folder)).select(
        "value", V.value_fingerprint("value").alias("value_hash")
    )


@query
def restore_value(spark, folder):
    split = W.order_attrs(spark, folder).select(
        "tx_id", "path", V.value_text("value").alias("t"), V.value_bytes("value").alias("b")
    )
    return split.select("tx_id", "path", V.restore_value("t", "b").alias("value"))


@query
def tx_bytes_base64(spark, folder):
    binary = W.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("tx_id"), F.encode(F.col("o_orderpriority"), "UTF-8").alias("b")
    )
    encoded = binary.withColumn("tx", V.encode_tx("b"))
    return encoded.select("tx_id", "tx", F.decode(V.decode_tx("tx"), "UTF-8").alias("back"))


@query
def tx_hash(spark, folder):
    return W.order_txs(spark, folder).select("tx_id", V.tx_hash().alias("hash"))


@query
def explorer_link(spark, folder):
    chain = F.get(P.values_at("message.priority"), F.lit(0))
    txs = W.order_txs(spark, folder)
    return txs.select("tx_id", V.explorer_link(EXPLORER, chain, V.tx_hash()).alias("url"))


@query
def distinct_paths(spark, folder):
    return A.distinct_paths(W.order_txs(spark, folder))


@query
def distinct_values(spark, folder):
    return A.distinct_values(W.order_attrs(spark, folder))


# --- predicates: on event maps, and `_indexed` on exploded attributes --------


def _predicate(
    name: str, on_map: Callable[[], Column], on_rows: Callable[[], Column], absent: bool = False
) -> None:
    def from_map(spark, folder):
        return W.order_txs(spark, folder).where(on_map()).select("tx_id")

    def from_rows(spark, folder):
        join = M.tx_antijoin if absent else M.tx_semijoin
        return join(W.order_headers(spark, folder), _indexed(spark, folder), on_rows()).select("tx_id")

    QUERIES[name] = from_map
    QUERIES[f"{name}_indexed"] = from_rows


_PREDICATES = {
    "attr_exists": ("wasm.refund",),
    "attr_eq": ("message.module", "compute"),
    "attr_ne": ("transfer.recipient", "supp1"),
    "attr_gt": ("transfer.amount", "5000000uscrt"),
    "attr_lt": ("transfer.huge", HUGE),
    "attr_ge": ("wasm.quantity", "48"),
    "attr_le": ("transfer.amount", "200000uatom"),
    "attr_includes": ("memo.text", "la"),
    "attr_not_includes": ("memo.text", "la"),
    "attr_like": ("message.sender", "addr1_3%"),
    "attr_not_like": ("message.priority", "%H"),
    "attr_in": ("message.sender", ["addr12", "addr700", "addr1", "addr12", 5]),
    "attr_not_in": ("wasm.quantity", [1, 2, 3]),
}
for _name, _args in _PREDICATES.items():
    _predicate(_name, partial(getattr(P, _name), *_args), partial(getattr(R, _name), *_args))
_predicate(
    "attr_not_exists",
    lambda: P.attr_not_exists("wasm.refund"),
    lambda: R.attr_exists("wasm.refund"),
    absent=True,
)
_predicate(
    "path_wildcard",
    lambda: P.path_wildcard("wasm.*", lambda v: v == "3"),
    lambda: R.attr_eq("wasm.*", "3"),
)
_predicate(
    "attr_like_lines",
    lambda: P.attr_like("memo.text", "%la%"),
    lambda: R.attr_like("memo.text", "%la%"),
)
_predicate(
    "unit_matches",
    lambda: F.exists(P.values_at("transfer.amount"), lambda v: P.unit_matches(v, "uatom")),
    lambda: R.on_path("transfer.amount") & (F.col("unit") == "uatom"),
)


@query
def attr_eq_long(spark, folder):
    text = _longest_document(spark, folder)
    return W.order_txs(spark, folder).where(P.attr_eq("memo.text", text)).select("tx_id")


@query
def attr_eq_long_indexed(spark, folder):
    condition = R.attr_eq("memo.text", _longest_document(spark, folder))
    return M.tx_semijoin(W.order_headers(spark, folder), _indexed(spark, folder), condition).select("tx_id")


@query
def attr_ne_long(spark, folder):
    text = _longest_document(spark, folder)
    return W.order_txs(spark, folder).where(P.attr_ne("memo.text", text)).select("tx_id")


@query
def attr_ne_long_indexed(spark, folder):
    condition = R.attr_ne("memo.text", _longest_document(spark, folder))
    return M.tx_semijoin(W.order_headers(spark, folder), _indexed(spark, folder), condition).select("tx_id")


@query
def attr_in_table(spark, folder):
    suppliers = W.table(spark, folder, "supplier").where("s_acctbal > 5000")
    members = suppliers.select(F.concat(F.lit("supp"), F.col("s_suppkey").cast("string")).alias("value"))
    headers, attrs = W.order_headers(spark, folder), W.order_attrs(spark, folder)
    return M.attr_in_table(headers, attrs, "transfer.recipient", members).select("tx_id")


@query
def all_of(spark, folder):
    matches = P.all_of(
        P.attr_eq("message.module", "compute"),
        P.attr_gt("transfer.amount", "5000000uscrt"),
        P.attr_exists("wasm.refund"),
    )
    return W.order_txs(spark, folder).where(matches).select("tx_id")


@query
def any_of(spark, folder):
    matches = P.any_of(
        P.attr_eq("message.module", "gov"),
        P.attr_lt("transfer.amount", "150000uatom"),
        P.attr_eq("message.sender", "addr7"),
    )
    return W.order_txs(spark, folder).where(matches).select("tx_id")


@query
def mixed_tree(spark, folder):
    matches = P.attr_eq("message.module", "bank") & (
        P.attr_gt("transfer.amount", "9000000uscrt")
        | P.attr_le("wasm.quantity", 2)
        | P.attr_not_exists("transfer.amount")
    )
    return W.order_txs(spark, folder).where(matches).select("tx_id")


# --- joins ------------------------------------------------------------------

@query
def tx_outer_flags(spark, folder):
    conditions = {
        "module": R.attr_eq("message.module", "bank"),
        "rich": R.attr_gt("transfer.amount", "9000000uscrt"),
        "few": R.attr_le("wasm.quantity", 2),
        "paid": R.attr_exists("transfer.amount"),
    }
    where = F.col("module") & (F.col("rich") | F.col("few") | ~F.col("paid"))
    found = M.tx_outer_flags(W.order_headers(spark, folder), _indexed(spark, folder), conditions, where)
    return found.select("tx_id", "height")


@query
def matching_attributes(spark, folder):
    return M.matching_attributes(_indexed(spark, folder), R.attr_gt("transfer.amount", "5000000uscrt"))


@query
def tx_semijoin(spark, folder):
    condition = R.attr_ge("wasm.quantity", 48)
    return M.tx_semijoin(W.order_headers(spark, folder), _indexed(spark, folder), condition).select("tx_id", "tx_hash")


@query
def tx_antijoin(spark, folder):
    condition = R.attr_exists("transfer.amount")
    return M.tx_antijoin(W.order_headers(spark, folder), _indexed(spark, folder), condition).select("tx_id", "tx_hash")


@query
def rehydrate(spark, folder):
    attrs = _indexed(spark, folder)
    found = M.tx_semijoin(W.order_headers(spark, folder), attrs, R.attr_gt("transfer.amount", "9000000uscrt"))
    return M.rehydrate(attrs, found).select("tx_id", "path", "value")


def _dictionaries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Attributes with path ids in alphabetical order and value ids in hash order."""
    attrs = W.order_attrs(spark, folder)
    paths = attrs.select(F.col("path").alias("path_text")).distinct()
    paths = I.assign_ids(paths, ["path_text"], "path_id")
    return attrs, paths, _value_dictionary(attrs)


def _value_dictionary(attrs: DataFrame) -> DataFrame:
    """Values with ids in hash order, stored: several jobs read them."""
    return X.value_dictionary(attrs)


def _facts(attrs: DataFrame, paths: DataFrame, values: DataFrame) -> DataFrame:
    return stored(X.encode_attributes(attrs, paths, values), "facts")


@query
def encode_attributes(spark, folder):
    return X.encode_attributes(*_dictionaries(spark, folder))


@query
def decode_facts(spark, folder):
    attrs, paths, values = _dictionaries(spark, folder)
    return X.decode_facts(_facts(attrs, paths, values), paths, values)


@query
def matching_facts(spark, folder):
    attrs, paths, values = _dictionaries(spark, folder)
    facts = _facts(attrs, paths, values)
    return M.matching_facts(facts, paths, values, "transfer.amount", R.attr_gt("transfer.amount", "5000000uscrt"))


@query
def insert_if_absent(spark, folder):
    """Some values are known already; those of all attributes come in."""
    attrs = W.order_attrs(spark, folder)
    known = attrs.where(F.col("path").startswith("message.") | F.col("path").startswith("tx."))
    known = _value_dictionary(known)
    return X.upsert_values(X.value_keys(attrs), known).new.select("value_id", "value_hash", _text("unit"))


@query
def union_new_existing(spark, folder):
    """Ids of all requested values, those of orders and line items, known or not."""
    attrs = W.order_attrs(spark, folder)
    known = attrs.where(F.col("path").startswith("message.") | F.col("path").startswith("memo."))
    known = _value_dictionary(known)
    requested = attrs.where(~F.col("path").startswith("memo."))
    return X.upsert_values(X.value_keys(requested), known).found


@query
def insert_paths(spark, folder):
    """Paths in first-seen order, `tm.event` and `tx.hash` already known."""
    txs = _without_empty(W.order_txs(spark, folder))
    known = spark.createDataFrame([(1, "tm.event"), (2, "tx.hash")], "path_id long, path_text string")
    return X.upsert_paths(X.path_keys(txs), known).found


@query
def assign_ids(spark, folder):
    numbered = I.assign_ids(W.order_headers(spark, folder), ["height", "tx_hash"], "new_id", 1000)
    return numbered.select("new_id", "tx_id", "height")


# --- search, order, pages ---------------------------------------------------


def _stored_messages(spark: SparkSession, folder: str) -> DataFrame:
    raw = W.event_messages(W.stored_events(spark, folder))
    txs, _ = G.route_by_type(G.parse_messages(raw)[0])
    rows = G.transaction_rows(txs.withColumn("_ts", F.col("ts")), F.col("_ts"))
    return rows.withColumn("tx_id", F.col("tx_bytes").cast("string").cast("long"))


def _flat_records(found: DataFrame) -> DataFrame:
    return found.select(
        "tx_id",
        "height",
        F.col("index").cast("long").alias("index"),
        "tx",
        F.col("result.gas_used").alias("gas_used"),
        _joined(P.values_at("transfer.amount")).alias("amounts"),
        _joined(P.values_at("message.sender")).alias("senders"),
        "query",
    )


@query
def search_txs(spark, folder):
    matches = P.attr_gt("transfer.amount", "5000uscrt") & P.attr_eq("message.action", "click")
    return _flat_records(S.search_txs(_stored_messages(spark, folder), matches, "rich clicks"))


@query
def search_indexed(spark, folder):
    txs = _stored_messages(spark, folder)
    attrs = A.index_attributes(A.explode_attributes(txs))
    conditions = {
        "rich": R.attr_gt("transfer.amount", "5000uscrt"),
        "click": R.attr_eq("message.action", "click"),
    }
    found = S.search_indexed(txs, attrs, conditions, F.col("rich") & F.col("click"), "rich clicks")
    return _flat_records(found)


@query
def search_facts(spark, folder):
    """The same search over facts and dictionaries; no event map is read."""
    txs = _stored_messages(spark, folder)
    attrs = A.explode_attributes(txs)
    paths = I.assign_ids(attrs.select(F.col("path").alias("path_text")).distinct(), ["path_text"], "path_id")
    values = _value_dictionary(attrs)
    facts = _facts(attrs, paths, values)
    conditions = {
        "rich": ("transfer.amount", R.attr_gt("transfer.amount", "5000uscrt")),
        "click": ("message.action", R.attr_eq("message.action", "click")),
    }
    where = F.col("rich") & F.col("click")
    return _flat_records(S.search_facts(txs, facts, paths, values, conditions, where, "rich clicks"))


@query
def search_substring(spark, folder):
    """A passage sought in the stored texts by postings of two batches, then merged ones."""
    attrs = A.explode_attributes(_without_empty(W.order_txs(spark, folder)))
    paths = _path_dictionary(spark, folder)
    values = _value_dictionary(attrs)
    facts = _facts(attrs, paths, values)
    batches, merged = scratch(spark, "postings"), scratch(spark, "postings")
    half = values.agg(F.max("value_id")).scalar() / 2
    O.write_postings(values.where(F.col("value_id") <= half), batches, 0)
    O.write_postings(values.where(F.col("value_id") > half), batches, 1)
    O.merge_postings(spark, batches, merged)
    long = O.search_substring(facts, paths, "memo.text", O.containing(spark, merged, "and the "))
    short = O.search_substring(facts, paths, "transfer.recipient", O.containing(spark, batches, "p1"))
    found = long.unionByName(short)
    return found.select("tx_id", "path", F.sha2("value", 256).alias("value_sha256"))


@query
def deliver_batches(spark, folder):
    found = W.order_txs(spark, folder).where(P.attr_gt("transfer.amount", "5000000uscrt"))
    batches = D.deliver_batches(found.select("tx_id", "height"))
    return batches.select("tx_id", "batch_no", F.col("finished").cast("long").alias("finished"))


@query
def result_table(spark, folder):
    matches = P.attr_gt("transfer.amount", "5000000uscrt") & P.attr_eq("message.module", "compute")
    paths = ["transfer.amount", "message.module", "tx.height", "wasm.refund"]
    table = S.result_table(W.order_txs(spark, folder), matches, paths)
    return table.select(
        "height",
        "hash",
        F.col("`message.module`")[0].alias("module"),
        _joined(F.col("`transfer.amount`")).alias("amounts"),
        _joined(F.col("`wasm.refund`")).alias("refunds"),
    )


@query
def order_by_id(spark, folder):
    return D.order_by_id(W.order_headers(spark, folder)).select("tx_id", "tx_hash")


@query
def newest_first(spark, folder):
    return D.newest_first(W.order_headers(spark, folder)).select("tx_id", "tx_hash")


@query
def height_range(spark, folder):
    return D.height_range(W.order_headers(spark, folder), 500, 1500).select("tx_id", "height")


@query
def page(spark, folder):
    found = W.order_txs(spark, folder).where(P.attr_eq("message.module", "gov"))
    return D.page(found.select("tx_id", "height"), 100, 50)


@query
def page_deep(spark, folder):
    """A page beyond the reach of a top-n."""
    return D.page(W.order_headers(spark, folder).select("tx_id", "height"), 500, 11_000)


@query
def list_attributes(spark, folder):
    txs = _without_empty(W.order_txs(spark, folder))
    none = spark.createDataFrame([], "path_id long, path_text string")
    return D.list_attributes(X.upsert_paths(X.path_keys(txs), none).new, 6, 1)


@query
def match_count(spark, folder):
    return S.match_count(W.order_txs(spark, folder), P.attr_ge("wasm.quantity", 48))


@query
def dedupe_values(spark, folder):
    shown = S.dedupe_values(P.values_at("wasm.refund"))
    return W.order_txs(spark, folder).select("tx_id", _joined(shown).alias("refunds"))


@query
def distinct_transactions(spark, folder):
    """Each transaction once however many of its values match."""
    condition = R.attr_exists("transfer.amount")
    return M.tx_semijoin(W.order_headers(spark, folder), W.order_attrs(spark, folder), condition).select("tx_id")


# --- retention --------------------------------------------------------------


def _clicks(spark: SparkSession, folder: str) -> DataFrame:
    return W.event_txs(W.stored_events(spark, folder))


@query
def expire_transactions(spark, folder):
    kept = E.expire_transactions(_clicks(spark, folder), _at("2024-01-31"))
    return kept.select("tx_id", _shown("ts"))


@query
def cascade_expire(spark, folder):
    txs = _clicks(spark, folder)
    facts = A.explode_attributes(txs).select("tx_id", "path", "value")
    return E.cascade_expire(facts, E.expire_transactions(txs, _at("2024-01-31")))


# --- messages ---------------------------------------------------------------


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return W.event_messages(W.stored_events(spark, folder))


@query
def parse_messages(spark, folder):
    accepted, rejected = G.parse_messages(_raw(spark, folder))
    good = accepted.select("tx_id", F.lit("ok").alias("kind"), F.col("result.data.type").alias("detail"))
    bad = rejected.select("tx_id", F.col("reason").alias("kind"), F.coalesce("error.message", F.lit("")).alias("detail"))
    return good.unionByName(bad)


@query
def parse_messages_incomplete(spark, folder):
    """Every third message has lost its hash, and every third its height."""
    third = F.col("tx_id") % 3
    text = (
        F.when(third == 0, F.replace("value", F.lit('"tx.hash"'), F.lit('"tx.none"')))
        .when(third == 1, F.replace("value", F.lit('"height":'), F.lit('"level":')))
        .otherwise(F.col("value"))
    )
    accepted, rejected = G.parse_messages(_raw(spark, folder).withColumn("value", text))
    good = accepted.select("tx_id", F.lit("ok").alias("kind"))
    return good.unionByName(rejected.select("tx_id", F.col("reason").alias("kind")))


@query
def route_by_type(spark, folder):
    events = W.stored_events(spark, folder)
    both = _raw(spark, folder).select("value").unionByName(W.block_messages(events).select("value"))
    txs, blocks = G.route_by_type(G.parse_messages(both)[0])
    kinds = txs.select(F.lit("tx").alias("kind")).unionByName(blocks.select(F.lit("block").alias("kind")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    raw = W.block_messages(W.stored_events(spark, folder))
    return G.block_headers(G.route_by_type(G.parse_messages(raw)[0])[1], ("arrival",))


@query
def block_headers(spark, folder):
    return _headers(spark, folder).select(
        F.col("arrival.event_id").alias("event_id"), "height", F.unix_seconds("time").alias("time_s")
    )


@query
def height_span(spark, folder):
    return G.height_span(_headers(spark, folder), "arrival")


@query
def append_transactions(spark, folder):
    txs, _ = G.route_by_type(G.parse_messages(_raw(spark, folder))[0])
    rows = G.transaction_rows(txs.withColumnRenamed("ts", "_ts"), F.col("_ts"))
    return G.append_transactions(rows, 100).select(
        F.col("tx_id").alias("new_id"),
        "height",
        "tx_hash",
        F.decode("tx_bytes", "UTF-8").alias("body"),
        F.col("result.gas_used").alias("gas_used"),
        _shown("ts"),
    )


@query
def flatten_result_events(spark, folder):
    rows = A.flatten_result_events(_stored_messages(spark, folder))
    return rows.select("tx_id", "path", "value", F.col("indexed").cast("long").alias("indexed"))


@query
def parse_logs(spark, folder):
    logs = A.parse_logs(_stored_messages(spark, folder))
    return logs.select(
        "tx_id",
        F.col("log_no").cast("long").alias("log_no"),
        F.coalesce(F.size("events"), F.lit(-1)).cast("long").alias("n_events"),
        F.coalesce(F.col("other")["msg_index"], F.lit("")).alias("msg_index"),
        _text("plain"),
    )


@query
def log_attributes(spark, folder):
    logs = A.parse_logs(_stored_messages(spark, folder))
    return A.log_attributes(logs).select("tx_id", "path", "value")


# --- many filters -----------------------------------------------------------


def _subscriptions() -> dict[str, Column]:
    rich = P.attr_gt("transfer.amount", "5000000uscrt")
    return {
        "rich": rich,
        "rich again": rich,
        "gov": P.attr_eq("message.module", "gov"),
        "no refund": P.attr_not_exists("wasm.refund"),
        "mixed": P.attr_like("message.priority", "1%") & ~P.attr_eq("message.module", "bank"),
    }


@query
def fan_out(spark, folder):
    return L.fan_out(W.order_txs(spark, folder), _subscriptions()).select("tx_id", "sub_id")


@query
def match_counts(spark, folder):
    return L.match_counts(L.fan_out(W.order_txs(spark, folder), _subscriptions()))


# One subscription of each kind, as (sub, clause, condition, path, op, arg, set).
_HELD = [
    ("rich", 0, 0, "transfer.amount", ">", "5000000uscrt", None),
    ("rich", 1, 0, "message.module", "=", "gov", None),
    ("rich", 1, 1, "wasm.quantity", "<=", "2", None),
    ("no refund", 0, 0, "wasm.refund", "not exists", None, None),
    ("other seller", 0, 0, "transfer.recipient", "!=", "supp1", None),
    ("other seller", 0, 1, "message.sender", "in", None, ["addr1", "addr2", "addr700"]),
    ("text", 0, 0, "memo.text", "includes", "la", None),
    ("text", 0, 1, "message.priority", "like", "1%", None),
    ("odd", 0, 0, "message.priority", "not like", "%H", None),
    ("odd", 0, 1, "message.module", "not in", None, ["gov", "bank"]),
    ("odd", 0, 2, "wasm.refund", "exists", None, None),
    ("plain", 0, 0, "memo.text", "not includes", "la", None),
    ("range", 0, 0, "tx.height", ">=", "100", None),
    ("range", 0, 1, "tx.height", "<", "300", None),
]


@query
def fan_out_table(spark, folder):
    held = spark.createDataFrame(_HELD, C.CONDITIONS_DDL)
    return C.fan_out_table(W.order_txs(spark, folder), held)


@query
def fan_out_table_wildcard(spark, folder):
    """Filters that name their paths by a wildcard, alone and beside a value."""
    held = [
        ("three", 0, 0, "wasm.*", "=", "3", None),
        ("none", 0, 0, "wasm.*", "not exists", None, None),
        ("large", 0, 0, "wasm.*", ">", "48", None),
        ("large", 0, 1, "message.module", "=", "bank", None),
        ("any", 0, 0, "*.refund", "exists", None, None),
    ]
    return C.fan_out_table(W.order_txs(spark, folder), spark.createDataFrame(held, C.CONDITIONS_DDL))


@query
def fan_out_many(spark, folder):
    """Two clauses for every supplier: a large sale, or one of a few units."""
    name = F.concat(F.lit("supp"), F.col("s_suppkey").cast("string"))

    def condition(clause: int, number: int, path: str, op: str, arg: Column) -> Column:
        return F.struct(
            F.lit(clause).alias("clause"),
            F.lit(number).alias("cond_no"),
            F.lit(path).alias("path"),
            F.lit(op).alias("op"),
            arg.alias("arg"),
            F.lit(None).cast("array<string>").alias("members"),
        )

    each = F.array(
        condition(0, 0, "transfer.recipient", "=", name),
        condition(0, 1, "transfer.amount", ">", F.lit("9000000uatom")),
        condition(1, 0, "transfer.recipient", "=", name),
        condition(1, 1, "wasm.quantity", "<=", F.lit("1")),
        condition(1, 2, "wasm.refund", "not exists", F.lit(None).cast("string")),
    )
    held = W.table(spark, folder, "supplier").select(name.alias("sub_id"), F.inline(each))
    found = C.fan_out_table(W.order_txs(spark, folder), held)
    return found.groupBy("sub_id").agg(F.count("*").alias("matches"), F.sum("tx_id").alias("sum_ids"))


def _condition(clause: int, number: int, path: Column, op: str, arg: Column) -> Column:
    return F.struct(
        F.lit(clause).alias("clause"),
        F.lit(number).alias("cond_no"),
        path.alias("path"),
        F.lit(op).alias("op"),
        arg.alias("arg"),
        F.lit(None).cast("array<string>").alias("members"),
    )


def _totals(found: DataFrame) -> DataFrame:
    return found.groupBy("sub_id").agg(F.count("*").alias("matches"), F.sum("tx_id").alias("sum_ids"))


@query
def fan_out_ranges(spark, folder):
    """Limits of every part on one path: sales above one, below another, or both at once."""
    key = F.col("p_partkey")

    def limit(lowest: int, step: int, width: int, unit: str) -> Column:
        return F.concat((key * step % width + lowest).cast("string"), F.lit(unit))

    amount = F.lit("transfer.amount")
    each = F.array(
        _condition(0, 0, amount, ">", limit(10_200_000, 7919, 300_000, "uatom")),
        _condition(1, 0, amount, "<=", limit(90_000, 104_729, 20_000, "uscrt")),
        _condition(2, 0, amount, ">=", limit(10_200_000, 611, 300_000, "uscrt")),
        _condition(2, 1, amount, "<", limit(90_000, 353, 30_000, "uatom")),
    )
    held = W.table(spark, folder, "part").select(key.cast("string").alias("sub_id"), F.inline(each))
    return _totals(C.fan_out_table(W.order_txs(spark, folder), held))


@query
def fan_out_text(spark, folder):
    """Filters by text: a passage of every document, and the end of every supplier's name."""
    docs = W.table(spark, folder, "documents").where("text IS NOT NULL")
    passage = F.substring("text", 20, 12)
    held = docs.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("sub_id"),
        F.inline(F.array(_condition(0, 0, F.lit("memo.text"), "includes", passage))),
    )
    key = F.col("s_suppkey").cast("string")
    sellers = W.table(spark, folder, "supplier").select(
        F.concat(F.lit("seller"), key).alias("sub_id"),
        F.inline(
            F.array(
                _condition(0, 0, F.lit("transfer.recipient"), "like", F.concat(F.lit("s_pp"), key)),
                _condition(0, 1, F.lit("message.priority"), "like", F.lit("_-%")),
                _condition(1, 0, F.lit("message.sender"), "like", F.concat(F.lit("%r"), key, F.lit("7"))),
            )
        ),
    )
    return _totals(C.fan_out_table(W.order_txs(spark, folder), held.unionByName(sellers)))


@query
def fan_out_wildcards_many(spark, folder):
    """A filter for every supplier, whose paths are written with wildcards in several ways."""
    key = F.col("s_suppkey")
    name = F.concat(F.lit("supp"), key.cast("string"))
    pattern = F.element_at(F.array(*map(F.lit, ["transfer.*", "*.recipient", "t*.rec*t"])), (key % 3 + 1).cast("int"))
    each = F.array(
        _condition(0, 0, pattern, "=", name),
        _condition(0, 1, F.lit("wasm.quant*"), ">", F.lit("45")),
        _condition(1, 0, F.lit("*.sender"), "=", F.concat(F.lit("addr"), key.cast("string"))),
        _condition(1, 1, F.lit("wasm.ref*"), "not exists", F.lit(None).cast("string")),
    )
    held = W.table(spark, folder, "supplier").select(name.alias("sub_id"), F.inline(each))
    return _totals(C.fan_out_table(W.order_txs(spark, folder), held))


_PATTERNS = ["transfer.*", "*.height", "*", "w*m.*f*", "message.module", "nothing.*", "*a*t*", "*.*.*"]


def _path_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    txs = _without_empty(W.order_txs(spark, folder))
    return X.upsert_paths(X.path_keys(txs), spark.createDataFrame([], "path_id long, path_text string")).found


@query
def wildcard_paths(spark, folder):
    """Patterns resolved to paths: first of transfers alone, then with all other paths and patterns."""
    paths = _path_dictionary(spark, folder).select(F.col("path_text").alias("path"))
    patterns = spark.createDataFrame([(p,) for p in _PATTERNS], "pattern string")
    first = paths.where(F.col("path").startswith("transfer."))
    resolved = resolve(patterns.where("pattern LIKE '%t%'"), first)
    return extend(resolved, patterns, first, paths.where(~F.col("path").startswith("transfer.")))


@query
def wildcard_facts(spark, folder):
    """Facts under `*.re*`, chosen by path ids."""
    txs = _without_empty(W.order_txs(spark, folder))
    attrs = A.explode_attributes(txs)
    paths = _path_dictionary(spark, folder)
    values = _value_dictionary(attrs)
    facts = _facts(attrs, paths, values)
    patterns = spark.createDataFrame([("*.re*",)], "pattern string")
    resolved = resolve(patterns, paths.select(F.col("path_text").alias("path")))
    chosen = facts_under(facts, paths, resolved, "*.re*")
    return X.decode_facts(chosen, paths, values).select("tx_id", "path", "value")


@query
def stream_fan_out_table(spark, folder):
    """A filter for every user, on the stream: their dear or their many-sided clicks."""
    user = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    none = F.lit(None).cast("array<string>")

    def condition(clause: int, number: int, path: str, op: str, arg: Column) -> Column:
        return F.struct(
            F.lit(clause).alias("clause"),
            F.lit(number).alias("cond_no"),
            F.lit(path).alias("path"),
            F.lit(op).alias("op"),
            arg.alias("arg"),
            none.alias("members"),
        )

    each = F.array(
        condition(0, 0, "message.sender", "=", user),
        condition(0, 1, "transfer.amount", ">", F.lit("10000uscrt")),
        condition(1, 0, "message.sender", "=", user),
        condition(1, 1, "wasm.k", ">=", F.lit("95")),
        condition(1, 2, "message.action", "!=", F.lit("error")),
    )
    users = W.stored_events(spark, folder).select("user_id").distinct()
    held = users.select(user.alias("sub_id"), F.inline(each))
    sink = scratch(spark, "held")
    C.stream_fan_out_table(_live(spark, folder), held, sink, scratch(spark, "held-checkpoint")).awaitTermination()
    return spark.read.parquet(sink).select("tx_id", "sub_id")


@query
def stream_raw_fan_out(spark, folder):
    """Raw messages straight to subscribers, before they have ids; one filter is broken."""
    held = [
        ("clicks", 0, 0, "message.action", "=", "click", None),
        ("dear", 0, 0, "transfer.amount", ">", "10000uscrt", None),
        ("broken", 0, 0, "transfer.amount", ">", "abc", None),
        ("half broken", 0, 0, "message.action", "=", "click", None),
        ("half broken", 1, 0, "message.action", "~", "click", None),
    ]
    raw = W.event_messages(W.live_events(spark, folder)).withColumnRenamed("ts", "arrived")
    txs, _ = G.route_by_type(G.parse_messages(raw)[0])
    rows = G.transaction_rows(txs, F.col("arrived"))
    sink, checkpoint = scratch(spark, "raw"), scratch(spark, "raw-checkpoint")
    C.stream_fan_out_table(
        rows, lambda session: session.createDataFrame(held, C.CONDITIONS_DDL), sink, checkpoint, "tx_hash", whole=True
    ).awaitTermination()
    return spark.read.parquet(sink).select("tx_hash", "height", "sub_id")


@query
def dedupe_by_hash(spark, folder):
    txs = _clicks(spark, folder)
    copies = txs.withColumn("tx_id", F.col("tx_id") + 1_000_000_000)
    return L.dedupe_by_hash(copies.unionByName(txs)).select("tx_id", "tx_hash", "height")


# --- streams: run to the end of the input, then read the sink ----------------


def _run(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    sink, checkpoint = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.parquet(sink)


def _live(spark: SparkSession, folder: str) -> DataFrame:
    return W.event_txs(W.live_events(spark, folder))


def _live_filter() -> Column:
    return P.attr_gt("transfer.amount", "5000uscrt") & P.attr_ne("message.action", "error")


@query
def stream_filter(spark, folder):
    return _run(L.stream_filter(_live(spark, folder), _live_filter()), "filter").select("tx_id", "tx_hash", "height")


def _live_subscriptions() -> dict[str, Column]:
    return {
        "rich": _live_filter(),
        "clicks": P.attr_eq("message.action", "click"),
        "clicks again": P.attr_eq("message.action", "click"),
        "any k": P.attr_ge("wasm.k", 90) | P.attr_lt("wasm.k", 3),
    }


@query
def stream_fan_out(spark, folder):
    delivered = L.fan_out(_live(spark, folder), _live_subscriptions())
    return _run(delivered, "fan-out").select("tx_id", "sub_id")


@query
def stream_match_counts(spark, folder):
    counts = L.match_counts(L.fan_out(_live(spark, folder), _live_subscriptions()))
    return _run_complete(counts, "counts")


def _run_complete(totals: DataFrame, name: str) -> DataFrame:
    """Run a complete-mode aggregate; the last batch holds the totals."""
    spark = totals.sparkSession
    sink = scratch(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    writer = totals.writeStream.outputMode("complete").foreachBatch(keep)
    writer = writer.option("checkpointLocation", scratch(spark, f"{name}-checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


@query
def stream_heights(spark, folder):
    raw = W.block_messages(W.live_events(spark, folder))
    return _run_complete(N.stream_heights(raw, "arrival"), "heights")


@query
def stream_dedupe(spark, folder):
    """The stream twice over, each hash once."""
    twice = _live(spark, folder).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    once = L.dedupe_by_hash(twice, "40 days")
    return _run(once, "dedupe").select("tx_id", "tx_hash")


@query
def backfill_then_live(spark, folder):
    """History up to the 20th, live from the 10th on; the overlap arrives once."""
    txs = _clicks(spark, folder)
    history = txs.where(F.col("ts") < _at("2024-01-20"))
    live = _live(spark, folder).where(F.col("ts") >= _at("2024-01-10"))
    sink = scratch(spark, "backfill")
    L.backfill_then_live(history, live, _live_filter(), sink, scratch(spark, "backfill-checkpoint")).awaitTermination()
    return spark.read.parquet(sink).select("tx_id", "tx_hash", "height")


@query
def backfill_quiet(spark, folder):
    """Stored matches are delivered although the stream has no rows."""
    history = _clicks(spark, folder).where(F.col("ts") < _at("2024-01-20"))
    live = _live(spark, folder).where("tx_id < 0")
    sink = scratch(spark, "quiet")
    L.backfill_then_live(history, live, _live_filter(), sink, scratch(spark, "quiet-checkpoint")).awaitTermination()
    return spark.read.parquet(sink).select("tx_id", "tx_hash", "height")


def _index_live(spark: SparkSession, folder: str) -> str:
    root = scratch(spark, "store")
    raw = W.event_messages(W.live_events(spark, folder)).withColumnRenamed("ts", "arrived")
    N.stream_index(raw, root, scratch(spark, "store-checkpoint"), F.col("arrived")).awaitTermination()
    return root


@query
def stream_index(spark, folder):
    root = _index_live(spark, folder)
    tables = [store.read_table(spark, root, t) for t in ("transactions", "facts", "paths", "values")]
    txs, facts, paths, values = tables
    decoded = X.decode_facts(facts, paths, values)
    return decoded.join(txs.select("tx_id", "tx_hash"), "tx_id").select("tx_id", "tx_hash", "path", "value")


@query
def stream_index_batches(spark, folder):
    """The same stream in three micro-batches; later ones find known paths and values."""
    raw = W.event_messages(W.stored_events(spark, folder)).withColumnRenamed("ts", "arrived")
    parts, root = scratch(spark, "messages"), scratch(spark, "store")
    raw.repartition(3, "tx_id").write.parquet(parts)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    N.stream_index(stream, root, scratch(spark, "batches-checkpoint"), F.col("arrived")).awaitTermination()
    txs, facts, paths, values = [store.read_table(spark, root, t) for t in ("transactions", "facts", "paths", "values")]
    decoded = X.decode_facts(facts, paths, values)
    return decoded.join(txs.select("tx_id", "tx_hash"), "tx_id").select("tx_hash", "path", "value")


def _index_merged(spark: SparkSession, folder: str) -> str:
    """The stored stream in five micro-batches, merged after each second one."""
    raw = W.event_messages(W.stored_events(spark, folder)).withColumnRenamed("ts", "arrived")
    parts, root = scratch(spark, "messages"), scratch(spark, "store")
    raw.repartition(5, "tx_id").write.parquet(parts)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    checkpoint = scratch(spark, "merged-checkpoint")
    N.stream_index(stream, root, checkpoint, F.col("arrived"), merge_every=2).awaitTermination()
    return root


@query
def merge_batches(spark, folder):
    """Facts decoded from a store of merged and later batches."""
    root = _index_merged(spark, folder)
    txs, facts, paths, values = [store.read_table(spark, root, t) for t in ("transactions", "facts", "paths", "values")]
    decoded = X.decode_facts(facts, paths, values)
    return decoded.join(txs.select("tx_id", "tx_hash"), "tx_id").select("tx_hash", "path", "value")


@query
def height_range_stored(spark, folder):
    """Attributes of a range of heights; of merged batches only its days are read."""
    attrs = store.read_heights(spark, _index_merged(spark, folder), "attrs", 10, 12)
    return attrs.groupBy("height", "path").agg(F.count("*").alias("n"))


@query
def append_facts(spark, folder):
    """Links as stored, with the ids of their batch."""
    return store.read_table(spark, _index_live(spark, folder), "facts").select("tx_id", "path_id", "value_id")


@query
def stream_rejected(spark, folder):
    rejected = store.read_table(spark, _index_live(spark, folder), "rejected")
    return rejected.groupBy("reason").agg(F.count("*").alias("n"))


@query
def stream_retention(spark, folder):
    """The store after the expiry runs of its stream."""
    root = _index_live(spark, folder)
    N.stream_retention(
        spark, root, scratch(spark, "retention-checkpoint"), now=_at("2024-01-31"), every=None
    ).awaitTermination()
    kept = store.read_table(spark, root, "attrs")
    return kept.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("tx_id").alias("txs"))
