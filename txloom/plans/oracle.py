"""The registered queries in SQL, over the same Parquet tables."""

from __future__ import annotations

from txloom.model import SEARCH_BATCH, TEXT_LIMIT, TX_TYPE

QTY = r"^([-+]?\d{1,78})([a-z\d_]{1,16}|ibc/[A-F0-9]{64}|factory/\S{0,120})?$"
ANY = r"[^\n\r\x{2028}\x{2029}]*"
HUGE = "1000" + "7" * 40
IBC = "'ibc/' || upper(sha256('R'))"
DAY = "date_diff('day', DATE '{0}', CAST({1} AS DATE)) + 1"

_O, _L = "o_orderkey", "l_orderkey"
_HEIGHT = DAY.format("1995-01-01", "o_orderdate")


def _part(key: str, path: str, value: str, source: str) -> str:
    return f"SELECT {key} AS tx_id, '{path}' AS path, {value} AS value FROM {source}"


ATTRS = "attrs AS (\n" + "\nUNION ALL ".join(
    [
        _part(_O, "tm.event", "'Tx'", "orders"),
        _part(_O, "tx.height", f"CAST({_HEIGHT} AS VARCHAR)", "orders"),
        _part(_O, "tx.hash", "upper(sha256(CAST(o_orderkey AS VARCHAR)))", "orders"),
        _part(
            _O,
            "message.module",
            "CASE o_orderstatus WHEN 'F' THEN 'compute' WHEN 'O' THEN 'bank' WHEN 'P' THEN 'gov' END",
            "orders",
        ),
        _part(_O, "message.sender", "'addr' || o_custkey", "orders"),
        _part(_O, "message.priority", "o_orderpriority", "orders"),
        _part(
            _L,
            "transfer.amount",
            "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) || "
            f"CASE l_returnflag WHEN 'A' THEN 'uscrt' WHEN 'N' THEN 'uatom' ELSE {IBC} END",
            "lineitem",
        ),
        _part(_L, "transfer.recipient", "'supp' || l_suppkey", "lineitem"),
        _part(_L, "transfer.huge", "CAST(l_partkey AS VARCHAR) || repeat('7', 40)", "lineitem"),
        _part(_L, "wasm.quantity", "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)", "lineitem"),
        _part(_L, "wasm.refund", "CAST(l_linenumber AS VARCHAR)", "lineitem WHERE l_discount >= 0.09"),
        _part("doc_id", "memo.text", "text", "documents"),
    ]
) + ")"

# Attributes of orders only: a document without an order is no transaction.
OWN = "own AS (SELECT a.* FROM attrs a JOIN orders ON o_orderkey = a.tx_id)"

TX = (
    f"tx AS (SELECT o_orderkey AS tx_id, {_HEIGHT} AS height, o_orderdate AS ts, "
    "upper(sha256(CAST(o_orderkey AS VARCHAR))) AS tx_hash FROM orders)"
)

CLICKS = (
    f"clicks AS (SELECT event_id AS tx_id, {DAY.format('2024-01-01', 'ts')} AS height, ts, "
    "upper(sha256(CAST(event_id AS VARCHAR))) AS tx_hash, event_type AS action, "
    "'user' || user_id AS sender, "
    "CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || 'uscrt' AS amount, "
    "CAST(round(value * 100) AS BIGINT) AS cents, "
    "json_extract_string(props, '$.k') AS k FROM events)"
)

CLICK_ATTRS = "click_attrs AS (\n" + "\nUNION ALL ".join(
    f"SELECT tx_id, tx_hash, ts, action, '{path}' AS path, {value} AS value FROM clicks"
    for path, value in [
        ("tm.event", "'Tx'"),
        ("tx.height", "CAST(height AS VARCHAR)"),
        ("tx.hash", "tx_hash"),
        ("message.action", "action"),
        ("message.sender", "sender"),
        ("transfer.amount", "amount"),
        ("wasm.k", "k"),
    ]
) + ")"

# Clicks of these types arrive as transaction messages.
GOOD = "action NOT IN ('error', 'signup')"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def number(column: str = "value", group: int = 1) -> str:
    return f"regexp_extract({column}, '{QTY}', {group})"


def compare(op: str, digits: str, unit: str) -> str:
    return (
        f"CASE WHEN {number()} <> '' AND {number(group=2)} = {unit} "
        f"THEN CAST({number()} AS BIGNUM) {op} CAST('{digits}' AS BIGNUM) ELSE false END"
    )


def some(path: str, condition: str) -> str:
    """Some value under the path meets the condition (SQL on `value`)."""
    return f"EXISTS (SELECT 1 FROM attrs a WHERE a.tx_id = t.tx_id AND a.path = '{path}' AND ({condition}))"


def flagged(conditions: dict[str, tuple[str, str]], where: str, columns: str = "tx_id") -> str:
    """Transactions by a combination of conditions (path, SQL on `value`), in one pass."""
    flags = ", ".join(f"bool_or(path = '{p}' AND ({c})) AS {n}" for n, (p, c) in conditions.items())
    paths = ", ".join(f"'{p}'" for p in dict.fromkeys(p for p, _ in conditions.values()))
    held = ", ".join(f"coalesce({n}, false) AS {n}" for n in conditions)
    return (
        _with(ATTRS, TX, f"flags AS (SELECT tx_id, {flags} FROM attrs WHERE path IN ({paths}) GROUP BY tx_id)")
        + f"SELECT {columns} FROM (SELECT tx.*, {held} FROM tx LEFT JOIN flags USING (tx_id)) WHERE {where}"
    )


def matching(where: str, columns: str = "tx_id") -> str:
    return _with(ATTRS, TX) + f"SELECT {columns} FROM tx t WHERE {where}"


NO_UNIT = "''"
LONGEST = "(SELECT text FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1)"
RICH = some("transfer.amount", compare(">", "5000000", "'uscrt'"))
LIVE = "cents > 5000 AND action <> 'error'"

SQL: dict[str, str] = {}

# --- predicates -------------------------------------------------------------

_PREDICATES = {
    "attr_exists": some("wasm.refund", "true"),
    "attr_not_exists": "NOT " + some("wasm.refund", "true"),
    "attr_eq": some("message.module", "value = 'compute'"),
    "attr_ne": some("transfer.recipient", "value <> 'supp1'"),
    "attr_gt": RICH,
    "attr_lt": some("transfer.huge", compare("<", HUGE, "''")),
    "attr_ge": some("wasm.quantity", compare(">=", "48", "''")),
    "attr_le": some("transfer.amount", compare("<=", "200000", "'uatom'")),
    "attr_includes": some("memo.text", "contains(value, 'la')"),
    "attr_not_includes": some("memo.text", "NOT contains(value, 'la')"),
    "attr_like": some("message.sender", f"regexp_matches(value, '^addr1[^\\n]3{ANY}$')"),
    "attr_not_like": some("message.priority", f"NOT regexp_matches(value, '^{ANY}H$')"),
    "attr_in": some("message.sender", "value IN ('addr12', 'addr700', 'addr1', '5')"),
    "attr_not_in": some("wasm.quantity", "value NOT IN ('1', '2', '3')"),
    "path_wildcard": (
        "EXISTS (SELECT 1 FROM attrs a WHERE a.tx_id = t.tx_id AND starts_with(a.path, 'wasm.') AND value = '3')"
    ),
    "attr_like_lines": some("memo.text", f"regexp_matches(value, '^{ANY}la{ANY}$')"),
    "unit_matches": some("transfer.amount", f"{number(group=2)} = 'uatom'"),
    "attr_eq_long": some("memo.text", f"value = {LONGEST}"),
    "attr_ne_long": some("memo.text", f"value <> {LONGEST}"),
}
for _name, _where in _PREDICATES.items():
    SQL[_name] = SQL[f"{_name}_indexed"] = matching(_where)

_TREE = (
    {
        "bank": ("message.module", "value = 'bank'"),
        "dear": ("transfer.amount", compare(">", "9000000", "'uscrt'")),
        "few": ("wasm.quantity", compare("<=", "2", "''")),
        "paid": ("transfer.amount", "true"),
    },
    "bank AND (dear OR few OR NOT paid)",
)

SQL |= {
    "attr_in_table": matching(
        some("transfer.recipient", "value IN (SELECT 'supp' || s_suppkey FROM supplier WHERE s_acctbal > 5000)")
    ),
    "all_of": flagged(
        {
            "compute": ("message.module", "value = 'compute'"),
            "rich": ("transfer.amount", compare(">", "5000000", "'uscrt'")),
            "refund": ("wasm.refund", "true"),
        },
        "compute AND rich AND refund",
    ),
    "any_of": matching(
        some("message.module", "value = 'gov'")
        + " OR "
        + some("transfer.amount", compare("<", "150000", "'uatom'"))
        + " OR "
        + some("message.sender", "value = 'addr7'")
    ),
    "mixed_tree": flagged(*_TREE),
    "tx_outer_flags": flagged(*_TREE, "tx_id, height"),
    "tx_semijoin": matching(some("wasm.quantity", compare(">=", "48", "''")), "tx_id, tx_hash"),
    "tx_antijoin": matching("NOT " + some("transfer.amount", "true"), "tx_id, tx_hash"),
    "distinct_transactions": matching(some("transfer.amount", "true")),
    "match_count": matching(some("wasm.quantity", compare(">=", "48", "''")), "count(*) AS matches"),
}

# --- values and attributes --------------------------------------------------

_LONG = (
    f"(length(value) + length(regexp_replace(value, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) >= {TEXT_LIMIT}"
)
_MAGNITUDE = "ltrim(q, '+-0')"
_BODY = f"lpad(CAST(length({_MAGNITUDE}) AS VARCHAR), 2, '0') || {_MAGNITUDE}"
_HASH = "base64(unhex(sha256(value)))"

SQL |= {
    "explode_attributes": _with(ATTRS, OWN)
    + "SELECT tx_id, path, row_number() OVER (PARTITION BY tx_id, path ORDER BY value) - 1 AS val_ord, value FROM own",
    "build_event_map": _with(ATTRS, OWN)
    + "SELECT tx_id, path, string_agg(value, '|' ORDER BY value) AS joined FROM own GROUP BY tx_id, path",
    "parse_quantity": _with(ATTRS) + f"SELECT tx_id, path, {number()} AS qty_text, {number(group=2)} AS unit FROM attrs",
    "quantity_key": _with(ATTRS, f"n AS (SELECT DISTINCT {number()} AS q FROM attrs)")
    + f"""SELECT q AS qty_text, CASE WHEN starts_with(q, '-') AND {_MAGNITUDE} <> ''
    THEN '0' || translate({_BODY}, '0123456789', '9876543210') ELSE '1' || {_BODY} END AS qty_key
FROM n WHERE q <> ''""",
    "split_long_values": _with(ATTRS)
    + f"""SELECT tx_id, path, CASE WHEN {_LONG} THEN '' ELSE value END AS value_text,
    CAST(CASE WHEN {_LONG} THEN octet_length(encode(value)) ELSE -1 END AS BIGINT) AS n_bytes FROM attrs""",
    "value_fingerprint": _with(ATTRS) + f"SELECT DISTINCT value, {_HASH} AS value_hash FROM attrs",
    "restore_value": _with(ATTRS) + "SELECT tx_id, path, value FROM attrs",
    "tx_bytes_base64": "SELECT o_orderkey AS tx_id, base64(encode(o_orderpriority)) AS tx, o_orderpriority AS back FROM orders",
    "tx_hash": _with(TX) + "SELECT tx_id, tx_hash AS hash FROM tx",
    "explorer_link": """SELECT o_orderkey AS tx_id, 'https://explorer.example/' || split_part(o_orderpriority, '-', 1)
    || '/tx/' || upper(sha256(CAST(o_orderkey AS VARCHAR))) AS url FROM orders""",
    # The map of an order names every path, also those with an empty list.
    "distinct_paths": _with(ATTRS) + "SELECT DISTINCT path FROM attrs",
    "distinct_values": _with(ATTRS) + "SELECT DISTINCT value FROM attrs",
    "dedupe_values": _with(ATTRS, TX)
    + """SELECT t.tx_id, coalesce(string_agg(DISTINCT a.value, '|' ORDER BY a.value), '(none)') AS refunds
FROM tx t LEFT JOIN attrs a ON a.tx_id = t.tx_id AND a.path = 'wasm.refund' GROUP BY t.tx_id""",
}

# --- joins, dictionaries and ids --------------------------------------------

_DICTIONARIES = (
    "p AS (SELECT path, row_number() OVER (ORDER BY path) AS path_id FROM (SELECT DISTINCT path FROM attrs))",
    f"v AS (SELECT value, row_number() OVER (ORDER BY {_HASH}) AS value_id FROM (SELECT DISTINCT value FROM attrs))",
)
_RICH_ROWS = f"SELECT tx_id, path, value FROM attrs WHERE path = 'transfer.amount' AND {compare('>', '5000000', chr(39) + 'uscrt' + chr(39))}"

SQL |= {
    "matching_attributes": _with(ATTRS) + _RICH_ROWS,
    "matching_facts": _with(ATTRS) + _RICH_ROWS,
    # The sales of the unit decide; only rows of their transactions become attributes.
    "rehydrate": _with(
        """hit AS (SELECT DISTINCT l_orderkey AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE l_returnflag = 'A' AND CAST(round(l_extendedprice * 100) AS BIGINT) > 9000000)""",
        "hit_orders AS MATERIALIZED (SELECT o.* FROM orders o SEMI JOIN hit ON k = o_orderkey)",
        "hit_items AS MATERIALIZED (SELECT l.* FROM lineitem l SEMI JOIN hit ON k = l_orderkey)",
        "hit_texts AS MATERIALIZED (SELECT d.* FROM documents d SEMI JOIN hit ON k = doc_id)",
        ATTRS.replace("FROM orders", "FROM hit_orders")
        .replace("FROM lineitem", "FROM hit_items")
        .replace("FROM documents", "FROM hit_texts"),
    )
    + "SELECT tx_id, path, value FROM attrs",
    "encode_attributes": _with(ATTRS, *_DICTIONARIES)
    + "SELECT tx_id, path_id, value_id FROM attrs JOIN p USING (path) JOIN v USING (value)",
    "decode_facts": _with(ATTRS) + "SELECT tx_id, path, value FROM attrs",
    "insert_if_absent": _with(
        ATTRS,
        f"""d AS (SELECT value, {_HASH} AS value_hash,
    bool_or(starts_with(path, 'message.') OR starts_with(path, 'tx.')) AS known FROM attrs GROUP BY value)""",
    )
    + f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY known DESC, value_hash) AS value_id, value_hash,
    {number(group=2)} AS unit FROM d) WHERE value_id > (SELECT count(*) FROM d WHERE known)""",
    "union_new_existing": _with(
        ATTRS,
        f"""d AS (SELECT value, {_HASH} AS value_hash,
    bool_or(starts_with(path, 'message.') OR starts_with(path, 'memo.')) AS known,
    bool_or(NOT starts_with(path, 'memo.')) AS requested FROM attrs GROUP BY value)""",
        """n AS (SELECT value_hash, requested,
    row_number() OVER (ORDER BY known DESC, value_hash) AS value_id FROM d)""",
    )
    + "SELECT value_id, value_hash FROM n WHERE requested",
    "insert_paths": _with(
        ATTRS, OWN, "s AS (SELECT path, min(tx_id) AS first_tx FROM own GROUP BY path)"
    )
    + """SELECT CASE path WHEN 'tm.event' THEN 1 WHEN 'tx.hash' THEN 2 ELSE 2 + row_number() OVER (
    PARTITION BY path IN ('tm.event', 'tx.hash') ORDER BY first_tx, path) END AS path_id, path AS path_text FROM s""",
    "assign_ids": _with(TX)
    + "SELECT 1000 + row_number() OVER (ORDER BY height, tx_hash) AS new_id, tx_id, height FROM tx",
}

# --- search, order, pages ---------------------------------------------------

_RECORDS = (
    _with(CLICKS)
    + """SELECT tx_id, height, CAST(0 AS BIGINT) AS index, base64(encode(CAST(tx_id AS VARCHAR))) AS tx,
    tx_id AS gas_used, amount AS amounts, sender AS senders, 'rich clicks' AS query
FROM clicks WHERE cents > 5000 AND action = 'click'"""
)

SQL |= {
    "search_txs": _RECORDS,
    "search_indexed": _RECORDS,
    "search_facts": _RECORDS,
    "deliver_batches": _with(ATTRS, TX, f"m AS (SELECT tx_id FROM tx t WHERE {RICH})")
    + f"""SELECT tx_id, (row_number() OVER (ORDER BY tx_id) - 1) // {SEARCH_BATCH} AS batch_no,
    CAST((row_number() OVER (ORDER BY tx_id) - 1) // {SEARCH_BATCH} = (count(*) OVER () - 1) // {SEARCH_BATCH} AS BIGINT)
    AS finished FROM m""",
    "result_table": _with(ATTRS, TX)
    + f"""SELECT height, tx_hash AS hash, 'compute' AS module,
    (SELECT string_agg(DISTINCT value, '|' ORDER BY value) FROM attrs a
        WHERE a.tx_id = t.tx_id AND path = 'transfer.amount') AS amounts,
    coalesce((SELECT string_agg(DISTINCT value, '|' ORDER BY value) FROM attrs a
        WHERE a.tx_id = t.tx_id AND path = 'wasm.refund'), '(none)') AS refunds
FROM tx t WHERE {RICH} AND {some('message.module', "value = 'compute'")}""",
    "order_by_id": _with(TX) + "SELECT tx_id, tx_hash FROM tx ORDER BY tx_id",
    "newest_first": _with(TX) + "SELECT tx_id, tx_hash FROM tx ORDER BY tx_id DESC",
    "height_range": _with(TX) + "SELECT tx_id, height FROM tx WHERE height BETWEEN 500 AND 1500",
    "page": matching(some("message.module", "value = 'gov'"), "tx_id, height") + " ORDER BY tx_id LIMIT 100 OFFSET 50",
    "page_deep": _with(TX) + "SELECT tx_id, height FROM tx ORDER BY tx_id LIMIT 500 OFFSET 11000",
    "list_attributes": _with(
        ATTRS, OWN, "s AS (SELECT path, min(tx_id) AS first_tx FROM own GROUP BY path)"
    )
    + """SELECT path AS path_text FROM s WHERE NOT starts_with(path, 'wasm.')
ORDER BY first_tx, path LIMIT 6 OFFSET 1""",
}

# --- retention --------------------------------------------------------------

_KEPT = "ts >= TIMESTAMP '2024-01-31' - INTERVAL 336 HOURS"

SQL |= {
    "expire_transactions": _with(CLICKS) + f"SELECT tx_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM clicks WHERE {_KEPT}",
    "cascade_expire": _with(CLICKS, CLICK_ATTRS) + f"SELECT tx_id, path, value FROM click_attrs WHERE {_KEPT}",
    "stream_retention": _with(CLICKS, CLICK_ATTRS)
    + f"""SELECT path, count(*) AS n, count(DISTINCT tx_id) AS txs FROM click_attrs
WHERE {_KEPT} AND {GOOD} GROUP BY path""",
}

# --- messages ---------------------------------------------------------------

_SPAN = "SELECT arg_min(height, (ts, tx_id)) AS earliest, arg_max(height, (ts, tx_id)) AS latest FROM clicks"
_TRANSFER = """SELECT tx_id, 'transfer.sender' AS path, sender AS value, 1 AS indexed FROM clicks WHERE {0}
UNION ALL SELECT tx_id, 'transfer.amount', amount, 0 FROM clicks WHERE {0}"""

SQL |= {
    "parse_messages": _with(CLICKS)
    + f"""SELECT tx_id, CASE action WHEN 'error' THEN 'error' WHEN 'signup' THEN 'unreadable' ELSE 'ok' END AS kind,
    CASE action WHEN 'error' THEN sender WHEN 'signup' THEN '' ELSE '{TX_TYPE}' END AS detail FROM clicks""",
    "parse_messages_incomplete": _with(CLICKS)
    + """SELECT tx_id, CASE WHEN action = 'error' THEN 'error' WHEN action = 'signup' THEN 'unreadable'
    WHEN tx_id % 3 = 0 THEN 'no hash' WHEN tx_id % 3 = 1 THEN 'no height' ELSE 'ok' END AS kind FROM clicks""",
    "route_by_type": _with(CLICKS)
    + f"SELECT 'tx' AS kind, count(*) AS n FROM clicks WHERE {GOOD} UNION ALL SELECT 'block', count(*) FROM clicks",
    "block_headers": _with(CLICKS)
    + "SELECT tx_id AS event_id, height, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS time_s FROM clicks",
    "height_span": _with(CLICKS) + _SPAN,
    "stream_heights": _with(CLICKS) + _SPAN,
    "append_transactions": _with(CLICKS)
    + f"""SELECT 100 + row_number() OVER (ORDER BY height, tx_hash) AS new_id, height, tx_hash,
    CAST(tx_id AS VARCHAR) AS body, tx_id AS gas_used, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM clicks WHERE {GOOD}""",
    "flatten_result_events": _with(CLICKS, f"r AS ({_TRANSFER.format(GOOD)})")
    + "SELECT tx_id, path, value, CAST(indexed AS BIGINT) AS indexed FROM r",
    "log_attributes": _with(CLICKS, f"r AS ({_TRANSFER.format("action = 'click'")})") + "SELECT tx_id, path, value FROM r",
    "parse_logs": _with(CLICKS)
    + f"""SELECT tx_id, CAST(0 AS BIGINT) AS log_no, CAST(CASE action WHEN 'click' THEN 1 ELSE -1 END AS BIGINT) AS n_events,
    CASE action WHEN 'click' THEN '0' ELSE '' END AS msg_index,
    CASE action WHEN 'purchase' THEN 'paid by ' || sender ELSE '' END AS plain FROM clicks WHERE {GOOD}""",
}

# --- many filters and streams -----------------------------------------------


def _delivered(filters: dict[str, str], source: str) -> str:
    return "\nUNION ALL ".join(f"SELECT tx_id, '{s}' AS sub_id FROM {source} WHERE {f}" for s, f in filters.items())


_FAN_OUT = _delivered(
    {
        "rich": RICH,
        "rich again": RICH,
        "gov": some("message.module", "value = 'gov'"),
        "no refund": "NOT " + some("wasm.refund", "true"),
        "mixed": some("message.priority", f"regexp_matches(value, '^1{ANY}$')")
        + " AND NOT "
        + some("message.module", "value = 'bank'"),
    },
    "tx t",
)
_LIVE_FAN_OUT = _delivered(
    {
        "rich": LIVE,
        "clicks": "action = 'click'",
        "clicks again": "action = 'click'",
        "any k": "CAST(k AS BIGINT) >= 90 OR CAST(k AS BIGINT) < 3",
    },
    "clicks",
)

SQL |= {
    "fan_out": _with(ATTRS, TX) + _FAN_OUT,
    "match_counts": _with(ATTRS, TX, f"f AS ({_FAN_OUT})")
    + "SELECT sub_id, count(*) AS matches FROM f GROUP BY sub_id",
    "fan_out_table": _with(ATTRS, TX)
    + _delivered(
        {
            "rich": RICH
            + " OR ("
            + some("message.module", "value = 'gov'")
            + " AND "
            + some("wasm.quantity", compare("<=", "2", "''"))
            + ")",
            "no refund": "NOT " + some("wasm.refund", "true"),
            "other seller": some("transfer.recipient", "value <> 'supp1'")
            + " AND "
            + some("message.sender", "value IN ('addr1', 'addr2', 'addr700')"),
            "text": some("memo.text", "contains(value, 'la')")
            + " AND "
            + some("message.priority", f"regexp_matches(value, '^1{ANY}$')"),
            "odd": some("message.priority", f"NOT regexp_matches(value, '^{ANY}H$')")
            + " AND "
            + some("message.module", "value NOT IN ('gov', 'bank')")
            + " AND "
            + some("wasm.refund", "true"),
            "plain": some("memo.text", "NOT contains(value, 'la')"),
            "range": some("tx.height", compare(">=", "100", "''"))
            + " AND "
            + some("tx.height", compare("<", "300", "''")),
        },
        "tx t",
    ),
    "fan_out_many": _with(
        """s AS (SELECT DISTINCT l_orderkey AS tx_id, 'supp' || l_suppkey AS sub_id FROM lineitem
    JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey)""",
        """q AS (SELECT l_orderkey AS tx_id,
    bool_or(l_returnflag = 'N' AND round(l_extendedprice * 100) > 9000000) AS rich,
    bool_or(l_quantity <= 1) AND NOT bool_or(l_discount >= 0.09) AS few FROM lineitem GROUP BY l_orderkey)""",
    )
    + """SELECT sub_id, count(*) AS matches, CAST(sum(tx_id) AS BIGINT) AS sum_ids
FROM s JOIN q USING (tx_id) WHERE rich OR few GROUP BY sub_id""",
    "dedupe_by_hash": _with(CLICKS) + "SELECT tx_id, tx_hash, height FROM clicks",
    "stream_filter": _with(CLICKS) + f"SELECT tx_id, tx_hash, height FROM clicks WHERE {LIVE}",
    "backfill_then_live": _with(CLICKS) + f"SELECT tx_id, tx_hash, height FROM clicks WHERE {LIVE}",
    "backfill_quiet": _with(CLICKS)
    + f"SELECT tx_id, tx_hash, height FROM clicks WHERE {LIVE} AND ts < TIMESTAMP '2024-01-20'",
    "stream_raw_fan_out": _with(CLICKS)
    + f"""SELECT tx_hash, height, 'clicks' AS sub_id FROM clicks WHERE {GOOD} AND action = 'click'
UNION ALL SELECT tx_hash, height, 'dear' FROM clicks WHERE {GOOD} AND cents > 10000""",
    "stream_fan_out": _with(CLICKS) + _LIVE_FAN_OUT,
    "stream_match_counts": _with(CLICKS, f"f AS ({_LIVE_FAN_OUT})")
    + "SELECT sub_id, count(*) AS matches FROM f GROUP BY sub_id",
    "stream_fan_out_table": _with(CLICKS)
    + """SELECT tx_id, sender AS sub_id FROM clicks
WHERE cents > 10000 OR (CAST(k AS BIGINT) >= 95 AND action <> 'error')""",
    "stream_dedupe": _with(CLICKS) + "SELECT tx_id, tx_hash FROM clicks",
    "stream_rejected": _with(CLICKS)
    + """SELECT CASE action WHEN 'error' THEN 'error' ELSE 'unreadable' END AS reason, count(*) AS n
FROM clicks WHERE action IN ('error', 'signup') GROUP BY 1""",
}

# Ids of the stored tables: transactions in chain order, paths by first sight,
# values by fingerprint.
_STORED = (
    CLICKS,
    CLICK_ATTRS,
    f"g AS (SELECT tx_id AS click, row_number() OVER (ORDER BY height, tx_hash) AS new_id FROM clicks WHERE {GOOD})",
    "r AS (SELECT new_id, tx_hash, path, value FROM click_attrs JOIN g ON click = tx_id)",
)
SQL |= {
    "stream_index_batches": _with(*_STORED) + "SELECT tx_hash, path, value FROM r",
    "merge_batches": _with(*_STORED) + "SELECT tx_hash, path, value FROM r",
    "height_range_stored": _with(CLICKS, CLICK_ATTRS)
    + f"""SELECT height, path, count(*) AS n FROM click_attrs JOIN (SELECT tx_id, height FROM clicks) USING (tx_id)
WHERE {GOOD} AND height BETWEEN 10 AND 12 GROUP BY height, path""",
    "stream_index": _with(*_STORED) + "SELECT new_id AS tx_id, tx_hash, path, value FROM r",
    "append_facts": _with(
        *_STORED,
        """p AS (SELECT path, row_number() OVER (ORDER BY first_tx, path) AS path_id
    FROM (SELECT path, min(new_id) AS first_tx FROM r GROUP BY path))""",
        f"v AS (SELECT value, row_number() OVER (ORDER BY {_HASH}) AS value_id FROM (SELECT DISTINCT value FROM r))",
    )
    + "SELECT new_id AS tx_id, path_id, value_id FROM r JOIN p USING (path) JOIN v USING (value)",
}

_WILD = {
    "three": ("three", "starts_with(path, 'wasm.') AND value = '3'"),
    "large": ("large", f"starts_with(path, 'wasm.') AND {compare('>', '48', NO_UNIT)}"),
    "refund": ("any", "ends_with(path, '.refund')"),
}
SQL["fan_out_table_wildcard"] = (
    _with(
        ATTRS,
        TX,
        "f AS (SELECT tx_id, bool_or(starts_with(path, 'wasm.')) AS wasm, bool_or(path = 'message.module' AND value = 'bank') AS bank, "
        + ", ".join(f"bool_or({c}) AS {n}" for n, (_, c) in _WILD.items())
        + " FROM attrs SEMI JOIN tx USING (tx_id) GROUP BY tx_id)",
    )
    + """SELECT tx_id, 'three' AS sub_id FROM f WHERE three
UNION ALL SELECT tx_id, 'none' FROM f WHERE NOT wasm
UNION ALL SELECT tx_id, 'large' FROM f WHERE large AND bank
UNION ALL SELECT tx_id, 'any' FROM f WHERE refund"""
)

_TOTALS = "SELECT sub_id, count(*) AS matches, CAST(sum(tx_id) AS BIGINT) AS sum_ids FROM ({0}) GROUP BY sub_id"
_SALES = """sales AS (SELECT l_orderkey AS tx_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_returnflag AS flag
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
_LIMITS = """limits AS (SELECT CAST(p_partkey AS VARCHAR) AS sub_id, p_partkey * 7919 % 300000 + 10200000 AS a,
    p_partkey * 104729 % 20000 + 90000 AS b, p_partkey * 611 % 300000 + 10200000 AS c,
    p_partkey * 353 % 30000 + 90000 AS d FROM part)"""

SQL |= {
    "fan_out_ranges": _with(_SALES, _LIMITS)
    + _TOTALS.format(
        """SELECT sub_id, tx_id FROM limits JOIN sales ON flag = 'N' AND cents > a
UNION SELECT sub_id, tx_id FROM limits JOIN sales ON flag = 'A' AND cents <= b
UNION (SELECT sub_id, tx_id FROM limits JOIN sales ON flag = 'A' AND cents >= c
    INTERSECT SELECT sub_id, tx_id FROM limits JOIN sales ON flag = 'N' AND cents < d)"""
    ),
    "fan_out_text": _with(
        "sold AS (SELECT DISTINCT l_orderkey AS tx_id, l_suppkey AS k FROM lineitem)",
    )
    + _TOTALS.format(
        """SELECT 'doc' || f.doc_id AS sub_id, m.doc_id AS tx_id
    FROM documents f JOIN documents m ON contains(m.text, substring(f.text, 20, 12))
    JOIN orders ON o_orderkey = m.doc_id WHERE length(f.text) >= 20
UNION SELECT 'doc' || f.doc_id, o_orderkey FROM documents f JOIN documents m ON m.text IS NOT NULL
    JOIN orders ON o_orderkey = m.doc_id WHERE length(f.text) < 20
UNION SELECT 'seller' || k, tx_id FROM sold JOIN supplier ON s_suppkey = k JOIN orders ON o_orderkey = tx_id
    WHERE substring(o_orderpriority, 2, 1) = '-'
UNION SELECT 'seller' || s_suppkey, o_orderkey FROM orders JOIN supplier ON o_custkey % 10 = 7
    AND ends_with('addr' || o_custkey, 'r' || s_suppkey || '7')"""
    ),
    "fan_out_wildcards_many": _with(
        """sold AS (SELECT DISTINCT l_orderkey AS tx_id, 'supp' || l_suppkey AS sub_id FROM lineitem)""",
        """q AS (SELECT l_orderkey AS tx_id, bool_or(CAST(l_quantity AS INTEGER) > 45) AS large,
    bool_or(l_discount >= 0.09) AS refund FROM lineitem GROUP BY l_orderkey)""",
    )
    + _TOTALS.format(
        """SELECT 'supp' || s_suppkey AS sub_id, tx_id FROM supplier JOIN sold ON sub_id = 'supp' || s_suppkey
    JOIN orders ON o_orderkey = tx_id JOIN q USING (tx_id) WHERE large
UNION SELECT 'supp' || s_suppkey, o_orderkey FROM orders JOIN supplier ON s_suppkey = o_custkey
    LEFT JOIN q ON tx_id = o_orderkey WHERE NOT coalesce(refund, false)"""
    ),
    "wildcard_paths": _with(ATTRS, OWN)
    + "SELECT pattern, path FROM (SELECT unnest(["
    + ", ".join(f"'{p}'" for p in ["transfer.*", "*.height", "*", "w*m.*f*", "message.module", "nothing.*", "*a*t*", "*.*.*"])
    + r"""]) AS pattern) JOIN (SELECT DISTINCT path FROM own)
ON regexp_matches(path, '^' || replace(replace(pattern, '.', '\.'), '*', '[\w.:*-]*') || '$')""",
    "wildcard_facts": _with(ATTRS, OWN) + r"SELECT tx_id, path, value FROM own WHERE regexp_matches(path, '\.re') AND value IS NOT NULL",
}

SQL["search_substring"] = """SELECT doc_id AS tx_id, 'memo.text' AS path, sha256(text) AS value_sha256
FROM documents JOIN orders ON o_orderkey = doc_id WHERE contains(text, 'and the ')
UNION ALL SELECT l_orderkey, 'transfer.recipient', sha256('supp' || l_suppkey)
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE contains('supp' || l_suppkey, 'p1')"""
