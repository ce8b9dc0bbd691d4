"""Table shapes, message schema and operating limits.

Everything else in the package is written against the column names given here.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# A value is kept as text when it has fewer UTF-16 units than this.
TEXT_LIMIT = 8191
# Transactions per delivered search batch.
SEARCH_BATCH = 256
# Most paths one listing call may return.
LISTING_LIMIT = 1024
# Age after which a transaction is removed, and how often that is checked.
RETENTION_HOURS = 14 * 24
RETENTION_PERIOD = "1 hour"
# Longest attribute path.
PATH_LIMIT = 512
# Paths which the listing leaves out.
UNLISTED_PREFIX = "wasm."
# Paths which never become columns of a result table.
IMPLIED_PATHS = ("tm.event", "tx.hash", "tx.height")
# Types of upstream messages.
TX_TYPE = "tendermint/event/Tx"
BLOCK_TYPE = "tendermint/event/NewBlock"
# An integer with an optional unit; shared by Spark (Java) and Python.
QUANTITY_PATTERN = (
    r"^([-+]?\d{1,78})"
    r"([a-z\d_]{1,16}|ibc/[A-F0-9]{64}|factory/\S{0,120})?\z"
)
# ----------------------------------------------------------------------------

EVENT_MAP = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

_ATTRIBUTE = "struct<key:string,value:string,index:boolean>"
_EVENTS = f"array<struct<type:string,attributes:array<{_ATTRIBUTE}>>>"

# The `result` of one executed transaction as it arrives (numbers as strings).
MESSAGE_RESULT_DDL = (
    "struct<code:int,codespace:string,info:string,log:string,gas_wanted:string,"
    f"gas_used:string,data:string,events:{_EVENTS}>"
)

# JSON-RPC envelope. Transaction and block messages share it; the part that
# does not apply is null.
MESSAGE_DDL = (
    "result struct<"
    "data:struct<type:string,value:struct<"
    f"TxResult:struct<height:string,index:int,tx:string,result:{MESSAGE_RESULT_DDL}>,"
    "block:struct<header:struct<height:string,time:string>>>>,"
    "events:map<string,array<string>>>,"
    "error struct<code:int,message:string,data:string>"
)

# One entry of a transaction log: its events, and (separately) everything else.
LOG_DDL = (
    "array<struct<events:array<struct<type:string,"
    "attributes:array<struct<key:string,value:string>>>>>>"
)
LOG_OTHER_DDL = "array<map<string,string>>"

TX_DDL = (
    "tx_id long, height long, tx_hash string, ts timestamp, tx_bytes binary, tx_index int, "
    "result struct<code:int,codespace:string,info:string,log:string,gas_wanted:long,"
    f"gas_used:long,data:binary,events:{_EVENTS}>, "
    "events map<string,array<string>>"
)
ATTRS_DDL = (
    "tx_id long, height long, ts timestamp, path string, val_ord int, value string, "
    "qty_text string, qty_key string, unit string, value_hash string"
)
PATHS_DDL = "path_id long, path_text string"
VALUES_DDL = (
    "value_id long, value_hash string, qty_text string, qty_key string, unit string, "
    "value_text string, value_bytes binary"
)
FACTS_DDL = "tx_id long, path_id long, value_id long, ts timestamp"
