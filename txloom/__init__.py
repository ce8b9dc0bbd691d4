"""Filters and indexes over transaction event data, on Spark."""

from txloom.functions.predicates import (
    all_of,
    any_of,
    attr_eq,
    attr_exists,
    attr_ge,
    attr_gt,
    attr_in,
    attr_includes,
    attr_le,
    attr_like,
    attr_lt,
    attr_ne,
    attr_not_exists,
    attr_not_in,
    attr_not_includes,
    attr_not_like,
    path_wildcard,
)
from txloom.operators.delivery import deliver_batches, height_range, list_attributes, newest_first, page
from txloom.plans.search import match_count, result_table, search_indexed, search_txs
from txloom.sources.messages import parse_messages, read_messages, stream_kafka, stream_messages
from txloom.sources.merging import merge_batches
from txloom.sources.store import expire_store, index_batch, read_heights, read_table
from txloom.streaming.conditions import fan_out_table, stream_fan_out_table
from txloom.streaming.indexing import stream_heights, stream_index, stream_retention
from txloom.streaming.live import backfill_then_live, dedupe_by_hash, fan_out, match_counts, stream_filter

__all__ = [
    "all_of",
    "any_of",
    "attr_eq",
    "attr_exists",
    "attr_ge",
    "attr_gt",
    "attr_in",
    "attr_includes",
    "attr_le",
    "attr_like",
    "attr_lt",
    "attr_ne",
    "attr_not_exists",
    "attr_not_in",
    "attr_not_includes",
    "attr_not_like",
    "backfill_then_live",
    "dedupe_by_hash",
    "deliver_batches",
    "expire_store",
    "merge_batches",
    "read_heights",
    "fan_out",
    "fan_out_table",
    "height_range",
    "index_batch",
    "list_attributes",
    "match_count",
    "match_counts",
    "newest_first",
    "page",
    "parse_messages",
    "path_wildcard",
    "read_messages",
    "read_table",
    "result_table",
    "search_indexed",
    "search_txs",
    "stream_fan_out_table",
    "stream_filter",
    "stream_heights",
    "stream_index",
    "stream_kafka",
    "stream_messages",
    "stream_retention",
]
