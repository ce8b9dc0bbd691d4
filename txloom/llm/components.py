"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.llm.common import saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); a component is named by its least node.

    Each round links the neighbours of a node to the least of them, first the greater, then
    the smaller neighbours, until nothing changes; about log(nodes) rounds. The least
    neighbour is aggregated before the shuffle, so a node with very many is no burden.
    Repeated edges and loops do no harm; without edges there are no rows.
    """
    ordered = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = saved(ordered.distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        own = least.select("u", F.col("m").alias("v"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(own.unionByName(small).distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("u")).distinct()
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("component")))
