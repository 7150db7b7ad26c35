"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.skew import dealt_join, hot_keys
from larkspan.session import discard, materialize


def _least_of(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """((a, m, many): each a's least b and number of b, the hot ones among a)."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("many")), "least")
    return least, hot_keys(least, ["a"], total)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
    return row.n, row.h


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node reachable.

    Each step is a grouped minimum and a join, written to the shared folder;
    nothing but a row count, a checksum and hot keys reaches the driver. The edge count
    never grows beyond the input's plus one for each node. Edges with a null
    end or equal ends are ignored. A node with a large share of the edges is
    dealt over several parts.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first, hot = _least_of(both, 2 * state[0])
        large = dealt_join(both, first.select("a", F.least("a", "m").alias("m")), hot, ["a"], "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "large")
        least, hot = _least_of(large, 2 * state[0])
        small = dealt_join(large, least.select("a", "m"), hot, ["a"], "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = small.union(least.select("a", F.col("m").alias("b")))
        now = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        now = materialize(now, "edges")
        before, state = state, _state(now)
        discard(edges, first, large, least)
        edges = now
        if before == state:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
