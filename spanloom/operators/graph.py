"""Operators that take rounds: greedy chains by pointer doubling, greedy matching, connected components.

Every round is a join whose result is written to the checkpoint folder, so the plan stays short and a lost
executor costs one round. No group is ever gathered. What a round leaves is held in as many partitions as its rows fill: a few
thousand edges dealt over hundreds of them would write far more in file headers than in edges, once an exchange and round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS_A_TASK = 10_000  # edges of a round that are worth a task of their own; adaptive plans, where they are on, hardly make smaller ones


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """The same rows in no more partitions than so many rows fill."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def chain(nodes: DataFrame, keys: Sequence[str], node: str, nxt: str, first: str) -> DataFrame:
    """The nodes a walk visits that starts at every ``first`` node and always steps to ``nxt``.

    A greedy fold such as "start a new group once it is full" visits the group starts in this way. Pointer
    doubling finds all of them in about log2(longest walk) rounds.
    """
    keys = list(keys)
    at = [*keys, node]
    nodes = cut_lineage(nodes.select(*at, F.col(nxt).alias("__to"), F.col(first).alias("__first")))
    jump = nodes.where(F.col("__to").isNotNull()).select(*at, "__to")
    reached = nodes.where("__first").select(*at).distinct()
    held = reached.count()
    while True:
        step = reached.join(jump, at).select(*keys, F.col("__to").alias(node))
        reached = cut_lineage(reached.unionByName(step).distinct())
        now = reached.count()
        if now == held:
            return reached
        held = now
        ahead = jump.select(*keys, F.col(node).alias("__to"), F.col("__to").alias("__to2"))
        jump = cut_lineage(jump.join(ahead, [*keys, "__to"]).select(*at, F.col("__to2").alias("__to")))


def greedy_match(edges: DataFrame, left: str, right: str, weight: str) -> DataFrame:
    """One-to-one pairs, heaviest first (ties by left then right), each side used once.

    An edge that is the best of both its ends is in the greedy matching whatever else is; taking all of
    those, dropping their neighbours and going on gives exactly the sequential result.
    """
    open_edges = cut_lineage(edges.where(F.col(weight) > 0).select(left, right, weight))
    rank = F.struct((-F.col(weight)).alias("w"), F.col(left), F.col(right))
    matched: DataFrame | None = None
    while not open_edges.isEmpty():
        by_left = open_edges.groupBy(left).agg(F.min(rank).alias("__l"))
        by_right = open_edges.groupBy(right).agg(F.min(rank).alias("__r"))
        best = by_left.select("__l").join(by_right.select(F.col("__r").alias("__l")), "__l")
        best = cut_lineage(best.select(F.col(f"__l.{left}").alias(left), F.col(f"__l.{right}").alias(right),
                                       (-F.col("__l.w")).alias(weight)))
        matched = best if matched is None else matched.unionByName(best)
        open_edges = cut_lineage(open_edges.join(best.select(left), left, "left_anti").join(
            best.select(right), right, "left_anti"))
    return matched if matched is not None else open_edges


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components as (node, component), the component named by its smallest node.

    Alternating large-star and small-star rounds: every round either links neighbours to the smallest
    neighbour or flattens, which takes a logarithmic number of rounds even on long paths, where plain
    label propagation takes one round a step.
    """
    e = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    held = e.count()
    e = _packed(e, held)
    nodes = cut_lineage(e.select(F.explode(F.array("u", "v")).alias("node")).distinct().transform(_packed, 2 * held))
    e = e.where("u <> v")

    def signature(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = signature(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(_packed(_packed(large.where("u <> v"), held).distinct(), held))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            low.select("u", F.col("m").alias("v")))
        small = _packed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), 2 * held)
        e = cut_lineage(_packed(small.distinct(), held))
        now = signature(e)
        if now == before:
            break
        before = now
    return nodes.join(e.select(F.col("u").alias("node"), "v"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component"))
