"""Rules of plans and cuts: coverage, dependencies, structure, subsets, moments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import by_width, nxt, ordered_scan, prev, row_number, running_max

BLOCK = 10_000


def section_problems(sections: DataFrame, totals: DataFrame, candidates: DataFrame, key: str, first: str, last: str, n: str = "n") -> DataFrame:
    """Sections tile each file with nothing between or left over, and start only where a boundary was offered.

    ``first`` and ``last`` are positions from 1 in the file's order. One row per problem.
    """
    seen = ordered_scan(sections, [key], [first], by_width(first, BLOCK), {"__before": prev(F.col(last))})
    wanted = F.coalesce("__before", F.lit(0).cast("long")) + 1
    apart = seen.where(F.col(first) != wanted).select(key, F.col(first).alias("at"), F.lit("does not follow on").alias("problem"))
    offered = candidates.select(key, F.col("at").alias(first))
    unoffered = seen.where((F.col(first) > 1) & (F.col(first) == wanted)).join(offered, [key, first], "left_anti").select(
        key, F.col(first).alias("at"), F.lit("not offered").alias("problem"))
    ends = sections.groupBy(key).agg(F.max(last).alias("__last"))
    left = totals.join(ends, key, "left").where(F.coalesce("__last", F.lit(0).cast("long")) < F.col(n)).select(
        key, (F.coalesce("__last", F.lit(0).cast("long")) + 1).alias("at"), F.lit("left over").alias("problem"))
    return apart.unionByName(unoffered).unionByName(left)


def dependency_problems(uses: DataFrame, named: DataFrame, plan: str) -> DataFrame:
    """Facts relied on before anything establishes them.

    ``uses`` is (plan, pos, fact, use, hook) with use one of requires, ahead and establishes. A fact a hook
    relies on, or that is listed as coming ahead, is owed and has to be established at all.
    """
    first = uses.where("use = 'establishes'").groupBy(plan, "fact").agg(F.min("pos").alias("__told"))
    known = named.select(plan, "fact").distinct().withColumn("__named", F.lit(True))
    j = uses.join(first, [plan, "fact"], "left").join(known, [plan, "fact"], "left")
    told = F.col("__told") < F.col("pos")
    never = F.col("__told").isNull()
    unknown = F.col("__named").isNull()
    what = (F.when(unknown, "unknown fact")
            .when((F.col("use") == "requires") & ~F.col("hook") & (never | ~told), "relied on too early")
            .when((F.col("use") == "ahead") & told, "already established"))
    per = j.withColumn("problem", what).where("problem is not null").select(plan, "pos", "fact", "problem").distinct()
    owing = ((F.col("use") == "ahead") | ((F.col("use") == "requires") & F.col("hook"))) & ~unknown & never
    owed = j.where(owing).groupBy(plan, "fact").agg(F.min("pos").alias("pos")).select(plan, "pos", "fact", F.lit("never established later").alias("problem"))
    unmade = named.select(plan, "fact").distinct().join(first, [plan, "fact"], "left_anti").select(
        plan, F.lit(None).cast("long").alias("pos"), "fact", F.lit("nothing establishes it").alias("problem"))
    return per.unionByName(owed).unionByName(unmade)


def structure_problems(beats: DataFrame, plan: str, pos: str, role: str, ranks: Mapping[str, int], at_least: Mapping[str, int],
                       ends_on: Sequence[str], hook: str | None = None, in_order: bool = True) -> DataFrame:
    """Role rules of the ordered parts of a plan; each plan is judged by the first kind of rule it breaks:
    unsaid roles, foreign ones, then the rest."""
    r = F.col(role)
    at = F.struct(pos)
    counts = [F.sum((r == k).cast("long")).alias(f"__n_{n}") for n, k in enumerate(at_least)]
    per = beats.groupBy(plan).agg(
        F.sum(r.isNull().cast("long")).alias("__unsaid"), F.sum((~r.isin(*ranks)).cast("long")).alias("__foreign"),
        F.max_by(role, pos).alias("__end"), F.min_by(role, pos).alias("__start"),
        (F.sum((r == hook).cast("long")) if hook else F.lit(0)).alias("__hooks"), *counts)
    text = [F.when(F.col(f"__n_{n}") == 0, f"no {k}").when(F.col(f"__n_{n}") < need, f"too few {k}") for n, (k, need) in enumerate(at_least.items())]
    text.append(F.when(~F.col("__end").isin(*ends_on), "wrong ending"))
    if hook:
        text.append(F.when((F.col("__hooks") > 0) & (F.col("__start") != hook), f"{hook} not first"))
    sound = (F.col("__unsaid") == 0) & (F.coalesce("__foreign", F.lit(0)) == 0)
    said = F.when(F.col("__unsaid") > 0, F.array(F.lit("unsaid role"))).when(~sound, F.array(F.lit("foreign role"))).otherwise(
        F.filter(F.array(*text), lambda x: x.isNotNull()))
    out = per.select(plan, F.explode(said).alias("problem"))
    if in_order:
        rank = F.lit(None).cast("int")
        for k, n in ranks.items():
            rank = F.when(r == k, n).otherwise(rank)
        seen = ordered_scan(beats.withColumn("__rank", rank), [plan], [pos], by_width(pos, BLOCK), {"__top": running_max(F.col("__rank"), inclusive=False)})
        back = seen.where(F.col("__rank") < F.col("__top")).select(plan).distinct().join(per.where(sound).select(plan), plan, "left_semi")
        out = out.unionByName(back.select(plan, F.lit("out of order").alias("problem")))
    return out


def subset_cutdowns(units: DataFrame, plan: str, items: str, low: float, high: float, needs: Sequence[str], asks: str, most: int = 12) -> DataFrame:
    """Every set of whole items of a plan that keeps its roles, held against a window of lengths.

    ``items`` is an array of (role, seconds) of at most ``most`` entries, as plans of commercials are; the
    2^n sets are bit masks worked through inside the row, so nothing is shuffled. A longer plan is said to be.
    """
    n = F.size(items)
    item = F.col(items)

    def kept(mask, f):
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + F.when(
            F.getbit(mask, i) == 1, f(F.element_at(item, i + 1))).otherwise(0.0))

    def has(mask, role):
        return kept(mask, lambda x: (x["role"] == role).cast("double")) > 0
    wants_ask = F.exists(item, lambda x: x["role"] == asks)
    masks = F.expr(f"sequence(1L, shiftleft(1L, size(`{items}`)) - 1)")

    def ok(mask):
        cond = ~wants_ask | has(mask, asks)
        for role in needs:
            cond = cond & has(mask, role)
        return cond
    totals = F.transform(F.filter(masks, ok), lambda m: F.round(kept(m, lambda x: x["seconds"]), 6))
    small = (n > 0) & (n <= most)
    d = units.withColumn("__t", F.when(small, totals))
    return d.select(plan, F.size(F.filter("__t", lambda t: (t >= low) & (t <= high))).alias("fits"), F.array_min("__t").alias("shortest"),
                    F.array_max("__t").alias("longest"), (~small).alias("too_many"))


def with_repeats(rows: DataFrame, keys: Sequence[str], name: str, order: Sequence[str], chunk: Column, out: str = "id") -> DataFrame:
    """A stable id per row: its name, with ``#2``, ``#3`` on repeats in order."""
    seen = ordered_scan(rows, [*keys, name], order, chunk, {"__n": row_number()})
    return seen.withColumn(out, F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), F.col("__n").cast("string")))).drop("__n")


def ancestors(tree: DataFrame, node: str, parent: str) -> DataFrame:
    """Depth and topmost ancestor of every node of a parent-pointer table, by pointer doubling.

    A node whose way up never ends, because it comes back to itself or leads into such a ring, has a null root and depth. A parent that the
    table does not have is taken for a root.
    """
    from ..session import cut_lineage
    up = cut_lineage(tree.select(F.col(node).alias("n"), F.coalesce(parent, node).alias("to"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth")))
    rounds = up.count().bit_length() + 1  # by then every way that ends has ended
    for left in range(rounds, -1, -1):
        ahead = up.select(F.col("n").alias("to"), F.col("to").alias("to2"), F.col("depth").alias("d2"))
        step = cut_lineage(up.join(ahead, "to", "left").select(
            "n", F.coalesce("to2", "to").alias("to"), (F.col("depth") + F.coalesce("d2", F.lit(0).cast("long"))).alias("depth"), F.coalesce("d2", F.lit(0).cast("long")).alias("moved")))
        up = step.drop("moved")
        if not left or step.where("moved > 0").isEmpty():
            ends = F.col("moved") == 0
            return step.select(F.col("n").alias(node), F.when(ends, F.col("to")).alias("root"), F.when(ends, F.col("depth")).alias("depth"))


def move_problems(moves: DataFrame, tree: DataFrame, node: str, parent: str) -> DataFrame:
    """Moves of a folder into itself or below itself, found by walking every target up at once, one level a round.

    A second walk follows at half the pace: where the two meet, the way up is a ring that has been seen whole, and the walk ends.
    """
    from ..session import cut_lineage
    up = tree.select(F.col(node).alias("__at"), F.col(parent).alias("__up")).where("__up is not null")
    slow_up = up.select(F.col("__at").alias("__slow"), F.col("__up").alias("__slow_up"))
    walk = cut_lineage(moves.select(node, "target", F.col("target").alias("__at"), F.col("target").alias("__slow")))
    bad, slow = walk.where(F.col("__at") == F.col(node)).select(node, "target"), False
    while True:
        walk = walk.join(up, "__at").select(node, "target", F.col("__up").alias("__at"), "__slow")
        if slow:
            walk = walk.join(slow_up, "__slow").select(node, "target", "__at", F.col("__slow_up").alias("__slow"))
        walk, slow = cut_lineage(walk), not slow
        if walk.isEmpty():
            return bad.distinct()
        bad = bad.unionByName(walk.where(F.col("__at") == F.col(node)).select(node, "target"))
        walk = walk.where("__at <> __slow")
