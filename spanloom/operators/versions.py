"""Diffs and merges of versions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .graph import components, greedy_match
from .intervals import coalesce_spans, covered, overlap_join, overlap_length, subtract_from_met
from .ordered import by_width, islands, last_value, ordered_scan, prev, row_number, running_sum, spread_join


def keyed_diff(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per added or removed key and per changed field, by one full outer join."""
    b = before.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("__b"))
    a = after.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("__a"))
    j = b.join(a, key, "full")
    changes = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col("__b")[f].alias("old"), F.col("__a")[f].alias("new")) for f in fields]),
                       lambda x: ~x["old"].eqNullSafe(x["new"]))
    null = F.lit(None).cast("string")
    one = F.array(F.struct(null.alias("field"), null.alias("old"), null.alias("new")))
    status = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").otherwise("changed")
    return j.select(key, status.alias("status"), F.inline(F.when(status == "changed", changes).otherwise(one)))


def _heaviest(starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Flags of the rising sequence of starts with the largest sum of weights; among equal sums each step goes back to the earliest."""
    n = len(starts)
    rank = np.argsort(np.argsort(starts, kind="stable"), kind="stable") + 1
    tree = [(0, 1)] * (n + 1)  # a prefix-maximum tree over the starts: the largest sum so far, and minus its index
    back = [-1] * n
    best = (0, 1)
    for k, (r, w) in enumerate(zip(rank.tolist(), weights.tolist())):
        at, found = r - 1, (0, 1)
        while at > 0:
            found = max(found, tree[at])
            at -= at & -at
        back[k] = -found[1]
        mine = (found[0] + w, -k)
        best = max(best, mine)
        while r <= n:
            tree[r] = max(tree[r], mine)
            r += r & -r
    keep, at = np.zeros(n, dtype=bool), -best[1]
    while at >= 0:
        keep[at], at = True, back[at]
    return keep


def staying(both: DataFrame, plan: Sequence[str], old: str, new: str) -> DataFrame:
    """Which matched items stayed in order: ``both`` with ``__stays``, true for the longest run of items whose old and new order agree.

    Items that follow each other without a break in both orders stay or move together, so a plan is first cut into such runs, by
    scans that put no plan into one task. Only the runs go on, a start and a length each, in one array a plan: as many as the edits made,
    not as many as there are items. Their heaviest rising sequence is found in n log n steps. Of several, that which the earliest
    items in the new order lead to is taken.
    """
    plan = list(plan)
    ranked = ordered_scan(both, plan, [old], None, {"__o": row_number()})
    runs = islands(ranked, plan, [new], None, {"__p": prev(F.col("__o"))}, F.col("__p").isNull() | (F.col("__o") != F.col("__p") + 1), "__run")
    runs = cut_lineage(runs)
    each = runs.groupBy(*plan, "__run").agg(F.min("__o").alias("o"), F.count(F.lit(1)).alias("n"))

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def flags(o: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_heaviest(np.asarray(x), np.asarray(w)) for x, w in zip(o, n)])
    rows = each.groupBy(*plan).agg(F.array_sort(F.collect_list(F.struct("__run", "o", "n"))).alias("__r"))
    kept = rows.withColumn("__k", flags("__r.o", "__r.n")).select(*plan, F.inline(F.arrays_zip(F.col("__r.__run").alias("__run"), F.col("__k").alias("__stays"))))
    return spread_join(runs, kept, [*plan, "__run"], null_safe=True).select(*both.columns, "__stays")


def sequence_diff(before: DataFrame, after: DataFrame, plan: Sequence[str], pos: str, what: str, start: str, end: str) -> DataFrame:
    """Windows added, dropped, kept, retrimmed or moved between two versions of a plan.

    Repeats are matched first to first by their occurrence number. What stayed is the longest run still in
    its old order (``staying``).
    """
    plan = list(plan)

    def numbered(df, tag):
        d = df.select(*plan, what, pos, F.struct(start, end).alias(f"__{tag}"))
        n = ordered_scan(d, [*plan, what], [pos], by_width(pos, 10_000), {"__occ": row_number()})
        return n.withColumnRenamed(pos, f"{tag}_pos")
    j = cut_lineage(numbered(before, "old").join(numbered(after, "new"), [*plan, what, "__occ"], "full"))
    both = j.where(F.col("old_pos").isNotNull() & F.col("new_pos").isNotNull()).select(*plan, "old_pos", "new_pos")

    kept = staying(both, plan, "old_pos", "new_pos").where("__stays").select(*plan, "new_pos", "__stays")
    j = j.join(kept, [*plan, "new_pos"], "left")
    status = F.when(F.col("old_pos").isNull(), "added").when(F.col("new_pos").isNull(), "dropped").when(
        F.col("__stays").isNull(), "moved").when(F.col("__old") == F.col("__new"), "kept").otherwise("retrimmed")
    return j.select(*plan, what, "old_pos", "new_pos", status.alias("status"))


def merge_parts(left: DataFrame, right: DataFrame, key: str, name: str, idx: str, length: str, picks: Column) -> DataFrame:
    """One order of parts from two: each from the side picked, in the right side's order, a part only the left
    has after its neighbour there; starts are summed up again."""
    l = left.select(key, name, F.col(idx).alias("__li"), F.col(length).alias("l_len"))
    r = right.select(key, name, F.col(idx).alias("__ri"), F.col(length).alias("r_len"))
    common = l.join(r, [key, name], "left")
    at = F.when(F.col("__ri").isNotNull(), F.struct(F.col("__ri").alias("r"), F.col("__li").alias("l")))
    anchored = ordered_scan(common, [key], ["__li"], by_width("__li", 10_000), {"__at": last_value(at)})
    only = anchored.where(F.col("__ri").isNull()).select(
        key, name, F.coalesce(F.col("__at.r"), F.lit(0).cast("long")).alias("__o"),
        (F.col("__li") - F.coalesce(F.col("__at.l"), F.lit(0).cast("long"))).alias("__k"), "l_len", F.lit(None).cast("long").alias("r_len"))
    rest = r.join(l, [key, name], "left").select(key, name, F.col("__ri").alias("__o"), F.lit(0).cast("long").alias("__k"), "l_len", "r_len")
    both = rest.unionByName(only).withColumn("side", picks).withColumn(
        "len", F.when(F.col("side") == "a", F.col("l_len")).otherwise(F.col("r_len"))).where("len is not null")
    placed = ordered_scan(both, [key], ["__o", "__k"], by_width("__o", 10_000), {
        "pos": row_number(), "start": running_sum(F.col("len"), inclusive=False)})
    return placed.select(key, name, "side", "pos", "start", (F.col("start") + F.col("len")).alias("end"))


def footage_changes(before: DataFrame, after: DataFrame, key: str, s: str, e: str, out: tuple[str, str], tie: str, touching: int,
                    width: int, chunk_width: int) -> DataFrame:
    """Footage removed, added, replaced, and edges moved, by what is shown rather than by clip.

    Each version is reduced to the union of what it shows. A stretch the other version shows none of is gone
    or come; a gone and a come stretch over the same output time are one replacement; pieces only one version
    shows next to common footage are edges moved.
    """
    def union(df, tag):
        u = coalesce_spans(df, [key], s, e, tie, chunk_width, touching, extra=[F.min(out[0]).alias("o0"), F.max(out[1]).alias("o1")])
        return cut_lineage(u.withColumn("st", F.concat_ws("/", F.lit(tag), key, s)))
    old, new = union(before, "a"), union(after, "b")

    # What both versions show is looked for once; each side then reads it.
    met = overlap_join(old.select(key, "st", s, e), new.select(key, F.col("st").alias("with"), F.col(s).alias("ts"), F.col(e).alias("te")),
                       [key], (s, e), ("ts", "te"), width).where(overlap_length(s, e, "ts", "te") > touching)
    met = cut_lineage(met.select("st", "with"))

    def against(mine, theirs, both):
        shared = mine.join(both, "st", "left_semi")
        # A union's spans lie apart, and one that is shared meets another.
        pieces = subtract_from_met(shared.select(key, "st", s, e), theirs.select(key, F.col(s).alias("ts"), F.col(e).alias("te")),
                                   [key], ["st"], (s, e), ("ts", "te"), width, chunk_width)
        edges = pieces.select(key, (F.col("pe") - F.col("ps")).alias("len")).where(F.col("len") > touching)
        return mine.join(both, "st", "left_anti"), edges
    (gone, taken), (come, given) = against(old, new, met.select("st")), against(new, old, met.select(F.col("with").alias("st")))
    gone, come = cut_lineage(gone), cut_lineage(come)
    swaps = overlap_join(gone.select(key, F.col("st").alias("g"), "o0", "o1"), come.select(key, F.col("st").alias("c"), F.col("o0").alias("p0"), F.col("o1").alias("p1")),
                         [key], ("o0", "o1"), ("p0", "p1"), width)
    pairs = greedy_match(swaps.withColumn("w", overlap_length("o0", "o1", "p0", "p1")), "g", "c", "w")

    def per(df, name):
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    swapped = per(pairs.join(gone.select(F.col("st").alias("g"), key), "g"), "replaced")
    edges = taken.unionByName(given).groupBy(key).agg(F.count(F.lit(1)).alias("edges"), F.max("len").alias("largest_edge"), F.sum("len").alias("edge_us"))
    keys = old.select(key).unionByName(new.select(key)).distinct()
    j = keys.join(per(gone, "g"), key, "left").join(per(come, "c"), key, "left").join(swapped, key, "left").join(edges, key, "left")
    zero = F.lit(0).cast("long")
    return j.select(key, (F.coalesce("g", zero) - F.coalesce("replaced", zero)).alias("removed"), (F.coalesce("c", zero) - F.coalesce("replaced", zero)).alias("added"),
                    F.coalesce("replaced", zero).alias("replaced"), F.coalesce("edges", zero).alias("edges"), "largest_edge", "edge_us")


def caption_changes(old: DataFrame, new: DataFrame, key: str, ident: str, s: str, e: str, text: str, said: Column, touching: int,
                    move: int, width: int) -> DataFrame:
    """Captions retimed, rewritten, re-broken, added and removed per key, matched by what they say where.

    Captions of the two versions that overlap are linked and gathered into groups - connected components,
    so a run of any length is found - and each group is judged from its sorted texts and times.
    """
    o = old.select(key, F.concat(F.lit("a/"), F.col(ident).cast("string")).alias("o"), F.col(s).alias("os"), F.col(e).alias("oe"), F.col(text).alias("ot"))
    n = new.select(key, F.concat(F.lit("b/"), F.col(ident).cast("string")).alias("n"), F.col(s).alias("ns"), F.col(e).alias("ne"), F.col(text).alias("nt"))
    edges = overlap_join(o, n, [key], ("os", "oe"), ("ns", "ne"), width).where(overlap_length("os", "oe", "ns", "ne") > touching)
    comp = components(edges.select("o", "n"), "o", "n")

    def side(df, c, a, b, t):
        return df.select(key, F.col(c).alias("node"), F.col(a).alias("s"), F.col(b).alias("e"), F.col(t).alias("t"))
    every = side(o, "o", "os", "oe", "ot").unionByName(side(n, "n", "ns", "ne", "nt"))
    every = every.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("old", F.col("node").startswith("a/")).withColumn("said", said)

    def listed(flag):
        return F.array_sort(F.collect_list(F.when(flag, F.struct("s", "e", "t", "said"))))
    g = every.groupBy(key, "component").agg(listed(F.col("old")).alias("a"), listed(~F.col("old")).alias("b"))
    na, nb = F.size("a"), F.size("b")
    words = lambda x: F.array_join(F.transform(x, lambda c: c["said"]), "")
    each = lambda x: F.transform(x, lambda c: c["said"])
    same = words(F.col("a")) == words(F.col("b"))
    zipped = F.zip_with("a", "b", lambda x, y: F.when(x["said"] != y["said"], "rewritten").when(x["t"] != y["t"], "rebroken").when(
        (x["s"] != y["s"]) | (x["e"] != y["e"]), "retimed"))
    verdict = F.when((na == 0) | (nb == 0), F.array(F.when(na == 0, "added").otherwise("removed"))).when(
        (na != nb) & same, F.array(F.lit("rebroken"))).when(na != nb, F.array(F.lit("rewritten"))).when(
        same & (each(F.col("a")) != each(F.col("b"))), F.array(F.lit("rebroken"))).otherwise(zipped)
    v = g.select(key, F.explode(F.when(na + nb > 0, verdict)).alias("v"), "a", "b").where("v is not null")
    # A removed and an added line that say the same nearby are one line retimed.
    gone = v.where("v = 'removed'").select(key, F.try_element_at("a", F.lit(1)).alias("x")).select(key, F.col("x.said").alias("said"), F.col("x.s").alias("gs"), F.concat_ws("/", F.lit("g"), key, "x.s").alias("g"))
    come = v.where("v = 'added'").select(key, F.try_element_at("b", F.lit(1)).alias("x")).select(key, F.col("x.said").alias("said"), F.col("x.s").alias("cs"), F.concat_ws("/", F.lit("c"), key, "x.s").alias("c"))
    near = gone.join(come, [key, "said"]).where(F.abs(F.col("gs") - F.col("cs")) <= move)
    moved = greedy_match(near.withColumn("w", F.lit(move + 1) - F.abs(F.col("gs") - F.col("cs"))), "g", "c", "w").join(gone.select(key, "g"), "g")
    counts = v.groupBy(key).pivot("v", ["retimed", "rewritten", "rebroken", "added", "removed"]).agg(F.count(F.lit(1)))
    j = counts.join(moved.groupBy(key).agg(F.count(F.lit(1)).alias("__m")), key, "left")
    m, zero = F.coalesce("__m", F.lit(0).cast("long")), F.lit(0).cast("long")
    return j.select(key, (F.coalesce("retimed", zero) + m).alias("retimed"), F.coalesce("rewritten", zero).alias("rewritten"), F.coalesce("rebroken", zero).alias("rebroken"),
                    (F.coalesce("added", zero) - m).alias("added"), (F.coalesce("removed", zero) - m).alias("removed"))
