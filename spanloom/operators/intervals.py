"""Joins and algebra over half-open spans per key.

Catalyst runs a range condition beside one equality as a join that is quadratic per key. The overlap
join here puts both sides into time bins and joins on ``(key, level, bin)``. Spans are indexed by length:
a span up to ``width`` long lives at level 0, a longer one at a level whose bins are ``FACTOR`` times
wider, so that no span covers more than a couple of bins until the top level. A pair meets at the level of
its longer member and only in the bin that holds the later of the two starts, so it is found exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import (by_width, first_value, islands, last_value, nxt, ordered_scan, prev, running_max,
                      running_sum, spread_join)

FACTOR = 64
_KEYS = ["__role", "__level", "__bin"]


def _own_level(length: str, width: int, levels: int) -> str:
    whens = " ".join(f"WHEN {length} <= {width * FACTOR ** n} THEN {n}" for n in range(levels - 1))
    return f"CASE {whens} ELSE {levels - 1} END" if whens else str(levels - 1)


def _binned(df: DataFrame, s: str, e: str, width: int, levels: int, own_role: str, up_role: str,
            strict: bool) -> DataFrame:
    own = _own_level(f"(`{e}` - `{s}`)", width, levels)
    parts = []
    for n in range(levels):
        w = width * FACTOR ** n
        bins = f"sequence(`{s}` div {w}, greatest(`{s}`, `{e}`) div {w})"
        at = f"__b -> named_struct('__role', '{{role}}', '__level', {n}, '__bin', __b)"
        none = f"filter(transform(array(0L), {at.format(role=own_role)}), __x -> false)"
        parts.append(f"IF({own} = {n}, transform({bins}, {at.format(role=own_role)}), {none})")
        rises = "<" if strict else "<="
        if n > 0 or not strict:
            parts.append(f"IF({own} {rises} {n}, transform({bins}, {at.format(role=up_role)}), {none})")
    return df.select("*", F.expr(f"inline(concat({', '.join(parts)}))"))


def _width_at(levels: int, width: int) -> str:
    whens = " ".join(f"WHEN {n} THEN {width * FACTOR ** n}" for n in range(levels))
    return f"CASE __level {whens} END"


def overlap_join(
    a: DataFrame, b: DataFrame, on: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str],
    width: int, levels: int = 2, touching: bool = False,
) -> DataFrame:
    """Pairs of the same key whose spans overlap; apart from ``on`` the column names must differ.

    ``touching`` also keeps pairs that only share an edge (for rules with closed edges).
    """
    (s, e), (bs, be) = a_span, b_span
    left = _binned(a, s, e, width, levels, "a", "b", True)
    right = _binned(b, bs, be, width, levels, "b", "a", False)
    meets = "<=" if touching else "<"
    return (
        left.join(right, [*on, *_KEYS])
        .where(F.expr(f"__bin = greatest(`{s}`, `{bs}`) div ({_width_at(levels, width)})"))
        .where(F.expr(f"`{s}` {meets} `{be}` AND `{bs}` {meets} `{e}`"))
        .drop(*_KEYS)
    )


def overlap_length(s: str, e: str, bs: str, be: str) -> Column:
    return F.least(F.col(e), F.col(be)) - F.greatest(F.col(s), F.col(bs))


def point_join(
    points: DataFrame, spans: DataFrame, on: Sequence[str], at: str, span: tuple[str, str],
    width: int, levels: int = 2, edges: str = "[)", tolerance: int = 0,
) -> DataFrame:
    """Pairs of a moment and a span holding it. ``edges`` says which ends belong to the span; a positive
    ``tolerance`` widens the span by that much at both ends, a negative one narrows it."""
    s, e = span
    grow = max(tolerance, 0)
    own = _own_level(f"(`{e}` - `{s}` + {2 * grow})", width, levels)
    whens = " ".join(f"WHEN {n} THEN {width * FACTOR ** n}" for n in range(levels))
    wide = spans.withColumn("__level", F.expr(own)).withColumn("__w", F.expr(f"CASE __level {whens} END"))
    wide = wide.withColumn("__bin", F.explode(F.expr(
        f"sequence((`{s}` - {grow}) div __w, greatest(`{s}`, `{e}` + {grow}) div __w)"))).drop("__w")
    emitted = ", ".join(
        f"named_struct('__level', {n}, '__bin', `{at}` div {width * FACTOR ** n})" for n in range(levels))
    moments = points.select("*", F.expr(f"inline(array({emitted}))"))
    low = ">=" if edges[0] == "[" else ">"
    high = "<=" if edges[1] == "]" else "<"
    return (
        moments.join(wide, [*on, "__level", "__bin"])
        .where(F.expr(f"`{at}` {low} `{s}` - ({tolerance}) AND `{at}` {high} `{e}` + ({tolerance})"))
        .drop("__level", "__bin")
    )


def covered(a: DataFrame, b: DataFrame, on: Sequence[str], ids: Sequence[str], a_span, b_span,
            width: int, levels: int = 2, name: str = "covered") -> DataFrame:
    """Add the summed overlap with ``b`` to every row of ``a``; 0 where nothing overlaps."""
    s, e = a_span
    pairs = overlap_join(a.select(*on, *ids, s, e), b.select(*on, *b_span), on, a_span, b_span, width, levels)
    held = pairs.groupBy(*ids).agg(F.sum(overlap_length(s, e, *b_span)).alias(name))
    return a.join(held, list(ids), "left").withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))


def share(covered_column: str, s: str, e: str) -> Column:
    """The covered share of a span, capped at 1; 0 for a span of no length."""
    length = F.col(e) - F.col(s)
    return F.when(length <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.col(covered_column) / length))


def asof(
    moments: DataFrame, marks: DataFrame, on: Sequence[str], at: str, mark: str, tie: str,
    chunk_width: int, forward: bool = False, name: str = "found", tolerance: int = 0,
) -> DataFrame:
    """The nearest mark at or before (or at or after) each moment, by one ordered pass over both sides.

    ``tolerance`` lets a mark that far on the wrong side still count. Marks are sorted ahead of a moment
    at the same instant when looking back, behind it when looking forward.
    """
    moving = F.col(mark) - tolerance if not forward else F.col(mark) + tolerance
    side = 1 if forward else 0
    seen = marks.select(*on, moving.alias("__t"), F.lit(side).alias("__side"), F.lit(None).cast("long").alias("__tie"),
                        F.col(mark).alias("__mark"), F.lit(None).cast("long").alias(at),
                        *[F.lit(None).cast(t).alias(c) for c, t in moments.dtypes if c not in (*on, at)])
    seen = seen.dropDuplicates([*on, "__t"])
    asked = moments.select(*on, F.col(at).alias("__t"), F.lit(1 - side).alias("__side"), F.col(tie).cast("long").alias("__tie"),
                           F.lit(None).cast("long").alias("__mark"), at,
                           *[c for c in moments.columns if c not in (*on, at)])
    out = first_value(F.col("__mark")) if forward else last_value(F.col("__mark"))
    both = seen.unionByName(asked)
    scanned = ordered_scan(both, on, ["__t", "__side", "__tie"], by_width("__t", chunk_width), {name: out})
    return scanned.where(F.col("__side") == 1 - side).select(*moments.columns, name)


def nearest(
    moments: DataFrame, marks: DataFrame, on: Sequence[str], at: str, mark: str, tie: str,
    within: int, chunk_width: int, name: str = "found", later: bool = True,
) -> DataFrame:
    """The nearest mark within a reach either way, by one ordered pass that looks both ways; of two equally
    near the later one, or the earlier when ``later`` is off."""
    seen = marks.select(*on, F.col(mark).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast("long").alias("__tie"),
                        F.col(mark).alias("__mark"), F.lit(None).cast("long").alias(at),
                        *[F.lit(None).cast(t).alias(c) for c, t in moments.dtypes if c not in (*on, at)])
    asked = moments.select(*on, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.col(tie).cast("long").alias("__tie"),
                           F.lit(None).cast("long").alias("__mark"), at, *[c for c in moments.columns if c not in (*on, at)])
    both = ordered_scan(seen.dropDuplicates([*on, "__t"]).unionByName(asked), on, ["__t", "__side", "__tie"],
                        by_width("__t", chunk_width), {"__back": last_value(F.col("__mark")), "__ahead": first_value(F.col("__mark"))})
    back, ahead = F.col(at) - F.col("__back"), F.col("__ahead") - F.col(at)
    wins = ahead <= back if later else ahead < back
    choice = F.when(F.col("__back").isNull(), F.col("__ahead")).when(F.col("__ahead").isNull(), F.col("__back")) \
        .when(wins, F.col("__ahead")).otherwise(F.col("__back"))
    return both.where(F.col("__side") == 1).select(
        *moments.columns, F.when(F.abs(choice - F.col(at)) <= within, choice).alias(name))


def coalesce_spans(
    df: DataFrame, on: Sequence[str], s: str, e: str, tie: str, chunk_width: int, max_gap: int = 0,
    extra: Sequence[Column] = (), guard: Callable[[], Column] | None = None,
) -> DataFrame:
    """Union of spans per key, joining those at most ``max_gap`` apart; ``extra`` adds aggregates."""
    look = {"__reach": running_max(F.col(e), inclusive=False)}
    starts = F.col(s) - F.col("__reach") > max_gap
    numbered = islands(df, on, [s, tie], by_width(s, chunk_width), look, starts)
    return numbered.groupBy(*on, "grp").agg(
        F.min(s).alias(s), F.max(e).alias(e), F.count(F.lit(1)).alias("n"), *extra).drop("grp")


def subtract_spans(
    a: DataFrame, b: DataFrame, on: Sequence[str], ids: Sequence[str], a_span, b_span,
    width: int, chunk_width: int, tie: str, levels: int = 2,
) -> DataFrame:
    """Parts of each span of ``a`` that no span of ``b`` covers."""
    (s, e), (bs, be) = a_span, b_span
    union = cut_lineage(coalesce_spans(b.select(*on, bs, be, tie), on, bs, be, tie, chunk_width).drop("n"))
    pairs = cut_lineage(_beside(a.select(*on, *ids, s, e), union, on, a_span, b_span, width, chunk_width, levels))
    whole = a.join(pairs.select(*ids).distinct(), list(ids), "left_anti").select(
        *on, *ids, F.col(s).alias("ps"), F.col(e).alias("pe"))
    return _parts(pairs, [*on, *ids], a_span).unionByName(whole.where(F.col("pe") > F.col("ps")))


def subtract_from_met(
    a: DataFrame, b: DataFrame, on: Sequence[str], ids: Sequence[str], a_span, b_span, width: int, chunk_width: int, levels: int = 2,
) -> DataFrame:
    """``subtract_spans`` where the spans of ``b`` lie apart and every span of ``a`` is known to meet one: nothing has to be
    coalesced or looked for among those that meet none."""
    pairs = _beside(a.select(*on, *ids, *a_span), b.select(*on, *b_span), on, a_span, b_span, width, chunk_width, levels)
    return _parts(pairs, [*on, *ids], a_span)


def _beside(a: DataFrame, union: DataFrame, on: Sequence[str], a_span, b_span, width: int, chunk_width: int, levels: int) -> DataFrame:
    """Each span of ``a`` with those it meets of a union of spans, which know where the one before ended and the next begins."""
    bs, be = b_span
    # The gaps between the coalesced spans of a key, the first reaching back and the last on for ever.
    ends = ordered_scan(union, on, [bs], by_width(bs, chunk_width),
                        {"__next": nxt(F.col(bs)), "__prev": prev(F.col(be))})
    return overlap_join(a, ends.withColumnRenamed(bs, "__bs").withColumnRenamed(be, "__be"), on,
                        a_span, ("__bs", "__be"), width, levels)


def _parts(pairs: DataFrame, cols: Sequence[str], a_span) -> DataFrame:
    s, e = a_span
    after = F.struct(F.col("__be").alias("ps"), F.least(F.col(e), F.coalesce(F.col("__next"), F.col(e))).alias("pe"))
    # Only the first covering span of a row leaves a part before it that no other pair reports.
    ahead = F.when(F.coalesce(F.col("__prev") <= F.col(s), F.lit(True)), F.struct(
        F.col(s).alias("ps"), F.least(F.col("__bs"), F.col(e)).alias("pe")))
    return pairs.select(*cols, F.inline(F.filter(F.array(after, ahead), lambda x: x["pe"] > x["ps"])))


def majority(a: DataFrame, turns: DataFrame, on: Sequence[str], ids: Sequence[str], a_span, t_span, label: str,
             width: int, at_least: float = 0.8, levels: int = 2) -> DataFrame:
    """The label holding at least that share of the labelled time in each span, else NULL; ties by label."""
    pairs = overlap_join(a.select(*on, *ids, *a_span), turns.select(*on, *t_span, label), on, a_span, t_span, width, levels)
    held = pairs.groupBy(*ids, label).agg(F.sum(overlap_length(*a_span, *t_span)).alias("__h"))
    top = held.groupBy(*ids).agg(F.min(F.struct((-F.col("__h")).alias("h"), F.col(label).alias("l"))).alias("__t"),
                                 F.sum("__h").alias("__all"))
    named = F.when(-F.col("__t.h") / F.col("__all") >= at_least, F.col("__t.l"))
    return a.join(top.select(*ids, named.alias(label)), list(ids), "left")


def headroom(a: DataFrame, quiet: DataFrame, on: Sequence[str], ids: Sequence[str], a_span, q_span, fin: str,
             width: int, tolerance: int = 20_000) -> DataFrame:
    """How far each edge of a span may move inside the silence it sits in."""
    (s, e), (qs, qe) = a_span, q_span
    length = F.col(qe) - F.col(qs)
    q = quiet.select(*on, qs, qe)
    opens = point_join(a.select(*on, *ids, s), q, on, s, q_span, width, edges="[]", tolerance=tolerance)
    opens = opens.groupBy(*ids).agg(F.max(F.least(F.col(s) - F.col(qs), length)).alias("__i"))
    shuts = point_join(a.select(*on, *ids, e), q, on, e, q_span, width, edges="[]", tolerance=tolerance)
    shuts = shuts.groupBy(*ids).agg(F.max(F.least(F.col(qe) - F.col(e), length)).alias("__o"))
    j = a.join(opens, list(ids), "left").join(shuts, list(ids), "left")
    zero = F.lit(0).cast("long")
    return j.withColumn("safe_in", F.greatest(zero, F.least(F.coalesce("__i", zero), F.col(s)))).withColumn(
        "safe_out", F.greatest(zero, F.least(F.coalesce("__o", zero), F.col(fin) - F.col(e)))).drop("__i", "__o")


def remap(placed: DataFrame, spans: DataFrame, on: Sequence[str], p_span, s_span, tl: str, speed: str,
          width: int, levels: int = 2) -> DataFrame:
    """Source-time spans on the output time of the placements that play them, clipped to each placement."""
    (ps, pe), (ss, se) = p_span, s_span
    j = overlap_join(placed, spans, on, p_span, s_span, width, levels)
    opened, closed = F.greatest(ss, ps), F.least(se, pe)

    def into(c):
        return F.col(tl) + F.floor((c - F.col(ps)) / F.col(speed)).cast("long")
    return j.withColumn("o_start", into(opened)).withColumn("o_end", into(closed)).withColumn(
        "cut", (F.col(ss) < F.col(ps)) | (F.col(se) > F.col(pe)))


def relocate(notes: DataFrame, placed: DataFrame, on: Sequence[str], note: str, at: str, anchor: str, clip: str,
             p_span, tl: str, speed: str, width: int, tolerance: int = 20_000) -> DataFrame:
    """Where a note pinned to source time plays in another version: in its own clip if that still holds it,
    else the first that does; ``gone`` when none does."""
    hit = point_join(notes, placed, on, at, p_span, width, edges="[]", tolerance=tolerance)
    plays = F.col(tl) + F.floor((F.col(at) - F.col(p_span[0])) / F.col(speed)).cast("long")
    first = hit.groupBy(note).agg(F.min(F.struct(
        (F.col(clip) != F.col(anchor)).cast("int").alias("o"), F.col(tl).alias("t"), F.col(clip).alias("clip"),
        plays.alias("at"))).alias("__f"))
    return notes.join(first, note, "left").select(
        *[c for c in notes.columns], F.col("__f.clip").alias("now_clip"), F.col("__f.at").alias("now_at"),
        F.col("__f").isNull().alias("gone"))


def inner_gaps(windows: DataFrame, quiet: DataFrame, said: DataFrame, on: Sequence[str], window: str, w_span, q_span,
               s_span, longer_than: int, width: int) -> DataFrame:
    """Pauses strictly inside a window with talk before and after inside it and no sentence over the middle."""
    (ws, we), (qs, qe), (ss, se) = w_span, q_span, s_span
    inside = overlap_join(windows, quiet.where(F.col(qe) - F.col(qs) > longer_than), on, w_span, q_span, width).where(
        (F.col(qs) > F.col(ws)) & (F.col(qe) < F.col(we)))
    inside = cut_lineage(inside.withColumn("__mid", F.expr(f"({qs} + {qe}) div 2")))
    ids = [window, qs]
    talk = said.select(*on, ss, se)
    before = overlap_join(inside.select(*on, *ids, ws), talk, on, (ws, qs), s_span, width).select(*ids).distinct()
    after = overlap_join(inside.select(*on, *ids, qe, we), talk, on, (qe, we), s_span, width).select(*ids).distinct()
    over = point_join(inside.select(*on, *ids, "__mid"), talk, on, "__mid", s_span, width, edges="()").select(*ids).distinct()
    return inside.join(before, ids, "left_semi").join(after, ids, "left_semi").join(over, ids, "left_anti").drop("__mid")


def cut_out(windows: DataFrame, gaps: DataFrame, on: Sequence[str], window: str, w_span, q_span, breath: int,
            merge_gap: int, width: int, chunk_width: int) -> DataFrame:
    """Windows with those gaps taken out, a breath left on each side; a gap whose two halves would be joined
    again stays."""
    qs, qe = q_span
    taken = gaps.select(*on, (F.col(qs) + breath).alias("__cs"), (F.col(qe) - breath).alias("__ce"),
                        F.col(qs).alias("__tie")).where(F.col("__ce") - F.col("__cs") > merge_gap)
    return subtract_spans(windows, taken, on, [window], w_span, ("__cs", "__ce"), width, chunk_width, "__tie")


def avoid(a: DataFrame, bad: DataFrame, on: Sequence[str], ident: str, a_span, b_span, within: int, width: int,
          chunk_width: int) -> DataFrame:
    """Move edges off forbidden spans (already coalesced) to the nearest clean point, else keep and say so.

    An opening edge objects to ``[start, end)`` and a closing one to ``(start, end]``, so the clean points
    are the ends for the one and the starts for the other.
    """
    (s, e), (bs, be) = a_span, b_span
    out = a
    for edge, edges, mark, name in ((s, "[)", be, "new_s"), (e, "(]", bs, "new_e")):
        hit = point_join(a.select(*on, ident, edge), bad.select(*on, bs, be), on, edge, b_span, width, edges=edges)
        moved = nearest(hit.select(*on, ident, edge), bad.select(*on, mark), on, edge, mark, ident, within,
                        chunk_width, name).select(ident, F.coalesce(F.col(name), F.col(edge)).alias(name),
                                                  F.col(name).isNull().alias(f"{name}_stuck"))
        out = out.join(moved, ident, "left").withColumn(name, F.coalesce(F.col(name), F.col(edge))).withColumn(
            f"{name}_stuck", F.coalesce(f"{name}_stuck", F.lit(False)))
    closed = F.col("new_e") <= F.col("new_s")
    touched = (F.col("new_s") != F.col(s)) | (F.col("new_e") != F.col(e))
    out = out.withColumn("stuck", (F.col("new_s_stuck") | F.col("new_e_stuck")) | (closed & touched))
    return out.withColumn("__c", closed).withColumn("new_s", F.when(F.col("__c"), F.col(s)).otherwise(F.col("new_s"))) \
        .withColumn("new_e", F.when(F.col("__c"), F.col(e)).otherwise(F.col("new_e"))).drop(
        "__c", "new_s_stuck", "new_e_stuck")


def snap_edges(words: DataFrame, quiet: DataFrame, on: Sequence[str], ident: str, w_span, q_span, tolerance: int,
               width: int, chunk_width: int) -> DataFrame:
    """Move word edges onto the nearby edge of a silence; the order of the words never changes.

    Whether a start may move depends on where the word before ended up, which is a chain over the whole
    key. Each word's end has only two outcomes, so a word is a function from "the end before moved" to "my
    end moved": constant, same or opposite. Such functions compose, so the outcome is read off the last
    constant word and the number of opposites since - two running values instead of a loop.
    """
    (s, e), (qs, qe) = w_span, q_span
    q = quiet.select(*on, qs, qe)
    across = overlap_join(words.select(*on, ident, s, e), q, on, w_span, q_span, width).where(
        (F.col(s) < F.col(qs)) & (F.col(qe) < F.col(e))).groupBy(ident).agg(
        F.min(qs).alias("__q0"), F.max_by(F.col(qe), F.col(qs)).alias("__q1"))
    w = words.join(across, ident, "left")
    before, after = F.col("__q0") - F.col(s), F.col(e) - F.col("__q1")
    w = w.withColumn("__s", F.when(after >= before, F.col("__q1")).otherwise(F.col(s))).withColumn(
        "__e", F.when(after < before, F.col("__q0")).otherwise(F.col(e))).drop("__q0", "__q1")
    # The nearest silence end to a start and silence start to an end; of two equally near the earlier.
    for at, mark, name in (("__s", qe, "__on"), ("__e", qs, "__off")):
        w = nearest(w, q.select(*on, mark), on, at, mark, ident, tolerance, chunk_width, name, later=False)
    w = cut_lineage(w)
    w = cut_lineage(ordered_scan(w, on, [s, ident], by_width(s, chunk_width), {
        "__pe": prev(F.col("__e")), "__poff": prev(F.col("__off")), "__ns": nxt(F.col("__s"))}))
    zero = F.lit(0).cast("long")

    def start_if(end_before):
        ok = F.col("__on").isNotNull() & (end_before <= F.col("__on")) & (F.col("__on") < F.col("__e"))
        return F.when(ok, F.col("__on")).otherwise(F.col("__s"))

    def moves(start):
        return F.coalesce(F.col("__off").isNotNull() & (start < F.col("__off")) & (
            F.col("__ns").isNull() | (F.col("__off") <= F.col("__ns"))), F.lit(False)).cast("int")
    kept_before = F.coalesce(F.col("__pe"), zero)
    moved_before = F.coalesce(F.col("__poff"), F.col("__pe"), zero)
    w = w.withColumn("__f0", moves(start_if(kept_before))).withColumn(
        "__f1", F.when(F.col("__pe").isNull(), moves(start_if(kept_before))).otherwise(moves(start_if(moved_before))))
    w = w.withColumn("__flip", (F.col("__f0") > F.col("__f1")).cast("long"))
    w = ordered_scan(w, on, [s, ident], by_width(s, chunk_width), {"__flips": running_sum(F.col("__flip"))})
    const = F.when(F.col("__f0") == F.col("__f1"), F.struct(F.col("__f0").alias("v"), F.col("__flips").alias("n")))
    w = cut_lineage(ordered_scan(w, on, [s, ident], by_width(s, chunk_width), {"__const": last_value(const)}))
    end_moved = (F.coalesce(F.col("__const.v"), F.lit(0)) + F.col("__flips") - F.coalesce(F.col("__const.n"), zero)) % 2
    w = w.withColumn("__m", end_moved)
    w = ordered_scan(w, on, [s, ident], by_width(s, chunk_width), {"__pm": prev(F.col("__m"))})
    start = F.when(F.col("__pm") == 1, start_if(moved_before)).otherwise(start_if(kept_before))
    return w.select(*words.columns, start.alias("new_s"), F.when(F.col("__m") == 1, F.col("__off")).otherwise(F.col("__e")).alias("new_e"))


def group_capped(spans: DataFrame, on: Sequence[str], s: str, e: str, join: int, longest: int, pad: int,
                 finish: DataFrame, fin: str, chunk_width: int) -> DataFrame:
    """Spans joined over gaps up to ``join`` while a group stays within ``longest``, then padded to at most
    the middle of the way to the neighbour. Spans are disjoint and in order."""
    from .graph import chain
    runs = islands(spans, on, [s], by_width(s, chunk_width), {"__pe": prev(F.col(e))}, F.col(s) - F.col("__pe") > join, "__run")
    runs = cut_lineage(runs)
    full = runs.withColumn("__at", F.greatest(F.col(s) + longest, F.col(e)) + 1)
    run = [*on, "__run"]
    ends = asof(full, full.select(*run, F.col(e).alias("__m")), run, "__at", "__m", s, chunk_width, True, "__to_e")
    starts = runs.select(*run, F.col(e).alias("__to_e"), F.col(s).alias("__to"))
    nodes = ends.join(starts, [*run, "__to_e"], "left")
    first = runs.groupBy(*run).agg(F.min(s).alias("__first"))
    nodes = nodes.join(first, run).withColumn("__is", F.col(s) == F.col("__first"))
    heads = chain(nodes, run, s, "__to", "__is").withColumn("__head", F.lit(True)).drop("__run")
    marked = spans.join(heads, [*on, s], "left")
    grouped = ordered_scan(marked, on, [s], by_width(s, chunk_width), {"grp": running_sum(F.col("__head").cast("long"))})
    groups = grouped.groupBy(*on, "grp").agg(F.min(s).alias("gs"), F.max(e).alias("ge"), F.count(F.lit(1)).alias("n"))
    around = ordered_scan(groups, on, ["gs"], by_width("gs", chunk_width), {"__pe": prev(F.col("ge")), "__ns": nxt(F.col("gs"))})
    around = spread_join(around, finish, on)
    before = F.coalesce(F.expr("(__pe + gs) div 2"), F.lit(0).cast("long"))
    after = F.coalesce(F.expr("(ge + __ns) div 2"), F.col(fin))
    return around.select(*on, "grp", "n", F.greatest(F.col("gs") - pad, before).alias("ps"),
                         F.least(F.col("ge") + pad, after, F.col(fin)).alias("pe"))


def split_gaps(gaps: DataFrame, cuts: DataFrame, on: Sequence[str], gap: str, g_span, cut: str, least: int, width: int,
               chunk_width: int) -> DataFrame:
    """Cut each gap at the change points inside it so that every part is at least ``least`` long, taking the
    first that fits each time; gaps shorter than that are dropped."""
    from .graph import chain
    gs, ge = g_span
    wide = gaps.where(F.col(ge) - F.col(gs) >= least)
    inside = point_join(cuts.select(*on, cut).distinct(), wide, on, cut, g_span, width, edges="()").where(
        (F.col(cut) - F.col(gs) >= least) & (F.col(ge) - F.col(cut) >= least))
    key = [*on, gap]
    inside = cut_lineage(inside.withColumn("__at", F.col(cut) + least))
    nodes = asof(inside, inside.select(*key, F.col(cut).alias("__m")), key, "__at", "__m", cut, chunk_width, True, "__to")
    first = inside.groupBy(*key).agg(F.min(cut).alias("__first"))
    nodes = nodes.join(first, key).withColumn("__is", F.col(cut) == F.col("__first"))
    taken = chain(nodes, key, cut, "__to", "__is")
    points = wide.select(*key, F.col(gs).alias("s")).unionByName(taken.select(*key, F.col(cut).alias("s")))
    seen = ordered_scan(points, key, ["s"], by_width("s", chunk_width), {"__n": nxt(F.col("s"))})
    return seen.join(wide.select(*key, ge), key).select(*key, "s", F.coalesce("__n", ge).alias("e"))


def interval_components(spans: DataFrame, on: Sequence[str], s: str, e: str, ident: str, points: bool = False) -> DataFrame:
    """Which spans hang together by overlaps: node and component, the smallest id of its run of overlapping spans; lone spans are left out.

    In order of start a run ends where a span begins at or after the furthest end so far, so one scan finds the runs, without pairs and
    without rounds. Spans that are empty or turned round hold nothing together; a null start or end leaves a span out. With ``points``
    an empty or unended span is a moment that belongs to the run it falls into.
    """
    on = list(on)
    held = spans.select(*on, F.col(s).alias("__s"), F.col(e).alias("__e"), F.col(ident).alias("node"))
    held = held if points else held.where("__s < __e")
    runs = islands(held, on, ["__s", "node"], None, {"__reach": running_max(F.col("__e"), inclusive=False)}, F.col("__reach").isNull() | (F.col("__s") >= F.col("__reach")))
    runs = cut_lineage(runs.select(*on, "grp", "node"))
    told = runs.groupBy(*on, "grp").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return spread_join(runs, told, [*on, "grp"], null_safe=True).select("node", "component")
