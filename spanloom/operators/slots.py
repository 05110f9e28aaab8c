"""Marker phrases in speech, across the edges of neighbouring lines; the roles each line could fill."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markers as mk
from ..functions.scalars import CJK, marker_pattern, spoken_units
from .ordered import by_width, nxt, ordered_scan, prev

SLOTS = ("hook", "problem", "product", "proof", "cta")


def _joined(a: Column, b: Column) -> Column:
    """Two pieces of speech put together, with a space only between Latin ones."""
    bare = a.isNull() | b.isNull() | (a == "") | (b == "") | F.substring(a, -1, 1).rlike(CJK) | F.substring(b, 1, 1).rlike(CJK)
    return F.concat(F.coalesce(a, F.lit("")), F.when(bare, "").otherwise(" "), F.coalesce(b, F.lit("")))


def with_neighbours(lines: DataFrame, keys: Sequence[str], order: str, text: str, reach: int = mk.NEIGHBOUR_CHARACTERS) -> DataFrame:
    """Each line's text with the end of the line before and the start of the one after."""
    t = F.col(text)
    seen = ordered_scan(lines, keys, [order], by_width(order, 10_000), {
        "__b": prev(F.substring(t, -reach, reach)), "__a": nxt(F.substring(t, 1, reach))})
    left = _joined(F.col("__b"), t)
    return seen.withColumn("__joined", _joined(left, F.col("__a"))).withColumn(
        "__from", F.length(left) - F.length(t)).withColumn("__past", F.length(left)).drop("__b", "__a")


def slot_candidates(lines: DataFrame, keys: Sequence[str], order: str, text: str, s: str, e: str,
                    markers: Mapping[str, Sequence[str]] | None = None, second: int = 1_000_000) -> DataFrame:
    """Every line that could fill each role, with what the rules found; one row per line, role and reason."""
    markers = markers or {
        "problem": [marker_pattern(m) for m in mk.PROBLEM_MARKERS],
        "product": [marker_pattern(m) for m in mk.PRODUCT_MARKERS],
        "proof": [marker_pattern(m) for m in mk.PROOF_MARKERS] + list(mk.PROOF_PATTERNS),
        "cta": [marker_pattern(m) for m in mk.CTA_MARKERS] + list(mk.CTA_PATTERNS)}
    w = with_neighbours(lines, keys, order, text)
    # A line that holds none of a role's patterns anywhere is settled by one cheap test.
    parts = []
    for slot, patterns in markers.items():
        for p in patterns:
            hit = F.when(F.col("__joined").rlike(p), reach(p))
            parts.append(F.struct(F.lit(slot).alias("slot"), hit.alias("why")))
    length = F.col(e) - F.col(s)
    hook = F.when((F.col(text) != "") & (length <= int(mk.HOOK_SECONDS * second)) & (spoken_units(F.col(text)) >= mk.HOOK_MIN_UNITS), "short line")
    parts.append(F.struct(F.lit("hook").alias("slot"), hook.alias("why")))
    return w.select(*keys, order, F.inline(F.filter(F.array(*parts), lambda x: x["why"].isNotNull()))).distinct()


def reach(pattern: str) -> Column:
    """The first match that reaches into the line itself: matches are walked off the front of the joined text
    by their own order, so only whole, non-overlapping matches count."""
    hits = F.regexp_extract_all("__joined", F.lit(f"({pattern})"), F.lit(1))
    # Where each match lies: the joined text is cut at the matches, so the pieces before it give its place.
    cuts = F.split("__joined", pattern, -1)
    start = F.transform(F.sequence(F.lit(1), F.size(hits)), lambda n: F.struct(
        F.element_at(hits, n).alias("m"),
        (F.aggregate(F.slice(cuts, F.lit(1), n), F.lit(0), lambda a, c: a + F.length(c))
         + F.aggregate(F.slice(hits, F.lit(1), n - 1), F.lit(0), lambda a, c: a + F.length(c))).alias("at")))
    inside = F.filter(start, lambda x: (x["at"] < F.col("__past")) & (x["at"] + F.length(x["m"]) > F.col("__from")))
    return F.try_element_at(inside, F.lit(1))["m"]


def missing_slots(cands: DataFrame, every: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The roles of each key that nothing could fill."""
    roles = every.select(*keys, F.explode(F.array(*[F.lit(x) for x in SLOTS])).alias("slot"))
    return roles.join(cands.select(*keys, "slot").distinct(), [*keys, "slot"], "left_anti")
