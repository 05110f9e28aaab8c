"""Moving span edges to where the sound is, and putting corrected words over stretches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import asof, overlap_join, point_join


def extend_to_sound(a: DataFrame, quiet: DataFrame, words: DataFrame, on: Sequence[str], ident: str, a_span, q_span, w_span,
                    reach: int, unheard: int, breath: int, width: int, chunk_width: int, tolerance: int = 20_000) -> DataFrame:
    """Open a span where the silence before it stops and close it where the next one starts, when sound runs
    from there up to the edge; never past the word on the far side, and not for an edge in a silence."""
    (s, e), (qs, qe), (ws, we) = a_span, q_span, w_span
    j = a
    for edge, name in ((s, "__qs"), (e, "__qe")):
        hit = point_join(a.select(*on, ident, edge), quiet, on, edge, q_span, width, edges="[]", tolerance=tolerance)
        j = j.join(hit.select(ident).distinct().withColumn(name, F.lit(True)), ident, "left")
    # Four passes side by side, joined on the span: one inside the other would read the input twice each time.
    for marks, mark, edge, ahead, name, slack in (
            (quiet, qe, s, False, "__onset", 0), (quiet, qs, e, True, "__fall", 0),
            (words, we, s, False, "__wb", tolerance), (words, ws, e, True, "__wa", tolerance)):
        got = asof(a.select(*on, ident, edge), marks.select(*on, mark), on, edge, mark, ident, chunk_width, ahead, name, slack)
        j = j.join(got.select(ident, name), ident)
    back, ahead = F.col(s) - F.col("__onset"), F.col("__fall") - F.col(e)
    opens = F.col("__qs").isNull() & (back <= reach) & (back >= unheard)
    shuts = F.col("__qe").isNull() & (ahead <= reach) & (ahead >= unheard)
    new_s = F.least(F.col(s), F.greatest(F.col("__onset") - breath, F.coalesce("__wb", F.lit(0).cast("long"))))
    new_e = F.greatest(F.col(e), F.least(F.col("__fall") + breath, F.col("__wa")))
    return j.select(*a.columns, F.when(opens, new_s).otherwise(F.col(s)).alias("new_s"),
                    F.when(shuts, new_e).otherwise(F.col(e)).alias("new_e"))


def override_words(words: DataFrame, heard: DataFrame, fixed: DataFrame, on: Sequence[str], parent: str, ident: str,
                   w_span, f_span, width: int) -> DataFrame:
    """Words with those inside corrected stretches replaced by the ones heard there; each heard word joins the
    touched parent it lies nearest to. A stretch that touches no parent takes none."""
    (s, e), (fs, fe) = w_span, f_span
    parents = words.groupBy(*on, parent).agg(F.min(s).alias("__gs"), F.max(e).alias("__ge"))
    gone = overlap_join(words, fixed, on, w_span, f_span, width).select(ident)
    kept = words.join(gone, ident, "left_anti").select(*on, parent, ident, s, e)
    new = heard.withColumn("__mid", F.expr(f"({s} + {e}) div 2"))
    inside = point_join(new, fixed, on, "__mid", f_span, width).select(*on, ident, s, e, "__mid", fs, fe)
    near = overlap_join(inside, parents, on, f_span, ("__gs", "__ge"), width, levels=3)
    away = F.greatest(F.col("__gs") - F.col("__mid"), F.col("__mid") - F.col("__ge"), F.lit(0).cast("long"))
    home = near.groupBy(*on, ident, s, e).agg(F.min(F.struct(away.alias("d"), F.col("__gs"), F.col(parent))).alias("__p"))
    return kept.unionByName(home.select(*on, F.col(f"__p.{parent}").alias(parent), ident, s, e))
