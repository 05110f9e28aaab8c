"""The whole derivation: spans and measurements to searchable clips with stable ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import clip_kind
from ..session import cut_lineage
from . import intervals as iv
from .ordered import ordered_scan, prev, row_number, running_sum, spread_join
from .rollup import fingerprint

SPOKEN = 0.8  # the share of the talk in a clip that makes it one speaker's
TOLERANCE = 20_000  # how far from a silence an edge may lie and still be in it


def _told(df: DataFrame, what: str, a: str, b: str, text) -> DataFrame:
    """Rows of one input as the build's id reads them."""
    return df.select(F.lit(what).alias("what"), "key", F.col(a).alias("a"), F.col(b).alias("b"), text.cast("string").alias("text"))


def build_timeline(assets: DataFrame, segments: DataFrame, silences: DataFrame, scenes: DataFrame, dark: DataFrame, frozen: DataFrame, turns: DataFrame,
                   least: int, width: int, chunk_width: int, version: str) -> DataFrame:
    """Lay every file out as sentences and the stretches between them, measured and named.

    assets(key, begin, fin, has_audio), segments(key, id, s, e, text, made_up), silences(key, qs, qe), scenes(key, cut),
    dark(key, ds, de), frozen(key, fs, fe), turns(key, speaker, ts, te). Stretches without speech are cut at shot changes. A clip is speech if
    it has text that was not made up and can be heard. The id of the build is the hash of all its inputs, so the same footage gives the same
    ids anywhere, and another shot change other ids. Segments and spans of a file without an asset are left out.
    """
    build = fingerprint(
        _told(assets, "asset", "begin", "fin", F.col("has_audio")).unionByName(_told(segments, "segment", "s", "e", F.concat_ws("/", "id", "made_up", "text")))
        .unionByName(_told(silences, "silence", "qs", "qe", F.lit(""))).unionByName(_told(scenes, "scene", "cut", "cut", F.lit("")))
        .unionByName(_told(dark, "dark", "ds", "de", F.lit(""))).unionByName(_told(frozen, "frozen", "fs", "fe", F.lit("")))
        .unionByName(_told(turns, "turn", "ts", "te", F.col("speaker"))).withColumn("__one", F.lit(1)), ["__one"], ["what", "key", "a", "b", "text"], version)
    name = F.lit("tl_" + (build.first() or {"fingerprint": ""})["fingerprint"][:8])
    said = ordered_scan(segments, ["key"], ["s", "id"], None, {"__pe": prev(F.col("e"))})
    said = spread_join(said, assets, "key").withColumn("s", F.greatest(F.coalesce("__pe", F.col("begin")), F.col("s"))).withColumn(
        "e", F.least("e", "fin")).where("e > s").select("key", "id", "s", "e", "text", "made_up", "begin", "fin")
    edges = cut_lineage(ordered_scan(said, ["key"], ["s", "id"], None, {"__pe": prev(F.col("e"))}))
    between = edges.select("key", F.coalesce("__pe", "begin").alias("gs"), F.col("s").alias("ge"))
    tail = assets.join(edges.groupBy("key").agg(F.max("e").alias("__last")), "key", "left").select(
        "key", F.coalesce("__last", "begin").alias("gs"), F.col("fin").alias("ge"))
    gaps = between.unionByName(tail).where("ge > gs").withColumn("gap", F.col("gs"))
    quiet = iv.split_gaps(gaps, scenes, ["key"], "gap", ("gs", "ge"), "cut", least, width, chunk_width)
    stretches = cut_lineage(edges.select("key", "s", "e", "text", "made_up").unionByName(quiet.select("key", "s", "e", F.lit("").alias("text"), F.lit(False).alias("made_up"))))
    # Clips are numbered over all files: within a file by time, and each file starts where the one before it ended.
    counts = stretches.groupBy("key").agg(F.count(F.lit(1)).alias("__c")).withColumn("__one", F.lit(1))
    starts = ordered_scan(counts, ["__one"], ["key"], None, {"__from": running_sum(F.col("__c"), inclusive=False)}).join(assets, "key")
    placed = ordered_scan(stretches, ["key"], ["s"], None, {"__i": row_number()})
    placed = spread_join(placed, starts.select("key", "__from", "fin", "has_audio"), "key")
    clips = cut_lineage(placed.withColumn("id", F.concat(name, F.lit(":u"), F.format_string("%04d", F.col("__from") + F.col("__i") - 1))).drop("__from", "__i"))
    # Everything that lies over a clip meets it in one join.
    marks = silences.select("key", F.lit("silence").alias("what"), F.col("qs").alias("ms"), F.col("qe").alias("me")).unionByName(
        dark.select("key", F.lit("black").alias("what"), F.col("ds").alias("ms"), F.col("de").alias("me"))).unionByName(
        frozen.select("key", F.lit("frozen").alias("what"), F.col("fs").alias("ms"), F.col("fe").alias("me")))
    marks = iv.coalesce_spans(marks.withColumn("__tie", F.col("me")), ["key", "what"], "ms", "me", "__tie", chunk_width).select(
        "key", "what", "ms", "me", F.lit(None).cast("string").alias("who"))
    over = marks.unionByName(turns.select("key", F.lit("turn").alias("what"), F.col("ts").alias("ms"), F.col("te").alias("me"), F.col("speaker").alias("who")))
    met = iv.overlap_join(clips.select("key", "id", "s", "e"), over, ["key"], ("s", "e"), ("ms", "me"), width)
    held = met.groupBy("id", "what", "who").agg(F.sum(iv.overlap_length("s", "e", "ms", "me")).alias("held"))
    talk = F.when(F.col("what") == "turn", F.col("held"))
    sums = [F.coalesce(F.sum(F.when(F.col("what") == w, F.col("held"))), F.lit(0)).alias(f"__{w}") for w in ("silence", "black", "frozen")]
    held = held.groupBy("id").agg(*sums, F.min(F.when(talk.isNotNull(), F.struct((-F.col("held")).alias("h"), "who"))).alias("__top"), F.sum(talk).alias("__talk"))
    # Both edges of a clip look for their silence in one join.
    at = clips.select("key", "id", F.inline(F.array(F.struct(F.lit("in").alias("edge"), F.col("s").alias("at")), F.struct(F.lit("out").alias("edge"), F.col("e").alias("at")))))
    near = iv.point_join(at, silences.select("key", "qs", "qe"), ["key"], "at", ("qs", "qe"), width, edges="[]", tolerance=TOLERANCE)
    length = F.col("qe") - F.col("qs")
    room = near.groupBy("id").agg(F.max(F.when(F.col("edge") == "in", F.least(F.col("at") - F.col("qs"), length))).alias("__in"),
                                  F.max(F.when(F.col("edge") == "out", F.least(F.col("qe") - F.col("at"), length))).alias("__out"))
    zero = F.lit(0).cast("long")
    j = clips.join(held, "id", "left").join(room, "id", "left").fillna(0, ["__silence", "__black", "__frozen"])
    j = j.select("*", *[F.round(iv.share(f"__{w}", "s", "e"), 3).alias(w) for w in ("silence", "black", "frozen")])
    kind = clip_kind((F.trim("text") != "") & ~F.col("made_up"), F.col("has_audio"), F.col("silence"), F.col("black"), F.col("frozen"))
    speaker = F.when(-F.col("__top.h") / F.col("__talk") >= SPOKEN, F.col("__top.who"))
    return j.withColumn("kind", kind).select(
        "id", "key", "s", "e", F.greatest(zero, F.least(F.coalesce("__in", zero), F.col("s"))).alias("safe_in"),
        F.greatest(zero, F.least(F.coalesce("__out", zero), F.col("fin") - F.col("e"))).alias("safe_out"),
        "kind", "text", "silence", "black", "frozen", F.when(F.col("kind") == "speech", speaker).alias("speaker"))
