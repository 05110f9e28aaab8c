"""Rolling measurements up onto spans, keys and jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import exact_quantiles, ordered_scan, rank_picks, row_number, running_sum, spread_join, total_sum

# Fixed value: the level of digital silence.
SILENCE_DB = -120.0


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean by weight over the rows that have a value; the plain mean where nothing weighs anything."""
    w = F.sum(F.when(value.isNotNull(), weight))
    return F.when(w > 0, F.sum(value * weight) / w).otherwise(F.avg(value))


def power(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def decibels(energy: Column, floor: float = SILENCE_DB) -> Column:
    return F.when(energy > 0, F.greatest(F.lit(floor), 10 * F.log10(energy))).otherwise(
        F.when(energy.isNotNull(), F.lit(floor)))


def energy_mean(db: Column, weight: Column) -> Column:
    """Mean of decibels by the energy they stand for."""
    return decibels(weighted_mean(power(db), weight))


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, width: float, name: str) -> DataFrame:
    """The measured value that covers the middle of the total weight.

    Equal values are summed first, then run up in value order chunk by chunk; no group is gathered.
    """
    keys = list(keys)
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    run = ordered_scan(sums, keys, [value], F.floor(F.col(value) / F.lit(width)), {
        "__to": running_sum(F.col("__w")), "__all": total_sum(F.col("__w"))})
    return run.where(2 * F.col("__to") >= F.col("__all")).groupBy(*keys).agg(F.min(value).alias(name))


@dataclass(frozen=True)
class Rule:
    """How a score combines: mean, energy, max or median; decimals kept; whether it is about the content."""

    combine: str = "mean"
    decimals: int = 3
    content: bool = False


# How each score combines.
SCORE_RULES = {
    "speech": Rule(content=True), "silence": Rule(content=True), "black": Rule(content=True),
    "frozen": Rule(content=True), "words_per_second": Rule(content=True),
    "exposure": Rule(decimals=4), "contrast": Rule(decimals=4), "motion": Rule(decimals=4), "shake": Rule(decimals=5),
    "warmth": Rule(decimals=4), "loudness": Rule("energy", 2), "peak": Rule("max", 2), "noise_floor": Rule("median", 2),
    "flatness": Rule("max"), "face_share": Rule(decimals=4), "face_x": Rule(decimals=4), "face_y": Rule(decimals=4),
}


def _rounded(value: Column, name: Column, rules: Mapping[str, Rule]) -> Column:
    out = F.round(value, Rule().decimals)
    for n, r in rules.items():
        out = F.when(name == n, F.round(value, r.decimals)).otherwise(out)
    return out


def combine_scores(parts: DataFrame, ids: Sequence[str], name: str, value: str, weight: str,
                   rules: Mapping[str, Rule] = SCORE_RULES, whole: DataFrame | None = None, length: str = "whole",
                   width: float = 1.0) -> DataFrame:
    """One number per span and score out of its weighted parts; an unmeasured score has no row.

    With ``whole`` (ids and the length of the span) a content score is spread over the whole length, so a
    part without it counts as zero there.
    """
    ids = list(ids)
    parts = parts.where(F.col(value).isNotNull())
    by = {k: [n for n, r in rules.items() if r.combine == k] for k in ("energy", "max", "median")}
    n, v, w = F.col(name), F.col(value), F.col(weight)
    mean, energy = weighted_mean(v, w), energy_mean(v, w)
    value_of = F.when(n.isin(by["energy"]), energy).when(n.isin(by["max"]), F.max(v)).otherwise(mean)
    straight = parts.where(~n.isin(by["median"])) if by["median"] else parts
    weighed = [F.sum(w).alias("__w")] if whole is not None else []  # only the whole length asks for it
    out = straight.groupBy(*ids, name).agg(value_of.alias("value"), *weighed)
    if by["median"]:
        typical = parts.where(n.isin(by["median"]))
        middle = weighted_median(typical, [*ids, name], value, weight, width, "value")
        out = out.unionByName(middle.join(typical.groupBy(*ids, name).agg(*weighed), [*ids, name]) if weighed else middle)
    value = F.col("value")
    if whole is not None:
        out = out.join(whole, ids)
        content = n.isin([k for k, r in rules.items() if r.content])
        value = F.when(content & (F.col(length) > 0), value * F.col("__w") / F.col(length)).otherwise(value)
    return out.select(*ids, name, _rounded(value, n, rules).alias("value"))


def gated_mean(blocks: DataFrame, keys: Sequence[str], level: str, absolute: float = -70.0, relative: float = 10.0) -> DataFrame:
    """Integrated loudness: blocks over an absolute gate, then over a gate below their own mean energy."""
    keys = list(keys)
    loud = blocks.where(F.col(level) > absolute).withColumn("__e", power(F.col(level)))
    floor = loud.groupBy(*keys).agg((F.avg("__e") * 10 ** (-relative / 10)).alias("__floor"))
    kept = spread_join(loud, floor, keys).where(F.col("__e") > F.col("__floor"))
    found = kept.groupBy(*keys).agg((10 * F.log10(F.avg("__e"))).alias("lufs"))
    return blocks.select(*keys).distinct().join(found, keys, "left")


def fold_samples(inside: DataFrame, ids: Sequence[str], value: str, order: Column) -> DataFrame:
    """Mean of the samples in each span, and of those after the first (NULL for a lone one): the first
    sample of a span measures the cut into it."""
    n, total = F.count(F.col(value)), F.sum(value)
    return inside.groupBy(*ids).agg(
        n.alias("n"), (total / n).alias("mean"),
        F.when(n > 1, (total - F.min_by(value, order)) / (n - 1)).alias("moving"))


def jitter(inside: DataFrame, ids: Sequence[str], dx: str, dy: str, order: Sequence[str], chunk: Column) -> DataFrame:
    """Mean length of the change between neighbouring displacements of a span, its first one dropped."""
    from .ordered import prev
    seen = ordered_scan(inside, ids, order, chunk, {"__n": row_number(), "__x": prev(F.col(dx)), "__y": prev(F.col(dy))})
    change = F.sqrt(F.pow(F.col(dx) - F.col("__x"), 2) + F.pow(F.col(dy) - F.col("__y"), 2))
    return seen.groupBy(*ids).agg(F.avg(F.when(F.col("__n") >= 3, change)).alias("shake"))


def talk_gains(clips: DataFrame, heard: DataFrame, key: str, ident: str, kept: str, level: str, talk: str,
               target: float = -20.0, under: float = 10.0, limit: float = 12.0, least: int = 3, quiet: float = -60.0) -> DataFrame:
    """The gain of each clip: its talk to the target; a clip without talk only ever turned down; a kept one
    moves with the typical clip. ``heard`` is the seconds of each clip with their level and talk flag."""
    e = power(F.col(level))
    per = heard.groupBy(key, ident).agg(
        F.sum(F.col(talk).cast("long")).alias("__n"), F.avg(F.when(F.col(talk), e)).alias("__t"),
        F.avg(F.when(F.col(level) > quiet, e)).alias("__h"))
    # Clips share seconds, so the whole file's talk is averaged over its own seconds, given once.
    whole = heard.where(F.col(talk)).dropDuplicates([key, "sec"]).groupBy(key).agg(F.avg(e).alias("__w"))
    j = clips.join(per, [key, ident])
    j = spread_join(j, whole, key, "left")
    spoken = target - 10 * F.log10(F.when(F.col("__n") < least, F.col("__w")).otherwise(F.col("__t")))
    ambience = F.least(F.lit(0.0), target - under - 10 * F.log10("__h"))
    gain = F.when(F.col("__n") > 0, spoken).otherwise(ambience)
    moved = j.where(~F.col(kept)).withColumn("gain", F.round(F.greatest(F.lit(-limit), F.least(F.lit(limit), gain)), 2)).where(
        F.col("gain").isNotNull())
    middle = rank_picks(moved, [key], "gain", {"__m": F.floor(F.col("__total") / 2)}, 0.25).select(key, "__m")
    still = spread_join(j.where(F.col(kept)), middle, key, "left").withColumn("gain", F.coalesce("__m", F.lit(0.0)))
    return moved.select(key, ident, "gain").unionByName(still.select(key, ident, "gain"))


def fingerprint(df: DataFrame, keys: Sequence[str], columns: Sequence[str], version: str) -> DataFrame:
    """Content hash of each group that the order of its rows cannot change.

    Four 32-bit lanes of each row's MD5 are summed, so the group is combined map-side and never gathered or
    sorted; the sums, the row count and the version of the rules are hashed together.
    """
    def told(c):
        """A value led by its length, so that no two rows can read the same; NULL has no length."""
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    h = F.md5(F.concat(*map(told, columns)))
    lanes = [F.sum(F.conv(F.substring(h, 1 + 8 * n, 8), 16, 10).cast("long")).cast("string") for n in range(4)]
    return df.groupBy(*keys).agg(F.sha2(F.concat_ws(
        "/", F.lit(version), F.count(F.lit(1)).cast("string"), *lanes), 256).alias("fingerprint"))


def recent(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each group before the shuffle, so a hot group sends
    at most ``n`` rows a task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def stage_profile(runs: DataFrame, job: str, stage: str, seconds: str, memory: str, width: float = 1.0) -> DataFrame:
    """Per stage (digits collapsed): jobs, total and share of the time, median, peak memory."""
    named = runs.withColumn("stage", F.regexp_replace(F.col(stage), r"\d+", "#"))
    # Jobs are counted in two steps instead of a distinct inside the aggregation.
    per_job = named.groupBy("stage", job).agg(F.sum(seconds).alias("s"), F.max(memory).alias("m"))
    per = per_job.groupBy("stage").agg(F.count(F.lit(1)).alias("jobs"), F.sum("s").alias("total"), F.max("m").alias("memory"))
    whole = per.agg(F.sum("total").alias("__all"))
    mid = exact_quantiles(named, ["stage"], seconds, {"median": 0.5}, width)
    # One row by construction.
    return per.crossJoin(F.broadcast(whole)).join(mid, "stage").select(
        "stage", "jobs", "total", (F.col("total") / F.col("__all")).alias("share"), "median", "memory")
