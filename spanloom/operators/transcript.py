"""Rules over words and the sentences they make up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import by_width, islands, prev

# Lines a speech model writes that nobody said (subtitle credits, a channel's plea, a sign-off).
MADE_UP_LINES = (
    r"^中文字幕|字幕[組组由提供志]",
    r"不吝[點点][贊赞讚]|[點点]{2}[欄栏]目",
    r"^([謝谢][謝谢]|感[謝谢]|多[謝谢])(觀看|观看|收看|收聽|收听)$",
)
MADE_UP_EMPTY_SHARE, MADE_UP_REPEATS = 0.5, 6
MADE_UP_FIRST_PROBABILITY, MADE_UP_PROBABILITY = 0.02, 0.1


def bare(text: Column) -> Column:
    """What is said: no spaces, no punctuation."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def made_up(segments: DataFrame, words: DataFrame, ids: Sequence[str], order: str, chunk: int) -> DataFrame:
    """Flag sentences the recogniser invented.

    ``words`` has s, e, text and prob (NULL where not kept). The word rules need one roll-up per sentence
    and the longest run of one repeated word; both combine map-side.
    """
    ids = list(ids)
    said = words.withColumn("__said", bare(F.col("text")))
    runs = islands(said, ids, [order], by_width(order, chunk), {"__p": prev(F.col("__said"))},
                   (F.col("__said") != F.col("__p")) | (F.col("__said") == ""))
    longest = runs.groupBy(*ids, "grp").agg(F.count(F.lit(1)).alias("__run")).groupBy(*ids).agg(
        F.max("__run").alias("__run"))
    rolled = words.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("__n"), F.sum((F.col("e") <= F.col("s")).cast("long")).alias("__empty"),
        F.sum(F.col("prob").isNull().cast("long")).alias("__unknown"),
        F.min_by("prob", order).alias("__first"), F.avg("prob").alias("__mean"))
    j = segments.join(rolled, ids, "left").join(longest, ids, "left")
    boilerplate = bare(F.col("text")).rlike("|".join(f"(?:{p})" for p in MADE_UP_LINES))
    sure = F.col("__unknown") == 0
    flag = (boilerplate | (F.col("__empty") / F.col("__n") >= MADE_UP_EMPTY_SHARE)
            | (F.col("__run") >= MADE_UP_REPEATS)
            | (sure & (F.col("__first") < MADE_UP_FIRST_PROBABILITY) & (F.col("__empty") > 0))
            | (sure & (F.col("__mean") < MADE_UP_PROBABILITY)))
    return j.withColumn("made_up", F.coalesce(flag, F.lit(False))).select(*segments.columns, "made_up")
