"""Exact dedup by skew-safe combining.

Equal texts are brought together in three steps, each of which compares whole contents, not just digests: inside a
task before anything is shuffled, then per (digest, salt), then per digest over the salts' winners. A group of copies that
holds a third of all rows reaches the last step as at most ``salts`` rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import SPACES, text_or_empty
from spanloom.session import cut_lineage


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(text, SPACES + "+", "")


def sha256(content: Column) -> Column:
    return F.sha2(F.encode(content, "UTF-8"), 256)


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = without_spaces,
                 digest: Callable[[Column], Column] = sha256, salts: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, digest, keep_id, group_size and kept.

    Rows are equal when their normalised texts are identical. The row with the most code points in its original text
    stays, then the one with the smallest id; a null id comes after every other.
    Null texts count as empty, and all empty texts are one group. Rows repeated under one id are members like any other,
    and each repeat of the winning id is ``kept``. An empty table gives an empty result. Other columns are not looked at.
    The digest only routes rows: should two contents share one, they stay two groups.
    """
    body = text_or_empty(text)
    rows = docs.select(F.col(id).cast("long").alias("id"), body.alias("body")).select(
        "id", F.length("body").alias("size"), normalise(F.col("body")).alias("content"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    rows = rows.withColumn("digest", digest(F.col("content")))
    # The smallest of these structs is the row that stays.
    order = F.struct((-F.col("size")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id"))
    salted = rows.groupBy("digest", "salt", "content").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
    # Rows of a digest meet in one partition and are combined by content there, at most ``salts`` rows for a content.
    merged = (salted.repartition("digest").groupBy("digest", "content")
              .agg(F.min("best").alias("best"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")))
    merged = cut_lineage(
        merged.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.collect_list(F.struct("best.id", "n", "salts")).alias("groups"))
        .select("digest", F.expr("contents > 1").alias("shared"), F.explode("groups").alias("g"))
        .select("digest", "shared", F.col("g.id").alias("keep_id"), F.col("g.n").alias("group_size"), F.explode("g.salts").alias("salt")))
    # Back to the documents by digest and salt, so that a hot group is spread over its salts here too.
    back = rows.select("id", "digest", "salt").join(
        merged.where(~F.col("shared")).select("digest", "salt", "keep_id", "group_size"), ["digest", "salt"])
    if not merged.where("shared").isEmpty():  # a digest with two contents: those rows are joined by content
        both = rows.join(merged.where("shared").select("digest").distinct(), "digest", "left_semi")
        winners = both.groupBy("digest", "content").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
        back = back.unionByName(both.join(winners, ["digest", "content"]).select(
            "id", "digest", "salt", F.col("best.id").alias("keep_id"), "group_size"))
    return back.select("id", "digest", "keep_id", "group_size", F.expr("id <=> keep_id").alias("kept"))


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows repeated under a kept id all stay if they are equal
    to the winner; a row under that id with another text is judged in its own group."""
    keep = exact_groups(docs, id, text).where("kept").select(F.col("id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    rows = docs.withColumn("__digest_of", sha256(without_spaces(text_or_empty(text))))
    return rows.join(keep, F.col(id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest_of") == F.col("__digest")), "left_semi").drop("__digest_of")
