"""What several of these operators share: the white space they agree on, and a few small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six ASCII white-space characters that every contract here names, as Java, RE2 and Python all read them.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def two_columns(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Only the id and the whole text (null: empty), renamed, so that no other column of the table can clash."""
    return docs.select(F.col(id).cast("long").alias("id"), text_or_empty(text).alias("text"))


def partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], n: str = "n", lot: str = "lot") -> DataFrame:
    """Left join of ``rows`` to a table that has each key once, with the number ``n`` of rows under it, in which no key meets in one task.

    The keys with more than 10,000 rows and more than a ten-thousandth of all are fewer than 10,000, so those are broadcast; their rows go
    on under ``lot``, a number of each row that was given where the rows were read and is not 0. Keys must not be null.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    line = max(10_000, total // 10_000)
    own = [c for c in table.columns if c not in on]
    few = F.broadcast(table.where(F.col(n) > line).select(*on, F.struct(*own).alias("__few")))
    rest = table.where(F.col(n) <= line).select(*on, F.lit(0).cast("long").alias("__lot"), F.struct(*own).alias("__rest"))
    met = rows.join(few, on, "left").withColumn("__lot", F.when(F.col("__few").isNull(), F.lit(0)).otherwise(F.col(lot)).cast("long"))
    met = met.join(rest, [*on, "__lot"], "left").withColumn("__own", F.coalesce("__few", "__rest"))
    return met.select(*rows.columns, *(F.col(f"__own.{c}").alias(c) for c in own))
