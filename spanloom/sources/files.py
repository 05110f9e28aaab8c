"""Files as rows: folder listings and recording times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """One row per file with its size and time; the content column is pruned, so no file is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.col("length").alias("bytes"), "modificationTime")


# Fixed value: a time written into a file's name.
NAMED_TIME = r"(20\d\d)-?(\d\d)-?(\d\d)[_\-T ]?(\d\d)-?(\d\d)-?(\d\d)"


def recorded_at(tag: Column, name: Column) -> Column:
    """The container's time where a camera with a set clock wrote it, else the time in the name, else NULL."""
    tagged = F.try_to_timestamp(tag)
    found = F.when(name.rlike(NAMED_TIME), F.regexp_replace(
        F.regexp_extract(name, NAMED_TIME, 0), r"\D", ""))
    return F.coalesce(F.when(F.year(tagged) > 2000, tagged), F.try_to_timestamp(found, F.lit("yyyyMMddHHmmss")))


def usage(files: DataFrame, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """Bytes by kind of file; ``rules`` are (pattern, kind, clearable), the first that matches counts."""
    kind, clear = F.lit("other"), F.lit(False)
    for pattern, name, clearable in reversed(rules):
        kind = F.when(F.col("path").rlike(pattern), name).otherwise(kind)
        clear = F.when(F.col("path").rlike(pattern), clearable).otherwise(clear)
    return files.groupBy(kind.alias("kind"), clear.alias("clearable")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
