"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import WORD, partitions, text_or_empty
from spanloom.session import cut_lineage


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def unit_hash(value: Column) -> Column:
    """A number in [0, 1) drawn from a value, the same in every run."""
    return F.conv(F.substring(F.md5(F.encode(value, "UTF-8")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per source (source, source_size), the share of the whole that its weight gives it, never above ``most`` times its size.

    Sources take the weights in turn, by code point, null last. What a stopped source leaves is shared among the others
    by weight, until none is above: sources are stopped in order of the level (size a unit of weight) they can reach, so one
    running sum in that order finds the level at which the rest ends. The table has one row per source of the mix, a list
    that people write by hand, so its windows need no key.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    s = sources.withColumn("rank", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most)
    reach = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = W.orderBy((F.col("cap") / F.col("weight")).desc(), F.col("rank").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    s = s.withColumn("whole", F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    s = s.withColumn("left", F.col("whole") - F.sum("cap").over(reach) + F.col("cap")).withColumn("weights_left", F.sum("weight").over(rest))
    # A source is stopped when what is left, shared by weight, is more than it may take. Reach only grows, so the stopped come first.
    stopped = F.col("cap") * F.col("weights_left") <= F.col("left") * F.col("weight")
    level = F.min(F.when(~stopped, F.struct(-F.col("weights_left"), "left", "weights_left"))).over(
        W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    s = s.withColumn("stopped", stopped).withColumn("level", level)
    shared = F.col("weight").cast("double") * F.col("level.left").cast("double") / F.col("level.weights_left").cast("double")
    return s.select("source", "source_size", F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3),
        most: int = 3, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies and taken (= copies * size).

    Inside a source the rows lie in order of size, then of a hash of the id, and each adds target / source_size expected
    copies to the running sum, which starts at one random offset per source. A row is emitted once per integer that the
    sum passes. Since neighbours have nearly the same size, a source's taken words miss its target by no more than its
    longest text. No row is emitted more than ``most`` times.

    Null texts and texts without words have size 0; they are emitted as often as any other and take no words. A source
    without words has target 0 and its rows are not emitted. A null source is a source. Equal rows are drawn one by one.
    An empty table gives an empty result. Other columns are not looked at.
    """
    rows = _sized(docs, id, text, source)
    # Ranges of the order, written once: a hot source is many ranges, and row numbers need only the counts before a range.
    rows = cut_lineage(rows.repartitionByRange(partitions(docs), F.col("source"), F.col("size"), F.col("tie"))
                       .withColumn("piece", F.spark_partition_id()))
    number = F.row_number().over(W.partitionBy("source", "piece").orderBy("size", "tie", "id")).cast("long") - 1
    out = _drawn(rows.withColumn("number", number), _shares(rows, weights, most), seed)
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _sized(docs: DataFrame, id: str, text: str, source: str, *more: Column) -> DataFrame:
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(source).cast("string").alias("source"), words(text_or_empty(text)).alias("size"), *more)
    return rows.withColumn("tie", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))


def _shares(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Per range (__s, __p), no more of them than pieces and sources together: rows before it in its source, source_size and target."""
    pieces = rows.groupBy("source", "piece").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    before = pieces.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("piece")) - F.col("n"))
    share = targets(pieces.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    known = before.select("source", "piece", "before").join(share.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    return known.select(F.col("source").alias("__s"), F.col("piece").alias("__p"), "before", "source_size", "target")


def _drawn(rows: DataFrame, known: DataFrame, seed: str) -> DataFrame:
    """The rows, numbered in their range, with the columns of ``_shares`` and copies."""
    out = rows.join(known, F.col("source").eqNullSafe(F.col("__s")) & (F.col("piece") == F.col("__p")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = unit_hash(F.concat(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")), F.lit("|" + seed)))
    at = F.col("number") + F.col("before")
    return out.withColumn("copies", F.floor((at + 1) * rate + start) - F.floor(at * rate + start))


def repeated(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3),
             most: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it.

    Rows go through the ranges whole, so nothing is brought together by id: rows without one, or repeated under one, are dealt by
    a hash of the text and then singly, and a range numbers its rows as they lie, in the order of ``mix``.
    """
    rows = _sized(docs, id, text, source, F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(text_or_empty(text)).alias("content"))
    rows = rows.withColumn("nth", F.monotonically_increasing_id())
    order = [F.col(c) for c in ("source", "size", "tie", "id", "content", "nth")]
    rows = rows.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    rows = cut_lineage(rows.select("source", "size", "row", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("place")))
    first = rows.groupBy("source", "piece").agg(F.min("place").alias("first")).withColumnRenamed("source", "__of")
    known = _shares(rows, weights, most).join(first, F.col("__s").eqNullSafe(F.col("__of")) & (F.col("__p") == F.col("piece"))).drop("__of", "piece")
    # The few ranges go to the rows, whose texts are not shuffled again.
    out = _drawn(rows.withColumn("number", F.col("place")), known.withColumn("before", F.col("before") - F.col("first")).hint("broadcast"), seed)
    return out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
