"""Structured Streaming twins: levels, sittings, first sightings, latest state, abandoned jobs.

Every stream reads files as they come, keeps state behind a watermark, and writes to a folder that the caller names, with the stream's state
beside it: a second run with that folder goes on where the first stopped. ``run`` drains what is there and ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rollup import decibels, power
from ..session import shared_folder
from ..sources.keyed import KeyedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(folder)


def replayed(rows: DataFrame, order: str, parts: int, drain: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Let rows come in ``parts`` sets of files, each drained by a stream of its own that goes on from the state of the one before.

    Part n has the rows whose ``order``, a whole number (null: first), lies in the n-th of as many equal stretches between the least and the largest.
    ``drain`` gets the stream of files and the folder of its state and output. A row is late if what it belongs to ended before
    the watermark of the parts before its own.
    """
    spark = rows.sparkSession
    folder, out = shared_folder(spark, "replay"), shared_folder(spark, "stream")
    least, most = rows.agg(F.min(order), F.max(order)).first()
    at = F.coalesce(F.expr(f"CAST((`{order}` - {least or 0}) * {parts} div {(most or 0) - (least or 0) + 1} AS INT)"), F.lit(0))
    for part in range(parts):
        rows.where(at == part).write.mode("append").parquet(folder)
        found = drain(file_stream(spark, folder, "*.parquet", rows.schema), out)
    return found


def run(stream: DataFrame, folder: str | None = None, mode: str = "append") -> DataFrame:
    """Drain a stream into ``folder`` (a new one if none is named) and read all it has written there, in this run and earlier ones."""
    spark = stream.sparkSession
    out = folder or shared_folder(spark, "stream")
    q = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode(
        mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def levels(events: DataFrame, key: str, at: str, db: str, delay: str, size: str, slide: str | None = None) -> DataFrame:
    """Energy mean and peak per key and window; late rows past the watermark are dropped."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = events.withWatermark(at, delay).groupBy(key, w).agg(
        F.avg(power(F.col(db))).alias("__e"), F.max(db).alias("peak"), F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), decibels(F.col("__e")).alias("level"), "peak", "n")


def sessions(events: DataFrame, key: str, at: str, delay: str, gap: str) -> DataFrame:
    """Sittings: rows of a key no further apart than the gap."""
    g = events.withWatermark(at, delay).groupBy(key, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: Sequence[str], at: str, delay: str) -> DataFrame:
    """One row per combination, whatever is replayed within the delay."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys)).select(*keys)


def upsert_stream(events: DataFrame, table: KeyedTable, folder: str) -> DataFrame:
    """Latest state per key from a stream: each batch is merged into the buckets of ``table`` it touches, once, whatever is repeated. ``folder`` holds
    the stream's state, so a second run merges only what came since. A stream without any batch leaves the table as it was."""
    q = events.writeStream.foreachBatch(lambda batch, epoch: table.merge(batch, epoch) and None).option(
        "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if table.latest_version() is None:
        return events.sparkSession.createDataFrame([], events.schema)
    return table.read()


class Abandoned(StatefulProcessor):
    """Reports a key that has gone quiet: after ``short`` milliseconds when its last sign said the worker was
    gone, after ``long`` whatever it said. State is one timestamp and one flag a key."""

    def __init__(self, short: int, long: int):
        self.short, self.long = short, long

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, us long, gone boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        best = (held[1], held[2]) if held is not None else None
        for pdf in rows:
            top = pdf.loc[pdf["us"].idxmax()]
            if best is None or int(top["us"]) > best[0]:
                best = (int(top["us"]), bool(top["gone"]))
        if held is not None:
            self.handle.deleteTimer(held[0])
        due = best[0] // 1000 + (self.short if best[1] else self.long)
        self.last.update((due, best[0], best[1]))
        self.handle.registerTimer(due)
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "last_us": pd.Series([], dtype="int64"), "why": pd.Series([], dtype="object")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, us, gone = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"key": [key[0]], "last_us": [us], "why": ["worker gone" if gone else "silent"]})

    def close(self) -> None:
        pass


def abandoned(beats: DataFrame, key: str, at: str, delay: str, short: int, long: int) -> DataFrame:
    """Keys whose heartbeats stopped. ``beats`` has the key, the event time, ``us`` and ``gone``. Runs under ``rocksdb_state``."""
    return beats.withWatermark(at, delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=Abandoned(short, long), outputStructType="key long, last_us long, why string",
        outputMode="Append", timeMode="EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """While open, streams started in this session keep their state in RocksDB, as timers need; the session's setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
