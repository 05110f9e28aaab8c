"""Writing results: upserts, append-only versions, caption and chapter files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import nxt, ordered_scan, spread_join


def latest(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The row of each key with the highest version, by one combined aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("__r"))
    return picked.select(*keys, "__r.*")


def append_versions(path: str, rows: DataFrame) -> None:
    """Append rows to a version log; nothing in it is ever rewritten, and a write that fails leaves no row."""
    rows.write.mode("append").parquet(path)


def current(versions: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The newest version of each key with how many there are."""
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("__r"),
                                       F.count(F.lit(1)).alias("versions")).select(*keys, "__r.*", "versions")


def srt_time(us: Column) -> Column:
    """HH:MM:SS,mmm of whole microseconds."""
    ms = F.floor((us + 500) / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60,
                           F.floor(ms / 1000) % 60, ms % 1000)


def srt_blocks(cues: DataFrame, n: str = "n", text: str = "text") -> DataFrame:
    """Each placed caption as its block of an SRT file."""
    return cues.withColumn("block", F.concat(
        F.col(n).cast("string"), F.lit("\n"), srt_time(F.col("s")), F.lit(" --> "), srt_time(F.col("e")),
        F.lit("\n"), F.col(text), F.lit("\n")))


LISTERS = 32  # tasks that list the folders of a table; by default Spark starts one for each folder


def _store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri("file://" + folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def _folder(key: str, value: object) -> str:
    """A key's folder as Spark names and reads it."""
    escaped = re.sub(r"[\x00-\x1f\"#%'*/:=?\\\x7f{}\[\]^]", lambda m: f"%{ord(m[0]):02X}", "" if value is None else str(value))
    return f"{key}={escaped or '__HIVE_DEFAULT_PARTITION__'}"


def _files(path: str, key: str):
    """Writes rows (key, block), sorted by key, to one file for each key; a file gets its name when it is whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _store(path)
        name, draft, now, out, written = f"part-{TaskContext.get().partitionId():05d}.txt", f"{base}/_temporary/{uuid.uuid4().hex}", None, None, 0

        def close():
            out.close()
            files.create_dir(f"{base}/{now}", recursive=False)
            files.move(draft, f"{base}/{now}/{name}")
        for batch in batches:
            for value, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = _folder(key, value)
                if folder != now:
                    if out:
                        close()
                    now, out, written = folder, files.open_output_stream(draft), written + 1
                out.write(((block or "") + "\n").encode())
        if out:
            close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})
    return run


def write_srt(blocks: DataFrame, path: str, key: str, n: str = "n") -> None:
    """One folder per key, its files in order of their names: range partitioning keeps a huge key in several files. Blocks are
    divided by an empty line, so none inside a caption survives: they become one line break.

    The tasks write the files through ``pyarrow.fs``: Spark's writer spends tens of milliseconds on each of them where a folder's
    rights are set by a process of their own, and there are as many as keys."""
    files, base = _store(path)
    files.create_dir(f"{base}/_temporary", recursive=True)
    one = F.concat(F.regexp_replace(F.regexp_replace("block", "\n+$", ""), "\n{2,}", "\n"), F.lit("\n"))
    rows = blocks.repartitionByRange(key, n).sortWithinPartitions(key, n).select(key, one.alias("block"))
    rows.mapInArrow(_files(path, key), "files long").agg(F.sum("files")).first()
    files.delete_dir(f"{base}/_temporary")
    files.open_output_stream(f"{base}/_SUCCESS").close()


def read_srt(spark: SparkSession, path: str, key: str, kind: str, n: str = "n") -> DataFrame:
    """The blocks that ``write_srt`` wrote: key, number and block."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, LISTERS)
    try:  # the folders are listed here
        lines = spark.read.schema(f"value string, `{key}` {kind}").option("lineSep", "\n\n").text(path)
    finally:
        spark.conf.set(name, before)
    return lines.select(key, F.substring_index("value", "\n", 1).cast("long").alias(n), F.concat("value", F.lit("\n")).alias("block"))


def chapters(markers: DataFrame, totals: DataFrame, key: str, at: str, name: str, tie: str, chunk: Column) -> DataFrame:
    """Markers before the end of the cut, each running to the next or to the end."""
    inside = spread_join(markers, totals, key).where(F.col(at) < F.col("total"))
    seen = ordered_scan(inside, [key], [at, tie], chunk, {"__n": nxt(F.col(at))})
    return seen.select(key, F.col(name).alias("name"), F.col(at).alias("s"),
                       F.coalesce("__n", "total").alias("e"))


def chapter_problems(listed: DataFrame, keys: DataFrame, key: str, least: int = 3, shortest: int = 10_000_000) -> DataFrame:
    """Rules a platform holds chapters to: one row per problem."""
    per = keys.join(listed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first")), key, "left")
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    rules = F.array(
        F.when(n == 0, F.struct(F.lit("none").alias("problem"), n.alias("figure"))),
        F.when(F.col("first") > 0, F.struct(F.lit("first").alias("problem"), F.col("first").alias("figure"))),
        F.when((n > 0) & (n < least), F.struct(F.lit("few").alias("problem"), n.alias("figure"))))
    whole = per.select(key, F.inline(F.filter(rules, lambda x: x.isNotNull())))
    short = listed.where(F.col("e") - F.col("s") < shortest).select(
        key, F.lit("short").alias("problem"), (F.col("e") - F.col("s")).alias("figure"))
    return whole.unionByName(short)
