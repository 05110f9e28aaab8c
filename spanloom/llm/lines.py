"""Line dedup: hashes of lines in range partitions, sorted by document and position, streamed once.

What comes back is a bitmap of kept lines per document, not text. A (line, document) pair lies in one range, but a
frequent line may run over many ranges and batches: the groups at both ends of a batch are handed on with their counts, which
are summed before their lines are judged. So no line, however frequent, meets in one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import partitions, two_columns
from spanloom.session import cut_lineage

STRIPPED = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)  # stands for a null id: smaller than any other


def line_key(line: bytes, least: int) -> bytes | None:
    """The line as it is compared, or None where it is too short to be dropped."""
    key = line.strip(STRIPPED)
    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
        return None
    return key.lower()


def _hashed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # long texts make many lines
                part = batch.slice(start, 64)
                docs, copies, at, digests = [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    whole = text.as_buffer().to_pybytes()
                    copy = hashlib.md5(whole).digest()
                    for i, line in enumerate(whole.split(b"\n")):
                        key = line_key(line, least)
                        if key is not None:
                            docs.append(doc)
                            copies.append(copy)
                            at.append(i)
                            digests.append(xxhash.xxh3_128_digest(key))
                h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, i])) for i in (0, 1)] + [pa.array(docs, pa.int64()), pa.array(copies, pa.binary()), pa.array(at, pa.int64())],
                                                 names=["h1", "h2", "doc", "copy", "at"])
    return run


def _judged(least_docs: int):
    """Streams a sorted range (h1, h2, doc descending, copy, at): the first document of a group is the one that keeps its lines.
    Gives 'drop' rows (doc, copy, at), and for the groups at a batch's ends 'open' rows (h1, h2, batch, doc, copy, at) and one 'count' row, whose
    doc is the largest and whose at is the number of documents not yet counted."""
    def rows(kind: str, copy: pa.Array | None, *columns) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), *(pa.array(np.asarray(x, np.int64)) for x in columns), pa.nulls(n, pa.binary()) if copy is None else copy],
                                          names=["kind", "h1", "h2", "batch", "doc", "at", "copy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number = None, TaskContext.get().partitionId() << 32
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, doc, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc", "at"))
            columns = h1, h2, np.full(n, number), doc, at
            number += 1
            fresh = np.ones(n, bool)  # a new group
            fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            turn = fresh.copy()  # a new document of its group
            turn[1:] |= doc[1:] != doc[:-1]
            turn[0] = last != (h1[0], h2[0], doc[0])
            last = (h1[-1], h2[-1], doc[-1])
            group = np.cumsum(fresh) - 1
            starts = np.flatnonzero(fresh)
            count = np.bincount(group, weights=turn).astype(np.int64)
            end = (group == 0) | (group == group[-1])
            out = ~end & (count[group] >= least_docs) & (doc != doc[starts][group])
            for kind, chosen in (("drop", out), ("open", end)):
                yield rows(kind, batch.column("copy").filter(pa.array(chosen)), *(c[chosen] for c in columns))
            g = sorted({0, int(group[-1])})
            yield rows("count", None, *(c[starts[g]] for c in columns[:-1]), count[g])
    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, copies, n_lines, gone = batch.columns
        dropped, maps = [], []
        for n, out in zip(n_lines.to_pylist(), gone):
            keep = np.ones(n, np.uint8)
            if out.is_valid:
                keep[out.values.to_numpy()] = 0
            dropped.append(n - int(keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([ids, copies, n_lines, pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())],
                                         names=["id", "copy", "n_lines", "n_dropped", "keep"])


def kept_text(text: bytes, keep: bytes) -> bytes:
    """A text without the lines that its bitmap drops."""
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return text if bits.all() else b"\n".join(line for line, bit in zip(lines, bits) if bit)


def copy_of(text):
    """Tells apart rows with different texts under one id."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def line_bitmaps(docs: DataFrame, id: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """One row per different (id, text): id, copy, n_lines, n_dropped and keep, a zlib-compressed bitmap of the lines that stay.

    Texts are split at line feeds. Lines are compared without ASCII white space at both ends and with A-Z in lower case. A line of
    at least ``least_chars`` code points that stands in at least ``least_docs`` documents is dropped everywhere but in the
    document with the largest id, where all its occurrences stay.

    A null or empty text has one empty line. Rows with a null id are together one document whose id is the smallest.
    Rows repeated under one id count as one document, whether or not their texts are equal; each text has a bitmap of its own (``copy``, its
    128-bit digest, tells them apart). An empty table gives an empty result. Other columns are not looked at.
    """
    rows = two_columns(docs, id, text).withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    lines = rows.select("id", F.encode("text", "UTF-8").alias("text")).mapInArrow(_hashed(least_chars), "h1 long, h2 long, doc long, copy binary, at long")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    judged = cut_lineage(lines.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order, "copy", "at")
                         .mapInArrow(_judged(least_docs), "kind string, h1 long, h2 long, batch long, doc long, at long, copy binary"))
    counts = judged.where("kind = 'count'")
    frequent = (counts.groupBy("h1", "h2").agg(F.sum("at").alias("docs"), F.max("doc").alias("top"))
                .where(F.col("docs") >= least_docs).select("h1", "h2", "top"))
    # A frequent line is told to each batch that has it, so its rows meet batch by batch.
    told = counts.select("h1", "h2", "batch").join(frequent, ["h1", "h2"])
    waited = judged.where("kind = 'open'").join(told, ["h1", "h2", "batch"]).where("doc <> top")
    gone = judged.where("kind = 'drop'").select("doc", "copy", "at").unionByName(waited.select("doc", "copy", "at"))
    gone = gone.groupBy(F.col("doc").alias("id"), "copy").agg(F.collect_set("at").alias("gone"))
    counted = rows.select("id", copy_of("text").alias("copy"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
                          .cast("long").alias("n_lines")).distinct()
    return (counted.join(gone, ["id", "copy"], "left")
            .mapInArrow(_bitmaps, "id long, copy binary, n_lines long, n_dropped long, keep binary")
            .withColumn("id", F.nullif("id", F.lit(NO_ID))))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [kept_text(t.as_buffer().to_pybytes(), k.as_buffer().to_pybytes()) for t, k in zip(batch.column("text"), batch.column("keep"))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_lines"), batch.column("n_dropped"), pa.array(kept, pa.binary()).cast(pa.string())],
                                         names=["id", "n_lines", "n_dropped", "text"])


def without_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_dropped and the text that the bitmap of ``line_bitmaps`` leaves."""
    maps = line_bitmaps(docs, id, text, **limits).withColumnRenamed("id", "__id").withColumnRenamed("copy", "__copy")
    rows = two_columns(docs, id, text).withColumn("copy", copy_of("text"))
    met = rows.join(maps, F.col("id").eqNullSafe(F.col("__id")) & (F.col("copy") == F.col("__copy")))
    return met.select("id", F.encode("text", "UTF-8").alias("text"), "n_lines", "n_dropped", "keep").mapInArrow(
        _applied, "id long, n_lines long, n_dropped long, text string")
