"""Token ids in training order, as binary shards of fixed stride.

Texts' ids are cut into sequences of ``length``. Every sequence has a number, from 0, and a keyed Feistel network over the next power
of four, walked on until it lands inside, permutes those numbers: the result is the sequence's global slot. Shard k is one file with the
slots from k * ``shard_rows`` on, record after record, so a slot's place follows from its number and reading goes on wherever it stopped.

A record is the row's id (int64), the sequence's number in its row and its count of ids (uint32 each), then ``length`` ids of two or four
bytes, the last sequence of a row filled up with zeros. All numbers are little-endian.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.bpe import encoder, parts
from spanloom.llm.common import partitions
from spanloom.llm.shingles import mixed
from spanloom.session import cut_lineage, shared_folder

BLOCK = 1 << 23  # bytes of records packed together
ROUNDS = 6
NO_ID = -(1 << 63)  # stands for a null id


def record(length: int, width: int) -> np.dtype:
    return np.dtype([("id", "<i8"), ("seq", "<u4"), ("n", "<u4"), ("ids", f"<u{width}", (length,))])


def slots(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed permutation of 0 .. n-1 puts each of the numbers."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mixed(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key))
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def cut(id: int | None, ids: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The records of one row; a row without ids has none."""
    length = kind["ids"].shape[0]
    out = np.zeros(-(-len(ids) // length), kind)
    out["id"], out["seq"], out["n"] = NO_ID if id is None else id, np.arange(len(out)), length
    flat = np.zeros(len(out) * length, kind["ids"].base)
    flat[:len(ids)] = ids
    out["ids"] = flat.reshape(-1, length)
    if len(ids) % length:
        out["n"][-1] = len(ids) % length
    return out


def _by_rows(batch: pa.RecordBatch, rows: int = 64) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _packed(kind: np.dtype, ids_of: Callable[[pa.Array], list[np.ndarray]], cut_up: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] = _by_rows,
            done: Callable[[], None] = lambda: None, level: int = 6):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in cut_up(batch):
                for id, values in zip(part.column(0).to_pylist(), ids_of(part.column(1))):
                    held.append(cut(id, values, kind))
                    size += held[-1].nbytes
                    if size >= BLOCK:
                        yield _block(block, held, level)
                        held, size, block = [], 0, block + 1
        if size:
            yield _block(block, held, level)
        done()
    return run


def _block(block: int, held: list[np.ndarray], level: int) -> pa.RecordBatch:
    rows = np.concatenate(held)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(rows)], pa.int64()),
                                       pa.array([zstandard.ZstdCompressor(level=level).compress(rows.tobytes())], pa.binary())], names=["block", "n", "records"])


def _scattered(kind: np.dtype, n: int, key: int, shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, records in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(records.as_buffer()), kind)
                to = slots(np.arange(first, first + len(rows)), n, key)
                order = np.argsort(to)
                to, rows = to[order], rows[order]
                shard = to // shard_rows
                edges = np.append(np.flatnonzero(np.append([True], shard[1:] != shard[:-1])), len(shard))
                parts = [(int(shard[a]), to[a:b].tobytes(), zstandard.ZstdCompressor(level=3).compress(rows[a:b].tobytes())) for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
                                                 names=["shard", "slots", "records"])
    return run


def store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri("file://" + folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def _written(folder: str, kind: np.dtype, n: int, shard_rows: int):
    """Writes each shard under a name of its own and then gives it its final name, so that a task that is run twice leaves one whole file."""
    def run(key, rows):
        shard = key[0].as_py()
        to = np.concatenate([np.frombuffer(s.as_buffer(), np.int64) for s in rows.column("slots")])
        all_rows = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(r.as_buffer()), kind) for r in rows.column("records")])
        order = np.argsort(to)
        first = shard * shard_rows
        if not np.array_equal(to[order], np.arange(first, min(n, first + shard_rows))):
            raise ValueError(f"shard {shard} does not have each of its slots once")
        files, base = store(folder)
        files.create_dir(base, recursive=True)
        name, draft = f"{base}/shard-{shard:09d}.bin", f"{base}/_writing-{shard}-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(all_rows[order].tobytes())
        files.move(draft, name)
        return pa.table({"shard": [shard], "first": [first], "rows": [len(order)], "name": [name]})
    return run


def read_slots(folder: str, first: int, count: int, length: int, width: int = 2, shard_rows: int = 32768) -> np.ndarray:
    """``count`` records from slot ``first`` on, read from where they stand in the shards."""
    kind, (files, base) = record(length, width), store(folder)
    found = []
    while count > 0:
        shard, at = divmod(first, shard_rows)
        take = min(count, shard_rows - at)
        with files.open_input_file(f"{base}/shard-{shard:09d}.bin") as file:
            file.seek(at * kind.itemsize)
            rows = np.frombuffer(file.read(take * kind.itemsize), kind)
        found.append(rows)
        if len(rows) < take:  # the end
            break
        first, count = first + take, count - take
    return np.concatenate([np.zeros(0, kind), *found])


def write_training_order(rows: DataFrame, folder: str, id: str = "doc_id", ids: str = "ids", tokenizer: str | None = None, length: int = 256, width: int = 2,
                         key: int = 20240229, shard_rows: int = 32768) -> DataFrame:
    """Writes the sequences of all rows to ``folder`` and returns one row per shard: shard, first (slot), rows and name.

    ``ids`` is a column of token ids (array of int), or of texts if ``tokenizer`` names a tokenizer file to encode them with. ``width`` is the
    bytes of an id and must hold every id. The same rows, read in the same order, get the same slots under the same key.

    Null and empty values give no sequence. Null and repeated ids are written like any other; a null id is stored as the smallest int64. An
    empty table gives no shard. Other columns are not looked at.
    """
    spark, kind, p = rows.sparkSession, record(length, width), partitions(rows)
    most = 1 << (8 * width)

    def fits(values: np.ndarray) -> np.ndarray:
        if len(values) and (values.min() < 0 or int(values.max()) >= most):
            raise ValueError(f"an id does not fit into {width} bytes")
        return values

    if tokenizer:
        known = encoder(tokenizer)
        fits(np.array([*known.vocab.values(), *known.added.values()]))

        def ids_of(texts: pa.Array) -> list[np.ndarray]:
            return [np.frombuffer(ids, np.uint32) for ids in encoder(tokenizer).encode_many([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts])]
        cut_up, done = parts, lambda: encoder(tokenizer).forget()
        value = F.encode(F.col(ids).cast("string"), "UTF-8")
    else:
        def ids_of(lists: pa.Array) -> list[np.ndarray]:
            return [fits(x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32)) for x in lists]
        cut_up, done, value = _by_rows, (lambda: None), F.col(ids)
    # Blocks of sequences are written once, under numbers of their own; their counts then say where each begins.
    name = f"sequences_{uuid.uuid4().hex}"
    (rows.select(F.col(id).cast("long").alias("id"), value.alias("value")).mapInArrow(_packed(kind, ids_of, cut_up, done), "block long, n long, records binary")
     .write.format("parquet").option("compression", "uncompressed").option("path", shared_folder(spark, "sequences")).bucketBy(p, "block").saveAsTable(name))
    blocks = spark.table(name)
    task = F.shiftright("block", 32)
    sizes = blocks.select("block", "n", task.alias("task"))
    by_task = sizes.groupBy("task").agg(F.sum("n").alias("rows"))
    by_task = by_task.withColumn("before", F.sum("rows").over(W.orderBy("task")) - F.col("rows")).select("task", "before")  # one row per task
    within = F.sum("n").over(W.partitionBy("task").orderBy("block")) - F.col("n")
    firsts = sizes.withColumn("within", within).join(by_task, "task").select("block", (F.col("before") + F.col("within")).alias("first"))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    sent = blocks.join(firsts, "block").select("first", "records").mapInArrow(_scattered(kind, n, key, shard_rows), "shard long, slots binary, records binary")
    written = sent.groupBy("shard").applyInArrow(_written(folder, kind, n, shard_rows), "shard long, first long, rows long, name string")
    return cut_lineage(written)


def read_shards(spark, folder: str, length: int, width: int = 2, shard_rows: int = 32768) -> DataFrame:
    """One row per sequence, read back from the shards: slot, id, seq, n_tokens and ids_sha256, a digest of its ids as stored."""
    kind = record(length, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = np.frombuffer(content.as_buffer(), kind)
                first = int(path.rpartition("shard-")[2].removesuffix(".bin")) * shard_rows
                digests = [hashlib.sha256(ids[:n].tobytes()).hexdigest() for ids, n in zip(rows["ids"], rows["n"].tolist())]
                ids = rows["id"].copy()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rows))), pa.array(ids, mask=ids == NO_ID), pa.array(rows["seq"].astype(np.int64)),
                                                  pa.array(rows["n"].astype(np.int64)), pa.array(digests)], names=["slot", "id", "seq", "n_tokens", "ids_sha256"])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder).select("path", "content")
    return files.mapInArrow(run, "slot long, id long, seq long, n_tokens long, ids_sha256 string")
