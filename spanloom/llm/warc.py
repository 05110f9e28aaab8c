"""WARC archives: a deterministic sharded writer and a streaming reader.

Rows are range-sorted by id, payload digest and a hash of the url. The bounds come from exact weights of heavy keys and a sample of the others that is chosen by
hash, so the same rows give the same files. A task streams its range and writes one gzip member per record, rolls to a new
file by compressed size, and makes all headers and digests itself. Files are written under temporary names; Spark's own commit of the
list of finished files decides which attempts count, those files then get their names, and the manifest appears last.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import join_counted, partitions, text_or_empty
from spanloom.llm.shards import store
from spanloom.session import cut_lineage

NO_ID = -(1 << 63)  # stands for a null id: smaller than any other
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-records-by-row-and-payload")
MANIFEST = "name string, draft string, records long, bytes long, sha256 string, first_id long, last_id long"
FILE_OVERHEAD = 600  # about what a record's headers weigh
SAMPLES = 16  # keys a range that its bounds are taken from


def digest_name(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def record_name(id: int, digest: bytes, repeat: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{id}:{digest.hex()}{repeat}')}>"


def headers(fields: list[tuple[str, str | None]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields if v is not None), "", ""]).encode()


def record(kind: str, name: str, date: str, block: bytes, fields: list[tuple[str, str | None]]) -> bytes:
    head = headers([("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), *fields,
                    ("WARC-Block-Digest", f"sha1:{digest_name(block)}"), ("Content-Length", str(len(block)))], "WARC/1.1")
    return head + block + b"\r\n\r\n"


def page_record(id: int, url: str | None, digest: bytes, payload: bytes, top: int | None, date: str, repeat: str) -> bytes:
    """One row's record: a response with its payload, or where ``top`` is given a revisit of that row's, with the response's HTTP head only."""
    http = headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    fields = [("WARC-Target-URI", None if url is None else quote(url, safe="!#$&'()*+,/:;=?@[]~-._")), ("WARC-Payload-Digest", f"sha1:{digest_name(payload)}"),
              ("Content-Type", "application/http; msgtype=response"), ("X-Row-ID", None if id == NO_ID else str(id))]
    if top is None:
        return record("response", record_name(id, digest, repeat), date, http + payload, fields)
    return record("revisit", record_name(id, digest, repeat), date, http,
                  [*fields, ("WARC-Profile", REVISIT), ("WARC-Refers-To", record_name(top, digest)), ("X-Refers-To-Row-ID", str(top))])


class Roll:
    """The files of one range, in order; each is begun with a warcinfo record and ended once it is full."""

    def __init__(self, folder: str, prefix: str, shard: int, most: int, date: str, level: int):
        self.files, self.base = store(folder)
        self.prefix, self.shard, self.most, self.date, self.level = prefix, shard, most, date, level
        self.number, self.out = 0, None

    def _put(self, content: bytes) -> None:
        self.out.write(content)
        self.size += len(content)
        self.sum.update(content)

    def _packed(self, content: bytes) -> bytes:
        gz = zlib.compressobj(self.level, zlib.DEFLATED, 31)  # a gzip member without a time
        return gz.compress(content) + gz.flush()

    def add(self, content: bytes, id: int) -> dict | None:
        """Writes a record; gives what the manifest says of a file that ended before it."""
        packed, ended = self._packed(content), None
        if self.out is not None and self.size + len(packed) > self.most:
            ended = self.end()
        if self.out is None:
            self.name = f"{self.prefix}-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.draft = f"{self.name}.{uuid.uuid4().hex}"
            self.files.create_dir(f"{self.base}/_temporary", recursive=True)
            self.out = self.files.open_output_stream(f"{self.base}/_temporary/{self.draft}", compression=None)
            self.size, self.count, self.sum, self.first = 0, 0, hashlib.sha256(), id
            info = headers([("format", "WARC File Format 1.1")], "software: spanloom")
            self._put(self._packed(record("warcinfo", f"<urn:uuid:{uuid.uuid5(NAMES, self.name)}>", self.date, info,
                                          [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")])))
        self._put(packed)
        self.count, self.last = self.count + 1, id
        return ended

    def end(self) -> dict:
        self.out.close()
        self.out, self.number = None, self.number + 1
        return {"name": self.name, "draft": self.draft, "records": self.count, "bytes": self.size, "sha256": self.sum.hexdigest(),
                "first_id": None if self.first == NO_ID else self.first, "last_id": None if self.last == NO_ID else self.last}


def _written(folder: str, prefix: str, most: int, date: str, level: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        roll, before, repeat, top = Roll(folder, prefix, shard, most, date, level), None, 0, None

        def told(*files: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(list(files), pa.schema([("name", pa.string()), ("draft", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()),
                                                                      ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())]))
        for batch in batches:
            for id, url, digest, payload, is_top in zip(*(batch.column(c) for c in ("id", "url", "digest", "payload", "top"))):
                if not payload.is_valid:  # comes before the rows of its key
                    top = is_top.as_py()
                    continue
                id, url, digest, payload = id.as_py(), url.as_py(), digest.as_py(), payload.as_buffer().to_pybytes()
                repeat, before = repeat + 1 if before == (id, digest) else 0, (id, digest)
                ended = roll.add(page_record(id, url, digest, payload, top, date, f":{shard}:{repeat}" if repeat else ""), id)
                if ended:
                    yield told(ended)
        if roll.out is not None:
            yield told(roll.end())
    return work


def _named(folder: str):
    """Gives finished files their names. A file that has its name already was named by an earlier attempt of this task."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                there = files.get_file_info([f"{base}/{row['name']}"])[0]
                if not (there.is_file and there.size == row["bytes"]):
                    files.move(f"{base}/_temporary/{row['draft']}", f"{base}/{row['name']}")
            yield batch
    return work


def range_bounds(keys: DataFrame, ranges: int) -> list[tuple[int, bytes, int]]:
    """The last (id, digest, place) of each range but the last, of ranges of like ``weight``. A key heavier than a range is the bound of several.

    At most four keys a range can weigh a quarter of one; of the others about SAMPLES a range are taken, those whose hash a divisor divides.
    """
    n, weight = keys.agg(F.count(F.lit(1)), F.sum("weight")).first()
    if not n:
        return []
    every = max(1, n // (SAMPLES * ranges))
    heavy = F.col("weight") > weight / (4 * ranges)
    chosen = keys.where(heavy | (F.pmod(F.xxhash64("digest", "id", "place"), F.lit(every)) == 0))
    taken = sorted((r.id, bytes(r.digest), r.place, r.weight if r.heavy else r.weight * every)
                   for r in chosen.select("id", "digest", "place", "weight", heavy.alias("heavy")).collect())
    upto = list(accumulate(t[3] for t in taken))
    return [taken[bisect_left(upto, upto[-1] * i / ranges)][:3] for i in range(1, ranges)] if taken else []


def _ranges(bounds: list[tuple[int, bytes, int]]):
    """The first and last of the ranges that a key fills; only the key's columns go to Python."""
    @F.pandas_udf("first int, last int")
    def of(id: pd.Series, digest: pd.Series, place: pd.Series) -> pd.DataFrame:
        keys = list(zip(id, digest, place))
        first = [bisect_left(bounds, k) for k in keys]
        return pd.DataFrame({"first": first, "last": [max(a, bisect_right(bounds, k) - 1) for a, k in zip(first, keys)]})
    return of("id", "digest", "place")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_warc(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, file_bytes: int = 1 << 30, range_bytes: int = 1 << 31,
               prefix: str = "pages", date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes one record per row of ``pages`` to gzipped WARC 1.1 files in ``folder`` and returns the manifest, one row per file.

    Of rows with equal payloads (by SHA-256) of at least ``least_bytes``, those with the largest id are responses and the others revisits of
    it, with the response's HTTP head and no payload. A file ends before the record that would take it over ``file_bytes``; a larger record
    has a file of its own. A task's range holds about ``range_bytes`` before compression, or less where there are more shuffle partitions. The same rows give the same files, whatever their order; only how many
    of the rows equal in all columns lie in which of the ranges that they fill follows the order they are read in.

    A null payload counts as empty. A null id is smaller than any other and gives records without ``X-Row-ID``; if a payload has no other
    id, all its rows are responses. A null url gives records without a target. Repeated rows each have a record. An empty table gives a
    manifest without rows. Other columns are not looked at. A folder that has a manifest is refused.
    """
    spark = pages.sparkSession
    files, done = _hadoop(spark, f"{folder}/manifest")
    if files.exists(done):
        raise ValueError(f"{folder} holds an archive already")
    rows = pages.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(url).cast("string").alias("url"), F.encode(text_or_empty(payload), "UTF-8").alias("payload"),
                        F.monotonically_increasing_id().alias("lot"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("place", F.xxhash64("url"))
    keys = cut_lineage(rows.groupBy("digest", "id", "place").agg(F.count(F.lit(1)).alias("n"), F.first(F.length("payload")).alias("size")))
    tops = keys.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("id").alias("top"), F.sum("n").alias("all"), (F.min("id") < F.max("id")).alias("differ"))
    told = join_counted(keys.withColumn("lot", F.shiftleft(F.monotonically_increasing_id(), 1) + 1), tops.where("differ"), ["digest"], "all")
    told = cut_lineage(told.select("digest", "id", "place", "n", "size", F.when(F.col("id") < F.col("top"), F.col("top")).alias("top")))
    weight = F.col("n") * (FILE_OVERHEAD + F.when(F.col("top").isNull(), F.col("size")).otherwise(0))
    ranges = max(partitions(pages), -(-(told.agg(F.sum(weight)).first()[0] or 0) // range_bytes))
    at = _ranges(range_bounds(told.withColumn("weight", weight), ranges))
    # Each key's top and its rows meet in one exchange and one order: the payloads are shuffled once, and no key is joined.
    told = told.withColumn("at", at).select("digest", "id", "place", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "top",
                                            F.explode(F.sequence("at.first", "at.last")).alias("shard"))
    deal = F.col("at.first") + F.pmod(F.col("lot"), F.col("at.last") - F.col("at.first") + 1)
    rows = rows.withColumn("at", at).select("digest", "id", "place", "url", "payload", F.lit(None).cast("long").alias("top"), deal.cast("int").alias("shard"))
    ready = told.unionByName(rows).repartitionById(ranges, F.col("shard")).sortWithinPartitions("id", "digest", "place", F.col("payload").isNotNull())
    drafts = f"{folder}/_temporary/manifest-{uuid.uuid4().hex}"
    ready.mapInArrow(_written(folder, prefix, file_bytes, date, level), MANIFEST).write.parquet(drafts)
    finished = f"{folder}/_temporary/named-{uuid.uuid4().hex}"
    spark.read.parquet(drafts).mapInArrow(_named(folder), MANIFEST).drop("draft").write.parquet(finished)
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(finished), done):
        raise OSError(f"the manifest of {folder} could not be named")
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary"), True)  # with what lost attempts left there
    return spark.read.parquet(f"{folder}/manifest")


class _Summed:
    """A stream whose bytes are counted and digested as they are read."""

    def __init__(self, file):
        self.file, self.size, self.sum = file, 0, hashlib.sha256()

    def read(self, n: int = -1) -> bytes:
        got = self.file.read(n if n >= 0 else None)
        self.size += len(got)
        self.sum.update(got)
        return got


def read_head(file) -> tuple[str, dict[str, str]]:
    """A first line and the fields under it, up to an empty line; ("", {}) at the end of the file."""
    first, fields = file.readline(), {}
    while (line := file.readline().rstrip(b"\r\n")):
        name, _, value = line.partition(b":")
        fields[name.decode().lower()] = value.strip().decode()
    return first.decode().rstrip("\r\n"), fields


def records_of(file) -> Iterator[dict]:
    """The response and revisit records of an uncompressed stream, with payloads checked against their digests."""
    while True:
        first, fields = read_head(file)
        if not first:
            return
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        block = file.read(int(fields["content-length"]))
        if file.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        if fields["warc-type"] not in ("response", "revisit"):
            continue
        if fields.get("warc-block-digest", "") not in ("", f"sha1:{digest_name(block)}"):
            raise ValueError(f"record {fields['warc-record-id']} has another digest than its header")
        head, _, payload = block.partition(b"\r\n\r\n")
        whole = fields["warc-type"] == "response"
        digest = digest_name(payload) if whole else fields["warc-payload-digest"].removeprefix("sha1:")
        if fields.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
            raise ValueError(f"the payload of {fields['warc-record-id']} has another digest than its header")
        length = [v for k, _, v in (x.lower().partition(b":") for x in head.split(b"\r\n")) if k == b"content-length"]
        number = lambda name: int(fields[name]) if name in fields else None
        yield {"record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "url": unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None,
               "row_id": number("x-row-id"), "refers_to": number("x-refers-to-row-id"), "payload_digest": digest,
               "payload_bytes": len(payload) if whole else int(length[0]), "payload": payload if whole else None}


def _read(folder: str, wanted: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        kinds = {"record_id": pa.string(), "record_type": pa.string(), "url": pa.string(), "row_id": pa.int64(), "refers_to": pa.int64(), "payload_digest": pa.string(),
                 "payload_bytes": pa.int64(), "payload": pa.binary(), "name": pa.string()}
        schema = pa.schema([(c, kinds[c]) for c in wanted])
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                with files.open_input_stream(f"{base}/{row['name']}", compression=None) as raw:
                    file = _Summed(raw)
                    for found in records_of(gzip.GzipFile(fileobj=file)):
                        held.append({c: row["name"] if c == "name" else found[c] for c in wanted})
                        size += 500 + (len(found["payload"] or b"") if "payload" in wanted else 0)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if (file.size, file.sum.hexdigest()) != (row["bytes"], row["sha256"]):
                    raise ValueError(f"{row['name']} is not as its manifest says")
                yield pa.RecordBatch.from_pylist(held, schema)
    return work


COLUMNS = {"name": "string", "record_id": "string", "record_type": "string", "url": "string", "row_id": "long", "refers_to": "long", "payload_digest": "string",
           "payload_bytes": "long", "payload": "binary"}


def read_warc(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """One row per response or revisit record of the files that the manifest of ``folder`` names, streamed record by record: of COLUMNS those in
    ``columns``, or all. A file that differs from its manifest, or a payload from its digest, raises. An archive without files gives no rows."""
    wanted = list(columns or COLUMNS)
    manifest = spark.read.parquet(f"{folder}/manifest")
    files = manifest.select("name", "bytes", "sha256").repartition(partitions(manifest), "name")
    return files.mapInArrow(_read(folder, wanted), ", ".join(f"{c} {COLUMNS[c]}" for c in wanted))
