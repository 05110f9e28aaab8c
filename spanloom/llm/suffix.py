"""Dedup of long repeated passages over run-length indexes.

A string of ``length`` bytes holds one anchor: of its short substrings the one with the least hash. Equal strings have equal
anchors, so the corpus falls into ranges of anchor hashes that can be indexed apart, each from the stretches of text whose strings have such
an anchor. Anchors of one document alone cannot lie in a repeat; they are found first, and their text is not sent.

A range's distinct stretches become one text with a run-length index: its Burrows-Wheeler transform by runs, and at the first row of each run
the text position, the position before it in suffix order and the length of the match between the two. Streaming over the text,
those samples give every position its match with its neighbour in suffix order, since between samples both move on by one and the match shrinks by
one. Matches of ``length`` or more chain the positions of each repeated string, and the smallest document id runs down each chain.

The text travels once, into a table bucketed by a hash of the document id; what is found out about a part of it comes to it.
Within a part equal stretches are sent once, so a passage that stands in a third of all documents weighs one row a part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import partitions, two_columns
from spanloom.llm.shingles import between, mixed, running, _powers_to
from spanloom.session import cut_lineage, shared_folder

ANCHOR = 20  # bytes of an anchor
STEP = 1 << 19  # strings looked at together
NO_ID = (1 << 63) - 1  # stands for a null id: larger than any other


class Part:
    """The texts of one part, laid end to end, and the stretches of strings with the same anchor."""

    def __init__(self, table: pa.Table, length: int):
        table = table.combine_chunks()
        # Rows with the same id are ordered by their whole texts, so that a part looks the same whenever it is read.
        ids = table.column("id").to_pylist()
        repeated = Counter(ids)
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], hashlib.sha256(table.column("text")[i].as_buffer()).digest() if repeated[ids[i]] > 1 else b"")), np.int64)
        self.length, self.ids = length, table.column("id").to_numpy()[order]
        texts = [table.column("text")[int(i)].as_buffer().to_pybytes() for i in order]
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        found = [self._stretches(at) for at in range(0, max(0, len(self.raw) - length + 1), STEP)]
        self.starts, self.counts, self.anchors, self.contents = (
            np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.uint64, np.uint64)))

    def _stretches(self, at: int):
        wide, raw = self.length - ANCHOR + 1, self.raw[at:at + STEP + self.length - 1]
        sums = running(raw)
        _, back = _powers_to(len(sums))
        m = len(raw) - ANCHOR + 1
        short = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * back[:m])
        # The least of each window; its place, in the low bits, decides among equals for the leftmost.
        low = np.uint64((1 << 20) - 1)
        least, size = (short & ~low) | np.arange(m, dtype=np.uint64), 1
        while 2 * size <= wide:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < wide:
            least = np.minimum(least[:len(least) - (wide - size)], least[wide - size:])
        place = (least & low).astype(np.int64)
        fits = np.ones(len(place), bool)
        for end in self.ends[np.searchsorted(self.ends, at):np.searchsorted(self.ends, at + len(place) + self.length)] - at:
            fits[max(0, end - self.length + 1):max(0, end)] = False
        here = np.flatnonzero(fits)
        place = place[here]
        new = np.ones(len(here), bool)
        new[1:] = (place[1:] != place[:-1]) | (here[1:] != here[:-1] + 1)
        first = np.flatnonzero(new)
        counts, starts = np.diff(np.append(first, len(here))), here[first]
        # Least hashes are small, so they are mixed once more before ranges are made of them.
        return starts + at, counts, mixed(short[place[first]] + np.uint64(1)), between(sums, starts, starts + counts + self.length - 1)

    def codes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct anchors, which of them each stretch has, and how many documents each is in."""
        codes, which = np.unique(self.anchors, return_inverse=True)
        ids = self.ids[self.documents(self.starts)] if len(which) else which
        order = np.lexsort((ids, which))
        a, d = which[order], ids[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        return codes, which, np.bincount(a[new], minlength=len(codes))

    def repeated(self, seen: np.ndarray, buckets: int):
        """Of the stretches whose anchors are ``seen`` again (a flag for each distinct anchor): the stretches, the distinct contents among them
        in order of bucket and content (as the first stretch with each), and which of those each stretch has."""
        which = np.unique(self.anchors, return_inverse=True)[1]
        kept = np.flatnonzero(seen[which]) if len(which) else np.zeros(0, np.int64)
        bucket = bucket_of(self.anchors[kept], buckets)
        order = np.lexsort((self.contents[kept], bucket))
        b, c = bucket[order], self.contents[kept][order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return kept, kept[order[new]], b[new], group

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, side="right")


def bucket_of(anchors: np.ndarray, buckets: int) -> np.ndarray:
    return (((anchors >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    edges = np.append(np.flatnonzero(np.append([True], bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else []
    for a, b in zip(edges, edges[1:]):
        yield int(bucket[a]), slice(a, b)


def _anchored(length: int, buckets: int):
    def run(key, rows):
        codes, _, counts = Part(rows, length).codes()
        out = [(b, key[0].as_py(), codes[s].astype(np.uint32).tobytes(), np.packbits(counts[s] > 1).tobytes()) for b, s in _slices(bucket_of(codes, buckets))]
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(
            (("bucket", pa.int32()), ("part", pa.int32()), ("codes", pa.binary()), ("often", pa.binary())))})
    return run


def _met(key, rows):
    """Which anchors of one range are in several documents: flags for each part's list."""
    codes = [np.frombuffer(c.as_buffer(), np.uint32) for c in rows.column("codes")]
    _, which, counts = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    edges = np.cumsum([len(c) for c in codes])[:-1]
    flags = [np.packbits(f | np.unpackbits(np.frombuffer(o.as_buffer(), np.uint8), count=len(f)).astype(bool)).tobytes()
             for f, o in zip(np.split(counts[which] > 1, edges), rows.column("often"))]
    n = rows.num_rows
    return pa.table({"part": rows.column("part"), "bucket": rows.column("bucket"), "flags": pa.array(flags, pa.binary()),
                     "sizes": pa.array([len(c) for c in codes], pa.int32()), "runs": pa.nulls(n, pa.binary()), "least": pa.nulls(n, pa.binary())})


def _seen(part: Part, told: pa.Table) -> np.ndarray:
    """The flags of a part's distinct anchors, put together from the ranges' answers."""
    rows = sorted((b, f, n) for b, f, n in zip(*(told.column(c).to_pylist() for c in ("bucket", "flags", "sizes"))) if f is not None)
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool) for _, f, n in rows)])


def _sent(length: int, buckets: int):
    def run(key, rows, told):
        out = []
        if rows.num_rows and told.num_rows:
            part = Part(rows, length)
            kept, first, bucket, group = part.repeated(_seen(part, told), buckets)
            least = np.full(len(first), NO_ID, np.int64)
            np.minimum.at(least, group, part.ids[part.documents(part.starts[kept])])
            for b, s in _slices(bucket):
                starts, counts = part.starts[first[s]], part.counts[first[s]]
                at = np.repeat(starts - np.cumsum(counts + length - 1) + counts + length - 1, counts + length - 1) + np.arange((counts + length - 1).sum())
                out.append((b, key[0].as_py(), counts.astype(np.uint8).tobytes(), least[s].tobytes(), part.raw[at].tobytes()))
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(
            (("bucket", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("docs", pa.binary()), ("bytes", pa.binary())))})
    return run


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of a text of small numbers in order, by doubling; only what is still tied is sorted again."""
    n = len(t)
    key = np.zeros(n, np.int64)
    for i in range(7):
        key <<= 9
        key[:n - i] |= t[i:].astype(np.int64) + 1
    order = np.argsort(key)
    slots, key, rank, reach = np.arange(n), key[order], np.empty(n, np.int64), 7
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        rank[order[slots]] = slots[first][np.cumsum(new) - 1]
        tied = np.repeat(np.diff(np.append(first, len(slots))) > 1, np.diff(np.append(first, len(slots))))
        slots = slots[tied]
        if not len(slots):
            return order
        at = order[slots]
        follow = np.where(at + reach < n, rank[np.minimum(at + reach, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + follow
        by = np.argsort(key)
        order[slots], key, reach = at[by], key[by], 2 * reach


class RunIndex:
    """A run-length Burrows-Wheeler index, sampled at the first row of each run."""

    def __init__(self, t: np.ndarray):
        order, n = suffix_array(t), len(t)
        last = t[order - 1]  # the transform; row 0 of the text's first suffix takes its last number
        head = np.flatnonzero(np.append([True], (last[1:] != last[:-1])) | (order == 0) | np.append([False], order[:-1] == 0))
        self.heads, self.letters, self.lengths = order[head], last[head], np.diff(np.append(head, n))
        self.before = np.where(head > 0, order[head - 1], -1)
        # Match lengths are compared at the samples alone.
        self.match = np.zeros(len(head), np.int64)
        live = np.flatnonzero(self.before >= 0)
        ended = np.append(t.astype("<u2"), np.zeros(4, np.uint16))
        four = np.ndarray((n + 1,), "<u8", ended, strides=(2,))  # four numbers from each place on; past the end come zeros
        while len(live):
            a, b = self.heads[live] + self.match[live], self.before[live] + self.match[live]
            differ = four[a] ^ four[b]
            same = (differ & np.uint64(0xFFFF) == 0).astype(np.int64)
            for bits in (32, 48):
                same += differ & np.uint64((1 << bits) - 1) == 0
            same += differ == 0
            self.match[live] += np.minimum(same, n - np.maximum(a, b))
            live = live[(differ == 0) & (np.maximum(a, b) + 4 < n)]
        by = np.argsort(self.heads)
        self.heads, self.before, self.match = self.heads[by], self.before[by], self.match[by]
        self.n = n

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position of the text its neighbour in suffix order and the length of their match."""
        at = np.zeros(self.n, np.int64)
        at[self.heads] = np.arange(len(self.heads))
        at = np.maximum.accumulate(at)
        gone = np.arange(self.n) - self.heads[at]
        return np.where(self.before[at] >= 0, self.before[at] + gone, -1), np.maximum(self.match[at] - gone, 0)


def least_documents(stretches: list[bytes], docs: np.ndarray, length: int) -> np.ndarray:
    """For each string of each stretch, one stretch after the other, the smallest document in which any stretch holds it."""
    sizes = np.array([len(s) for s in stretches], np.int64)
    t = np.zeros(int(sizes.sum()) + len(sizes), np.uint16)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(t), bool)
    inside[ends] = False
    t[inside] = np.frombuffer(b"".join(stretches), np.uint8).astype(np.uint16) + 1
    neighbour, match = RunIndex(t).stream()
    whole = np.repeat(ends, sizes + 1) - np.arange(len(t)) >= length  # strings that end inside their stretch
    up = np.where(whole & (match >= length), neighbour, np.arange(len(t)))
    while True:
        further = up[up]
        if (further == up).all():
            break
        up = further
    least = np.full(len(t), NO_ID, np.int64)
    np.minimum.at(least, up[whole], np.repeat(docs, sizes + 1)[whole])
    return least[up[whole]]


def segments(flat: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen ones of segments that lie end to end, end to end."""
    ends, wanted = np.cumsum(sizes), sizes[chosen]
    return flat[np.repeat((ends - sizes)[chosen] - np.cumsum(wanted) + wanted, wanted) + np.arange(wanted.sum())]


def _indexed(length: int):
    def run(key, rows):
        docs: dict[bytes, int] = {}
        asked = []
        for counts, least, raw in zip(rows.column("counts"), rows.column("docs"), rows.column("bytes")):
            sizes = np.frombuffer(counts.as_buffer(), np.uint8).astype(np.int64) + length - 1
            raw, ends = raw.as_buffer().to_pybytes(), np.cumsum(sizes).tolist()
            own = [raw[a:b] for a, b in zip([0, *ends], ends)]
            for s, d in zip(own, np.frombuffer(least.as_buffer(), np.int64).tolist()):
                if d <= docs.get(s, d):
                    docs[s] = d
            asked.append(own)
        texts = sorted(docs)
        found = least_documents(texts, np.array([docs[s] for s in texts], np.int64), length)
        # Runs of strings with the same smallest document: how many in a stretch, how long, and which document.
        held = np.array([len(s) - length + 1 for s in texts], np.int64)
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        new[(np.cumsum(held) - held)[held > 0]] = True
        first = np.flatnonzero(new)
        many = np.bincount(np.repeat(np.arange(len(texts)), held)[first], minlength=len(texts))
        lengths = np.zeros(len(texts) + len(first), np.uint8)
        heads = np.cumsum(many + 1) - many - 1
        lengths[heads] = many
        inside = np.ones(len(lengths), bool)
        inside[heads] = False
        lengths[inside] = np.diff(np.append(first, len(found)))
        place = {s: i for i, s in enumerate(texts)}
        runs, least = [], []
        for own in asked:
            at = np.array([place[s] for s in own], np.int64)
            runs.append(segments(lengths, many + 1, at).tobytes())
            least.append(segments(found[first], many, at).tobytes())
        n = rows.num_rows
        return pa.table({"part": rows.column("part"), "bucket": rows.column("bucket"), "flags": pa.nulls(n, pa.binary()), "sizes": pa.nulls(n, pa.int32()),
                         "runs": pa.array(runs, pa.binary()), "least": pa.array(least, pa.binary())})
    return run


def _removed(length: int, buckets: int):
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(key, rows, told):
        part = Part(rows, length)
        gone = np.zeros(len(part.raw), bool)
        if told.num_rows:
            kept, first, _, group = part.repeated(_seen(part, told), buckets)
            answers = sorted((b, r, d) for b, r, d in zip(*(told.column(c).to_pylist() for c in ("bucket", "runs", "least"))) if r is not None)
            runs, least = b"".join(r for _, r, _ in answers), np.frombuffer(b"".join(d for _, _, d in answers), np.int64)
            lengths, at = [], 0
            for _ in range(len(first)):
                n = runs[at]
                lengths.append(runs[at + 1:at + 1 + n])
                at += 1 + n
            smallest = np.repeat(least, np.frombuffer(b"".join(lengths), np.uint8))  # for each string of each distinct stretch
            begin = np.cumsum(part.counts[first]) - part.counts[first]
            counts = part.counts[kept]
            step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = np.repeat(part.starts[kept], counts) + step
            own = np.repeat(part.ids[part.documents(part.starts[kept])], counts)
            starts = starts[smallest[np.repeat(begin[group], counts) + step] < own]
            edge = np.zeros(len(part.raw) + 1, np.int32)
            np.add.at(edge, starts, 1)
            np.subtract.at(edge, starts + length, 1)
            gone = np.cumsum(edge[:-1]) > 0
        out, start = [], 0
        for doc, end in zip(part.ids.tolist(), part.ends.tolist()):
            mark = gone[start:end]
            spans = int((mark[1:] & ~mark[:-1]).sum()) + bool(end > start and mark[0])
            out.append((doc, end - start, int(mark.sum()), spans, part.raw[start:end][~mark].tobytes()))
            start = end
        return pa.table({n: pa.array([o[i] for o in out], pa.binary() if n == "kept" else pa.int64()) for i, n in enumerate(names)})
    return run


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the remaining bytes.

    A byte is removed when it lies in a string of ``length`` bytes, inside its text, that also stands in a document with a smaller id.
    Strings overlap freely and are judged on the input. Texts are taken as UTF-8, so a cut may fall inside a character.

    Null texts count as empty; a text shorter than ``length`` stays whole. A null id is larger than any other and is shared by
    all rows without one. Rows repeated under an id are one document as far as repeats go: none is removed for another.
    An empty table gives an empty result. Other columns are not looked at. ``length`` must be from 21 to 255.
    """
    spark, p = docs.sparkSession, partitions(docs)
    parts, ranges = p, 4 * p  # a part's texts and a range's index are each held by one task
    rows = two_columns(docs, id, text).select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.encode("text", "UTF-8").alias("text"))
    name, folder = f"texts_by_part_{uuid.uuid4().hex}", shared_folder(spark, "texts")
    (rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).repartition(p, "part")
     .write.format("parquet").option("compression", "zstd").option("path", folder).bucketBy(p, "part").saveAsTable(name))
    texts = spark.table(name)
    told = "part int, bucket int, flags binary, sizes int, runs binary, least binary"
    codes = texts.groupBy("part").applyInArrow(_anchored(length, ranges), "bucket int, part int, codes binary, often binary")
    met = cut_lineage(codes.groupBy("bucket").applyInArrow(_met, told))
    sent = texts.groupBy("part").cogroup(met.groupBy("part")).applyInArrow(
        _sent(length, ranges), "bucket int, part int, counts binary, docs binary, bytes binary")
    answers = cut_lineage(sent.groupBy("bucket").applyInArrow(_indexed(length), told))
    out = texts.groupBy("part").cogroup(met.unionByName(answers).groupBy("part")).applyInArrow(
        _removed(length, ranges), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("id", F.nullif("id", F.lit(NO_ID)))
