"""Near-duplicate documents by b-bit MinHash.

Each text's set of word runs gives 128 minima. Bands of four minima find candidates; the low four bits of every minimum, packed
into eight longs, estimate a candidate pair's similarity by counting equal fields, corrected for fields that are equal by chance; pairs that
could reach the threshold are confirmed on the full sets.

Texts with equal sets are one class from the start. A large family of near copies is not turned into all its pairs: each bucket
names the class that is most like a few others of it (a large bucket: of each hash block, then among those), and each class is tried against the best of its buckets' leaders, which joins
most of a family. Then pairs of classes that still lie in different components are compared inside the tasks that hold a bucket, buckets in blocks: the classes outside a bucket's largest
component meet each other and that component, which does not meet itself. A pair is looked at in the first bucket it shares, and goes on only if its estimate leaves it a chance and so do the
rarest word runs of its sets: up to the smaller of the two lists' last runs all that the sets share is seen, and beyond it they can
share no more than the smaller rest. No pair over the threshold fails that.
A pair of similarity 0.8 shares none of the 32 bands once in 2 * 10^7 pairs, and its estimate falls under the margin once in 10^9.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import text_or_empty, two_columns
from spanloom.llm.shingles import mixed, word_runs, words_of
from spanloom.operators.graph import components
from spanloom.session import cut_lineage, shared_folder

BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
MARGIN = 0.22  # six standard deviations of the estimate at 0.8
BLOCK = 512  # classes of one bucket compared with as many others at a time
SPLIT = 2048  # classes of one bucket held in a task; larger buckets are split
LOOKS = 64  # classes of a bucket that the others are measured by when it chooses its leader
NO_ID = (1 << 63) - 1  # stands for a null id: larger than any other
_rng = np.random.default_rng(9)
_TIMES, _PLUS = _rng.integers(0, 1 << 63, (2, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(runs: np.ndarray) -> np.ndarray:
    """The least of 128 hashes over a set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(runs), 512):
        np.minimum(least, ((runs[at:at + 512, None] * _TIMES + _PLUS) >> np.uint64(32)).min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    m = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x100000001B3) + m[:, i])
    return key


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of all minima, sixteen fields a long."""
    fields = (least & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return (fields << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def _signed(text: pa.Scalar, width: int) -> tuple[bytes | None, np.ndarray]:
    runs = word_runs(words_of(text.as_buffer().to_pybytes()), width)
    return (hashlib.md5(runs.tobytes()).digest() if len(runs) else None), runs


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)))


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, signs = [], [], [], []
            for text in batch.column(1):
                node, runs = _signed(text, width)
                least = minima(runs)
                nodes.append(node)
                sizes.append(len(runs))
                keys.append(bands(least) if node else runs)
                signs.append(packed(least) if node else runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), _lists(keys), _lists(signs)],
                                             names=["id", "digest", "node", "n_shingles", "keys", "sign"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                signed = [_signed(text, width) for text in batch.column(0).slice(start, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([node for node, _ in signed], pa.binary()), _lists([runs for _, runs in signed])], names=["node", "runs"])
    return run


def equal_fields(a: Column, b: Column) -> Column:
    """In how many of their fields two packed signatures agree."""
    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111))).cast("int")
    return F.lit(HASHES) - F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x)


def estimate(equal):
    """Similarity from equal fields, without those that agree by chance."""
    chance = 2.0 ** -BITS
    return (equal / HASHES - chance) / (1 - chance)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal fields of every signature of ``a`` with every one of ``b``."""
    d = a[:, None, :] ^ b[None, :, :]
    d |= d >> np.uint64(2)
    d |= d >> np.uint64(1)
    return HASHES - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=2, dtype=np.int32)


def _groups(batches: Iterator[pa.RecordBatch], keys: int, least: int = 2) -> Iterator[list[list]]:
    """The columns of each run of at least ``least`` rows with the same first ``keys`` columns, one run after another."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if len(held) >= least:
                    yield list(map(list, zip(*held)))
                key, held = row[:keys], []
            held.append(row)
    if len(held) >= least:
        yield list(map(list, zip(*held)))


def _leader(sign: np.ndarray) -> int:
    """Which signature is most like some others of them."""
    looks = np.linspace(0, len(sign) - 1, min(LOOKS, len(sign))).astype(np.int64)
    return int(np.concatenate([agreeing(sign[i:i + BLOCK], sign[looks]).sum(axis=1) for i in range(0, len(sign), BLOCK)]).argmax())


def _led(least: float):
    """Of each bucket the leader, and all classes whose estimate with that one reaches ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, nodes, signs in _groups(batches, 1):
            sign = np.array(signs, np.int64).view(np.uint64)
            leader = _leader(sign)
            equal = np.concatenate([agreeing(sign[i:i + BLOCK], sign[leader:leader + 1])[:, 0] for i in range(0, len(nodes), BLOCK)])
            out += [(nodes[i], nodes[leader], int(equal[i])) for i in np.flatnonzero(estimate(equal) >= least).tolist() if i != leader]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(LED)], names=["node", "leader", "equal"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(LED)], names=["node", "leader", "equal"])
    LED = (pa.binary(), pa.binary(), pa.int32())
    return run


def _leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leader alone of each (key, block): rows are (key, block, node, signature), and so is what comes out."""
    for key, block, nodes, signs in _groups(batches, 2, 1):
        i = _leader(np.array(signs, np.int64).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([key[i]], pa.int64()), pa.array([block[i]], pa.int32()), pa.array([nodes[i]], pa.binary()),
                                          pa.array([signs[i]], pa.list_(pa.int64()))], names=["key", "block", "node", "sign"])


def _led_in_blocks(rows: DataFrame, least: float) -> DataFrame:
    """``_led`` for large buckets, rows (key, members, node, sign), where no task holds more than a block of one: the leader is chosen
    among the leaders of its blocks, and comes back to the blocks by a join."""
    blocks = F.ceil(F.col("members") / SPLIT).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))

    def leading(of: DataFrame) -> DataFrame:
        return (of.select("key", "block", "node", "sign").repartition("key", "block").sortWithinPartitions("key", "block", "node")
                .mapInArrow(_leading, "key long, block int, node binary, sign array<long>"))
    leaders = leading(leading(rows).withColumn("block", F.lit(0))).select("key", F.col("node").alias("leader"), F.col("sign").alias("theirs"))
    sizes = rows.select("key", "block").distinct()
    leaders = cut_lineage(sizes.join(leaders, "key"))
    equal = equal_fields(F.col("sign"), F.col("theirs"))
    return rows.join(leaders, ["key", "block"]).where("node <> leader").select("node", "leader", equal.alias("equal")).where(estimate(F.col("equal")) >= least)


def _across(percent: int):
    """Pairs of different components in each block of a bucket that may reach the threshold: rows are (key, lo, hi, block, node, component,
    size, rarest runs, keys, signature), and a block of two halves meets only across them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, lo, hi, block, nodes, comps, sizes, rare, keys, signs in _groups(batches, 3):
            comps, block, sizes = np.unique(comps, return_inverse=True)[1], np.array(block), np.array(sizes, np.int64)
            sign, keys = np.array(signs, np.int64).view(np.uint64), np.array(keys, np.int64)
            here = int(np.flatnonzero(keys[0] == key[0])[0])  # this bucket's place among a class's keys
            sets = [frozenset(r) for r in rare]
            found = []
            for i in range(0, len(nodes), BLOCK):
                for j in range(i, len(nodes), BLOCK):
                    x, y = slice(i, i + BLOCK), slice(j, j + BLOCK)
                    may = comps[x, None] != comps[None, y]
                    if lo[0] != hi[0]:
                        may &= block[x, None] != block[None, y]
                    may &= 100 * np.minimum(sizes[x, None], sizes[None, y]) >= percent * np.maximum(sizes[x, None], sizes[None, y])
                    if i == j:
                        may &= np.tri(*may.shape, -1, bool)
                    if may.any():
                        may &= estimate(agreeing(sign[x], sign[y])) >= percent / 100 - MARGIN
                    for k in range(here):
                        may &= keys[x, None, k] != keys[None, y, k]
                    for a, b in zip(*(c.tolist() for c in np.nonzero(may))):
                        a, b = a + i, b + j
                        overlap = -(-percent * int(sizes[a] + sizes[b]) // (100 + percent))
                        seen = min(rare[a][-1], rare[b][-1])
                        rest = min(int(sizes[a]) - bisect_right(rare[a], seen), int(sizes[b]) - bisect_right(rare[b], seen))
                        if len(sets[a] & sets[b]) + rest >= overlap:
                            found.append((min(nodes[a], nodes[b]), max(nodes[a], nodes[b])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.binary()) for c in (0, 1)], names=["a", "b"])
    return run


def _halves(placed: DataFrame) -> DataFrame:
    """The tasks (key, lo, hi) that each class of a bucket goes to, rows (key, node, component, largest, large, members).

    A bucket's largest component, ``large`` of its ``members``, has nothing to be compared with inside itself. The others are dealt into
    blocks, each of which meets itself, every other, and every block of the largest. A bucket that fits a block is one task."""
    fits = F.col("members") <= SPLIT
    inner = (F.col("component") == F.col("largest")) & ~fits
    few = F.ceil((F.col("members") - F.col("large")) / SPLIT).cast("int")
    many = F.when(fits, 0).otherwise(F.ceil(F.col("large") / SPLIT)).cast("int")
    halves = placed.withColumn("few", few).withColumn("many", many)
    dealt = F.when(inner, F.col("few") + F.pmod(F.xxhash64("node"), F.greatest("many", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("few")))
    halves = halves.withColumn("block", dealt.cast("int"))
    last = F.col("few") + F.when(inner, 0).otherwise(F.col("many")) - 1
    halves = halves.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return halves.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))


def written(df: DataFrame) -> DataFrame:
    """A wide intermediate result as a table in the shared folder: copies' keys and signatures lie there once a page, which a checkpoint would
    write row by row, and its readers take only the columns they need."""
    folder = shared_folder(df.sparkSession, "near")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable over links) and kept.

    Texts are linked when their sets of runs of ``width`` words have ``percent`` % of their union in common. A text with fewer words
    has one run, all its words; a null, empty or blank text has none and is linked with nothing. Words lie between
    ASCII white space and are compared with A-Z in lower case. Rows with equal sets are in one component however many they are.
    Rows with a null id come after all others and count as one id; rows repeated under an id are judged each by its own text.
    An empty table gives an empty result. Other columns are not looked at.
    """
    return _judged(docs, id, text, width, percent).select("id", "n_shingles", "component_id", "kept")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def _judged(docs: DataFrame, id: str, text: str, width: int = 5, percent: int = 80) -> DataFrame:
    """``near_duplicates`` with the digest of each row's text, by which a row under a repeated id is known."""
    rows = two_columns(docs, id, text).select("id", F.encode("text", "UTF-8").alias("text"), _digest(F.col("text")).alias("digest"))
    features = written(rows.mapInArrow(_features(width), "id long, digest binary, node binary, n_shingles long, keys array<long>, sign array<long>"))
    classes = written(features.where("node is not null").groupBy("node").agg(
        F.first("keys").alias("keys"), F.first("sign").alias("sign"), F.first("n_shingles").alias("n"), F.min(F.coalesce("id", F.lit(NO_ID))).alias("id")))
    buckets = classes.select("node", F.explode("keys").alias("key"))
    met = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = written(buckets.join(met, "key"))  # only buckets of two classes or more
    signed = shared.join(classes.select("node", "sign"), "node").select("key", "members", "node", "sign")

    # Sets of the classes that share a bucket, from one row of each.
    wanted = shared.select("node").distinct().join(classes.select("node", "id", "n"), "node")
    texts = rows.join(wanted.select(F.nullif("id", F.lit(NO_ID)).alias("__id")).distinct(), F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    sets = texts.select("text").mapInArrow(_sets(width), "node binary, runs array<long>")
    sets = written(sets.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("runs").alias("runs")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("runs").alias("ra")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("runs").alias("rb")), "b")
        both = both.select("a", "b", F.size(F.array_intersect("ra", "rb")).alias("common"), (F.size("ra") + F.size("rb")).alias("sum"))
        return both.where(F.col("common") * 100 >= (F.col("sum") - F.col("common")) * percent).select("a", "b")

    # Each class against the leader it resembles most.
    likely = percent / 100 - MARGIN
    led = (signed.where(F.col("members") <= SPLIT).select("key", "node", "sign").repartition("key").sortWithinPartitions("key", "node")
           .mapInArrow(_led(likely), "node binary, leader binary, equal int"))
    if not shared.where(F.col("members") > SPLIT).isEmpty():
        led = led.unionByName(_led_in_blocks(signed.where(F.col("members") > SPLIT), likely))
    led = written(led.distinct())
    best = led.groupBy("node").agg(F.max_by("leader", F.struct("equal", "leader")).alias("leader"))
    links = cut_lineage(confirmed(best.select(F.col("node").alias("a"), F.col("leader").alias("b"))))
    comps = cut_lineage(components(links, "a", "b"))

    # Different leaders' followings may still be apart: of each two, the most alike follower and leader are tried.
    of_leader = comps.select(F.col("node").alias("leader"), F.col("component").alias("other"))
    between = led.join(comps, "node", "left").join(of_leader, "leader", "left").select(
        "node", "leader", "equal", F.coalesce("component", "node").alias("one"), F.coalesce("other", "leader").alias("two")).where("one <> two")
    between = between.groupBy(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).agg(
        F.max_by(F.struct("node", "leader"), F.struct("equal", "node", "leader")).alias("p"))
    links = cut_lineage(links.unionByName(confirmed(between.select(F.col("p.node").alias("a"), F.col("p.leader").alias("b")))))
    comps = cut_lineage(components(links, "a", "b"))

    # Whatever still lies apart within a bucket.
    placed = shared.join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    parted = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("large"), F.sum("n").alias("members")).where("large < members")
    placed = written(placed.join(parted, "key"))
    # The rarest runs of each class still in question, one more than a partner may lack.
    runs = sets.join(placed.select("node").distinct(), "node").select("node", F.explode("runs").alias("run"))
    runs = runs.withColumn("classes", F.count(F.lit(1)).over(W.partitionBy("run")))
    # One number orders runs by rarity and then tells them apart.
    place = F.shiftleft(F.least("classes", F.lit(32767)), 48).bitwiseOR(F.col("run").bitwiseAND(F.lit((1 << 48) - 1)))
    rare = runs.groupBy("node").agg(F.array_sort(F.collect_list(place)).alias("r"))
    most = F.size("r") - F.ceil(F.size("r") * percent / 100).cast("int") + 1
    rare = rare.select("node", F.slice("r", 1, most).alias("rare"))
    known = classes.select("node", "sign", "keys", "n").join(rare, "node")
    halves = _halves(placed)
    apart = (halves.join(known, "node").select("key", "lo", "hi", "block", "node", "component", "n", "rare", "keys", "sign")
             .repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
             .mapInArrow(_across(percent), "a binary, b binary"))
    links = cut_lineage(links.unionByName(confirmed(apart)))
    comps = components(links, "a", "b")

    known = features.select("id", "digest", "n_shingles", "node").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = known.withColumn("rank", F.coalesce("id", F.lit(NO_ID)))
    ids = known.where("component is not null").groupBy("component").agg(F.min("rank").alias("least"))
    out = known.join(ids, "component", "left").withColumn("component_id", F.nullif(F.coalesce("least", "rank"), F.lit(NO_ID)))
    return out.select("id", "digest", "n_shingles", "component_id", F.expr("id <=> component_id").alias("kept"))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component those under its smallest id. Rows repeated under an id,
    or without one, stay or go each by its own text."""
    kept = _judged(docs, id, text, **limits).where("kept").select(F.col("id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    rows = docs.withColumn("__digest_of", _digest(text_or_empty(text)))
    return rows.join(kept, F.col(id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest_of") == F.col("__digest")), "left_semi").drop("__digest_of")
