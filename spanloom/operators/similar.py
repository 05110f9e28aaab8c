"""Near-duplicate fingerprints and top-k vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BANDS, _BITS = 4, 16


def _probes(radius: int) -> list[int]:
    """Every mask over one band with at most ``radius`` bits set."""
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(_BITS), n)]


def look_classes(looks: DataFrame, ident: str, hashes: Sequence[str]) -> DataFrame:
    """Which class of equal fingerprints each row is in: ident and class, the smallest id of the class. Rows without a fingerprint have none."""
    at = [F.col(h).alias(f"__{h}") for h in hashes]
    same = reduce(lambda x, y: x & y, (F.col(h) == F.col(f"__{h}") for h in hashes))
    named = looks.groupBy(*at).agg(F.min(ident).alias("class"))
    return looks.join(named, same).select(ident, "class")


def look_alikes(looks: DataFrame, ident: str, key: str, at: str, hashes: Sequence[str], most: int, every: bool = False) -> DataFrame:
    """Pairs of classes of equal fingerprints that look alike: first, second (the classes' smallest ids), bits and pairs.

    Two rows look alike if their three 64-bit fingerprints differ in at most ``most`` bits at the median. Only rows of different keys
    count, and not those next to each other at places ``at``; ``pairs`` is how many such pairs of rows the two classes hold (a class also with
    itself), and a pair of classes without any is left out. With ``every`` rows of equal keys count as well, and ``apart`` is how many of the pairs
    are of different keys. ``look_classes`` says who is in a class, so a
    million copies are one row and are never spread out into pairs.

    A median within reach means two of the three fingerprints are, so the first or the second is; and of
    four 16-bit bands one differs in at most a quarter of the bits. Bands of classes are joined with all masks of that
    many bits, which is exact, and far more selective than splitting into one band more than the bits
    allowed. The masked side looks smaller than it is, so that join is never left to a broadcast. Counting by class and key takes the rows of equal keys off the product of the classes' sizes. Rows with a null
    key are of different keys from all; rows without a fingerprint look like none.
    """
    radius = most // _BANDS
    held = looks.dropna(subset=list(hashes)).select(F.col(ident).alias("__id"), F.col(key).alias("__key"), F.col(at).alias("__at"),
                                                    F.concat_ws("/", *[F.col(h).cast("string") for h in hashes]).alias("__look"), *hashes)
    counts = held.groupBy("__look", "__key").agg(F.count(F.lit(1)).alias("__n"))
    kinds = held.groupBy("__look", *hashes).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    bands = F.array(*[F.struct(F.lit(n * _BANDS + b).alias("slot"), F.expr(
        f"shiftrightunsigned({hashes[n]}, {b * _BITS}) & {(1 << _BITS) - 1}").alias("band"))
        for n in range(2) for b in range(_BANDS)])
    a = kinds.select("__first", "__n", *hashes, F.inline(bands))
    masks = F.array(*[F.lit(m).cast("long") for m in _probes(radius)])
    b = kinds.select(F.col("__first").alias("__second"), F.col("__n").alias("__m"), *[F.col(h).alias(f"__o{h}") for h in hashes], F.inline(bands))
    b = b.withColumn("__mask", F.explode(masks)).withColumn("band", F.expr("band ^ __mask")).drop("__mask")
    dist = F.array_sort(F.array(*[F.bit_count(F.col(h).bitwiseXOR(F.col(f"__o{h}"))) for h in hashes]))
    look = F.concat_ws("/", *[F.col(h).cast("string") for h in hashes])
    other = F.concat_ws("/", *[F.col(f"__o{h}").cast("string") for h in hashes])
    near = a.join(b.hint("merge"), ["slot", "band"]).where(F.col("__first") <= F.col("__second")).withColumn(
        "bits", F.element_at(dist, len(hashes) // 2 + 1)).where(F.col("bits") <= most).select(
        look.alias("__look"), other.alias("__other"), "__first", "__second", "__n", "__m", "bits").distinct()
    # Pairs of one key, and pairs of neighbours of two keys, per pair of classes.
    mine = counts.where("__key is not null").select("__look", "__key", F.col("__n").alias("__a"))
    theirs = counts.where("__key is not null").select(F.col("__look").alias("__other"), "__key", F.col("__n").alias("__b"))
    own = F.when(F.col("__look") == F.col("__other"), F.expr("__a * (__a - 1) div 2")).otherwise(F.col("__a") * F.col("__b"))
    alike = near.select("__look", "__other").join(mine, "__look").join(theirs, ["__other", "__key"]).groupBy("__look", "__other").agg(F.sum(own).alias("__same"))
    nxt = held.select((F.col("__at") - 1).alias("__at"), F.col("__look").alias("__l"), F.col("__key").alias("__k"))
    differ = F.expr("coalesce(__key <> __k, true)").cast("long")
    beside = held.join(nxt, "__at").select("__look", F.col("__l").alias("__other"), differ.alias("__differ"))
    beside = beside.unionByName(beside.where("__look <> __other").select(F.col("__other").alias("__look"), F.col("__look").alias("__other"), "__differ"))
    beside = beside.groupBy("__look", "__other").agg(F.count(F.lit(1)).alias("__next"), F.sum("__differ").alias("__beside"))
    all_ = F.when(F.col("__look") == F.col("__other"), F.expr("__n * (__n - 1) div 2")).otherwise(F.col("__n") * F.col("__m"))
    told = near.join(alike, ["__look", "__other"], "left").join(beside, ["__look", "__other"], "left")
    zero = F.lit(0).cast("long")
    told = told.withColumn("pairs", all_ - F.coalesce("__next", zero)).withColumn("apart", all_ - F.coalesce("__same", zero) - F.coalesce("__beside", zero))
    if not every:
        told = told.withColumn("pairs", F.col("apart")).drop("apart")
    return told.where("pairs > 0").select(F.col("__first").alias("first"), F.col("__second").alias("second"), "bits", "pairs", *["apart"] * every)
