"""Voices heard in several files given one label, and cached vectors kept up to date."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import components

# How far apart two voices may sit and still be one person, in different files, where one is alone in its file, and in one file.
VOICE_DISTANCE, LONE_DISTANCE, SAME_FILE_DISTANCE = 0.45, 0.6, 0.3

BLOCK = 1000  # vectors that meet in one task, at most twice as many
MISSED = 0.01  # how often a pair just within reach may share no bucket
PASS = 4  # blocks of vectors that are held against all others at once
PASSES = 8  # that many are made whatever they bring; while each leaves at most half, more


def tables_and_bits(n: int, reach: float, block: int = BLOCK, missed: float = MISSED) -> tuple[int, int]:
    """How many hash tables of how many hyperplanes: buckets of about ``block`` of ``n`` vectors, and a pair at cosine distance ``reach`` shares none
    of them with a probability of at most ``missed``. Up to ``block`` vectors are one bucket, and nothing is missed."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / block)))
    together = (1 - math.acos(1 - reach) / math.pi) ** bits
    return (1, 0) if not bits else (math.ceil(math.log(missed) / math.log(1 - together)), bits)


def _planes(size: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng(size).standard_normal((size, tables * bits))


def bucketed(vectors: DataFrame, reach: float, block: int = BLOCK, missed: float = MISSED) -> DataFrame:
    """Rows of a table with ``id`` and ``v`` (array of double), each in its buckets: all its columns with bucket, lo and hi.

    Vectors meet by random hyperplanes, and only those of one length. A bucket of more than ``block`` rows is dealt into blocks by id, which meet
    two by two, each pair of blocks (lo, hi) as a group of its own: every two rows of a bucket are in one group. Rows that are no
    vectors (null, empty, all zero, not finite) are in none.
    """
    n = vectors.count()
    tables, bits = tables_and_bits(n, reach, block, missed)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for size, own in _by_length(rows):
                signs = (np.stack(own["v"].to_numpy()) @ _planes(size, tables, bits) > 0).reshape(len(own), tables, bits)
                codes = signs @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(own), tables), np.int64)
                for table in range(tables):
                    yield own.assign(bucket=[f"{size}:{table}:{c}" for c in codes[:, table]])
    schema = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes)
    rows = vectors.mapInPandas(hashed, f"{schema}, bucket string")
    blocks = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = rows.join(blocks, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select(*vectors.columns, "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _unit(rows: pd.Series) -> np.ndarray:
    v = np.stack(rows.to_numpy()).astype(float)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _by_length(rows: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows that are vectors, those of one length together."""
    rows = rows[[x is not None and len(x) > 0 and np.isfinite(x).all() and np.any(x) for x in rows["v"]]]
    return iter(rows.groupby(rows["v"].map(len)))


def _near(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
    """Which classes of ``x`` are linked to which of ``y``."""
    file, _ = pd.factorize(pd.concat([x["first_file"], y["first_file"]]))
    one = np.concatenate([x["first_file"] == x["last_file"], y["first_file"] == y["last_file"]])
    own, others = np.where(one, file, -1)[:len(x)], np.where(one, file, -2)[len(x):]
    reach = np.maximum(x["reach"].to_numpy()[:, None], y["reach"].to_numpy()[None, :])
    return 1 - _unit(x["v"]) @ _unit(y["v"]).T < np.where(own[:, None] == others[None, :], SAME_FILE_DISTANCE, reach)


def _linked(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the classes in one group, an edge from each to the first of those it hangs together with there: never all pairs."""
    near = _near(rows, rows)
    label, before = np.arange(len(rows)), None
    while before is None or (label != before).any():
        before = label
        label = np.minimum(label, np.where(near, label[None, :], len(rows)).min(axis=1))
        label = label[label]
    ids, moved = rows["id"].to_numpy(), label != np.arange(len(rows))
    return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})


def _together(label: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Labels of classes (each the place of the first it is known to hang together with) once those linked to one row hang together too."""
    none = label.dtype.type(len(label))
    while True:
        least = np.where(near, label[None, :], none).min(axis=1)
        lower = np.where(near, least[:, None], none).min(axis=0)
        root = label.copy()
        np.minimum.at(root, label, lower)
        while (root[root] != root).any():
            root = root[root]
        if (root == label).all():
            return label
        label = root


def _slices(batches: Iterator[pd.DataFrame], chosen: dict[int, pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    for rows in batches:
        for size, own in _by_length(rows):
            if size in chosen:
                for at in range(0, len(own), BLOCK):
                    yield size, own.iloc[at:at + BLOCK]


def _against(chosen: pd.DataFrame):
    """Holds all classes against the chosen ones: an edge from each to the first it is linked to, and edges between those of the chosen that
    hang together by the classes of one task."""
    chosen = dict(_by_length(chosen))

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels = {size: np.arange(len(own), dtype=np.int32) for size, own in chosen.items()}
        for size, own in _slices(batches, chosen):
            near = _near(own, chosen[size])
            found = near.any(axis=1)
            if not found.any():
                continue
            labels[size] = _together(labels[size], near[found])
            yield pd.DataFrame({"a": own["id"].to_numpy()[found], "b": chosen[size]["id"].to_numpy()[near[found].argmax(axis=1)]})
        for size, own in chosen.items():
            ids, moved = own["id"].to_numpy(), labels[size] != np.arange(len(own))
            yield pd.DataFrame({"a": ids[moved], "b": ids[labels[size][moved]]})
    return linked


def _share(n: int, block: int, turn: int = 0) -> tuple[Column, int]:
    """A number for each of ``n`` rows by a hash of its id, and how many there are: about PASS blocks of rows have the same, all if there are no more."""
    parts = max(1, math.ceil(n / (PASS * block)))
    return F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(parts)), parts


def linked_classes(points: DataFrame, block: int = BLOCK, missed: float = MISSED) -> DataFrame:
    """Node and component of the classes (id, v, reach, first_file, last_file) that have a link.

    A pass holds some of the classes against all others, so that every link of theirs is known. Of the rest, those that hang together with the largest
    component of the first pass need no look among themselves. While much is left, passes take of those with the widest reach, which meet most; once
    PASSES passes can hold all that is left, they do, and nothing is missed. Where passes leave more than half each time and much
    is left, or none of the widest reach are, the classes meet in buckets (``bucketed``) instead.
    """
    kind, n = dict(points.dtypes)["id"], points.count()
    points = cut_lineage(points.repartition(max(1, math.ceil(n / (PASS * block))), "id"))
    wide = points.groupBy("reach").count().orderBy(F.col("reach").desc()).first()
    rest, left, turn, linked, first, before = points, n, 0, None, None, n
    while left:
        few = left <= PASSES * PASS * block
        part, parts = _share(left, block, turn + 1) if few else _share(wide["count"], block)
        if not few and (turn >= parts or turn >= PASSES and 2 * left > before):
            met = bucketed(points, LONE_DISTANCE, block, missed).groupBy("bucket", "lo", "hi").applyInPandas(_linked, f"a {kind}, b {kind}")
            return components(met.unionByName(linked.toDF("a", "b")), "a", "b")
        taken = part == 0 if few else (F.col("reach") == wide["reach"]) & (part == turn)
        chosen = (rest if few else points).where(taken).toPandas()
        found = points.mapInPandas(_against(chosen), f"a {kind}, b {kind}")
        linked = cut_lineage(components(found if linked is None else found.unionByName(linked.toDF("a", "b")), "a", "b"))
        if first is None:
            first = linked.groupBy("component").count().orderBy(F.col("count").desc(), "component").first()
        rest = rest.where(~taken)
        if first is not None:
            held = linked.where(F.col("node") == F.lit(first["component"])).first()["component"]
            rest = rest.join(linked.where(F.col("component") == F.lit(held)).select(F.col("node").alias("id")), "id", "left_anti")
        rest = cut_lineage(rest)
        before, left, turn = left, rest.count(), turn + 1
    return points.selectExpr("id AS node", "id AS component") if linked is None else linked


def _closest(prints: pd.DataFrame):
    """For each voice the nearest of these prints."""
    prints = dict(_by_length(prints.sort_values("id", kind="stable")))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for size, own in _slices(batches, prints):
            apart = 1 - _unit(own["v"]) @ _unit(prints[size]["v"]).T
            best = np.round(apart, 9).argmin(axis=1)
            yield pd.DataFrame({"id": own["id"].to_numpy(), "label": prints[size]["id"].to_numpy()[best], "distance": apart[np.arange(len(own)), best]})
    return nearest


def nearest_prints(voices: DataFrame, prints: DataFrame, block: int = BLOCK, missed: float = MISSED) -> DataFrame:
    """Id, label and distance of prints (id, v) near to voices (id, v): the nearest of each pass over at most PASSES times PASS blocks of prints. More
    prints meet the voices in buckets, where one within LONE_DISTANCE may be missed."""
    kind, n = dict(voices.dtypes)["id"], prints.count()
    told = f"id {kind}, label {kind}, distance double"
    part, parts = _share(n, block)
    if parts > PASSES:
        both = voices.withColumn("print", F.lit(False)).unionByName(prints.withColumn("print", F.lit(True)))
        return bucketed(both, LONE_DISTANCE, block, missed).groupBy("bucket", "lo", "hi").applyInPandas(_nearest, told)
    voices = cut_lineage(voices.repartition(max(1, math.ceil(voices.count() / (PASS * block))), "id"))
    found = [voices.mapInPandas(_closest(prints.where(part == i).toPandas()), told) for i in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _nearest(rows: pd.DataFrame) -> pd.DataFrame:
    """For each voice in one group the nearest print there."""
    prints, voices = rows[rows["print"]], rows[~rows["print"]]
    if prints.empty or voices.empty:
        return pd.DataFrame({"id": voices["id"][:0], "label": prints["id"][:0], "distance": []})
    apart = 1 - _unit(voices["v"]) @ _unit(prints["v"]).T
    order = np.argsort(prints["id"].to_numpy(), kind="stable")
    best = order[apart[:, order].argmin(axis=1)]
    return pd.DataFrame({"id": voices["id"].to_numpy(), "label": prints["id"].to_numpy()[best], "distance": apart[np.arange(len(voices)), best]})


def _apart(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def join_voices(voices: DataFrame, ident: str, file: str, vector: str, seconds: str, block: int = BLOCK, missed: float = MISSED) -> DataFrame:
    """ident, label, distance: one label, the smallest id, for the same voice across files, and how far the voice sits from its print.

    Two voices of different files are linked when they sit within VOICE_DISTANCE of each other, or LONE_DISTANCE if one is alone in its file; two of one
    file within SAME_FILE_DISTANCE. What hangs together by links gets a print, its average by seconds. Every voice then takes the nearest
    print within the reach of its file; of the voices of one file that take the same, the one heard longest keeps it, and the others
    only within SAME_FILE_DISTANCE. A voice without a print stands alone. So a chain whose ends sit far from its middle comes apart.
    Nothing depends on the order of the files, which a greedy pass would.

    Equal vectors are one point from the start. Others are linked in passes (``linked_classes``) and take their prints in passes (``nearest_prints``),
    and no link is missed; where passes would not end, vectors meet in buckets of random hyperplanes (``bucketed``), and a pair just within
    LONE_DISTANCE is missed with probability ``missed``, nearer ones less. A null, empty or zero vector
    stands alone with a null distance. Ids must be unique and not null; a null file is a file of its own for each voice.
    """
    v = voices.select(F.col(ident).alias("id"), F.coalesce(F.col(file).cast("string"), F.concat(F.lit("no file "), F.col(ident).cast("string"))).alias("file"),
                      F.when(F.exists(vector, lambda x: x.isNull() | F.isnan(x)), F.array()).otherwise(F.coalesce(vector, F.array())).cast("array<double>").alias("v"), F.col(seconds).cast("double").alias("seconds"))
    alone = v.groupBy("file").agg((F.count(F.lit(1)) == 1).alias("alone"))
    reach = F.when(F.col("alone"), LONE_DISTANCE).otherwise(VOICE_DISTANCE)
    v = cut_lineage(v.join(alone, "file").withColumn("reach", reach).drop("alone").withColumn("shape", F.xxhash64("v")))
    # One row per different vector and reach; only the smallest and largest file matter for whether two can be of different files.
    points = cut_lineage(v.groupBy("shape", "v", "reach").agg(F.min("id").alias("id"), F.min("file").alias("first_file"), F.max("file").alias("last_file")))
    linked = linked_classes(points.drop("shape"), block, missed)
    named = points.join(linked.withColumnRenamed("node", "id"), "id", "left").select(
        "shape", "v", "reach", F.coalesce("component", "id").alias("group"))
    # Equal vectors are alike whatever their reach.
    same = named.groupBy("shape", "v").agg(F.min("group").alias("a"), F.max("group").alias("b"))
    merged = components(same.where("a <> b").select("a", "b"), "a", "b").withColumnRenamed("node", "group")
    named = same.select("shape", "v", F.col("a").alias("group")).join(merged, "group", "left").select("shape", "v", F.coalesce("component", "group").alias("group"))
    grouped = cut_lineage(v.join(named, ["shape", "v"]).select("id", "file", "v", "seconds", "reach", "group"))
    each = grouped.select("group", "seconds", F.posexplode("v").alias("at", "x"))
    prints = each.groupBy("group", "at").agg((F.sum(F.col("x") * F.col("seconds")) / F.sum("seconds")).alias("m")).groupBy("group").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda x: x["m"]).alias("print"))  # as long as a vector
    prints = cut_lineage(prints)
    found = nearest_prints(grouped.select("id", "v"), prints.select(F.col("group").alias("id"), F.col("print").alias("v")), block, missed)
    own = grouped.join(prints, "group").select("id", F.col("group").alias("label"), _apart("v", "print").alias("distance"))
    # Distances are rounded before they are compared, so that no sum's order decides.
    best = found.unionByName(own.where("distance is not null")).groupBy("id").agg(F.min(F.struct(F.round("distance", 9).alias("distance"), "label")).alias("best"))
    placed = cut_lineage(grouped.join(best, "id", "left").select("id", "file", "seconds", "best.label", "best.distance", (F.col("best.distance") < F.col("reach")).alias("fits")))
    longest = placed.where("fits").groupBy("file", "label").agg(F.min(F.struct((-F.col("seconds")).alias("less"), F.col("id"))).alias("x")).select(
        "file", "label", F.col("x.id").alias("longest"))
    stays = F.coalesce(F.col("fits") & ((F.col("id") == F.col("longest")) | (F.col("distance") < SAME_FILE_DISTANCE)), F.lit(False))
    placed = cut_lineage(placed.join(longest, ["file", "label"], "left").select("id", "label", "distance", stays.alias("stays")))
    names = placed.where("stays").groupBy("label").agg(F.min("id").alias("name"))
    return placed.join(names, "label", "left").select(
        F.col("id").alias(ident), F.when(F.col("stays"), F.col("name")).otherwise(F.col("id")).alias("label"),
        F.round(F.when(F.col("stays"), F.col("distance")).when(F.col("distance").isNotNull(), F.lit(0.0)), 6).alias("distance"))


def refresh_vectors(texts: DataFrame, stored: DataFrame, ident: list[str], text: str, model: str, features: int = 256) -> tuple[DataFrame, DataFrame]:
    """What a vector cache has to compute and what it has to drop.

    A digest covers the model and the text, so a changed text is computed again and an unchanged one is not
    touched. Gives (new vectors as hashed word counts, orphans).
    """
    from pyspark.ml.feature import HashingTF
    fresh = texts.withColumn("digest", F.sha1(F.concat(F.lit(model + "\n"), F.col(text))))
    todo = fresh.join(stored.select(*ident, "digest"), [*ident, "digest"], "left_anti")
    words = todo.withColumn("__w", F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    vectors = HashingTF(numFeatures=features, inputCol="__w", outputCol="vector").transform(words).drop("__w", text)
    return vectors, stored.join(fresh.select(*ident), ident, "left_anti")
