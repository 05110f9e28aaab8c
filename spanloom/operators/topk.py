"""Rankings: vectors, quotas, variety, covers, eviction, natural order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import by_width, exact_quantiles, ordered_scan, running_sum

# So many query vectors go to the tasks at once; a larger table of queries is searched block by block.
QUERY_BLOCK = 4096


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean vector per key, summed by dimension; only one value a dimension meets in the end."""
    keys = list(keys)
    per = df.select(*keys, F.posexplode(vector).alias("__d", "__v")).groupBy(*keys, "__d").agg(F.avg(F.col("__v").cast("double")).alias("__m"))
    grouped = per.groupBy(*keys) if keys else per.groupBy()
    return grouped.agg(F.transform(F.array_sort(F.collect_list(F.struct("__d", "__m"))), lambda x: x["__m"]).alias("query"))


def meaning_search(rows: DataFrame, query: DataFrame, ident: str, vector: str, n: int, skip: int = 0) -> DataFrame:
    """Rows by cosine to one query vector with the highest, median and lowest score of all that passed."""
    # The query is one row.
    scored = rows.join(F.broadcast(query)).select(ident, F.round(cosine(F.col(vector), F.col("query")), 9).alias("score"))
    top = scored.orderBy(F.col("score").desc(), ident).offset(skip).limit(n)
    stats = scored.agg(F.max("score").alias("highest"), F.min("score").alias("lowest"))
    mid = exact_quantiles(scored.withColumn("__one", F.lit(1)), ["__one"], "score", {"median": 0.5}, 0.01).drop("__one")
    # Two tables of one row each.
    return top.join(F.broadcast(stats)).join(F.broadcast(mid))


def knn(vectors: DataFrame, queries: DataFrame, ident: str, vector: str, query: str, k: int) -> DataFrame:
    """The k closest vectors to each query, exactly.

    A block of query vectors is sent to every task; each Arrow batch is multiplied against it and only its
    own k best per query leave the task, so what is shuffled does not grow with the pairs.
    """
    kind, qkind = dict(vectors.dtypes)[ident], dict(queries.dtypes)[query]
    numbered = queries.withColumn("__b", F.lit(0))
    held = queries.count()
    blocks = max(1, -(-held // QUERY_BLOCK))
    if blocks > 1:
        numbered = queries.withColumn("__b", F.pmod(F.xxhash64(query), F.lit(blocks)).cast("int"))
    found = None
    for block in range(blocks):
        rows = numbered.where(F.col("__b") == block).select(query, "query").collect()
        if not rows:
            continue
        names = [r[0] for r in rows]
        q = np.asarray([r[1] for r in rows], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

        def local(batches, names=names, q=q):
            for pdf in batches:
                if not len(pdf):
                    continue
                m = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                s = np.round(q @ m.T, 9)
                ids = pdf[ident].to_numpy()
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                yield pd.DataFrame({
                    query: np.repeat(names, order.shape[1]), ident: ids[order].ravel(),
                    "score": np.take_along_axis(s, order, axis=1).ravel()})
        part = vectors.select(ident, vector).mapInPandas(local, f"`{query}` {qkind}, `{ident}` {kind}, score double")
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy(query).orderBy(F.col("score").desc(), ident)
    return found.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def with_quotas(cands: DataFrame, group: str, item: str, file: str, unread: str, order: Sequence[Column], places: int = 8,
                per_file: int = 2, kept: int = 2) -> DataFrame:
    """The best of each group: read ones in order, some places kept for unread ones, few from one file.

    Every step keeps a bounded number of rows per group, which Spark limits before it shuffles.
    """
    def first(df, keys, n, name):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    # No more than `per_file` of a file can be taken whatever happens, and an unread one that many back neither.
    # The candidates are read once: as many of each file are kept as tell whether a group has `kept` unread ones.
    base = cut_lineage(first(cands, [group, unread, file], max(per_file, kept), "__f"))
    some = base.where(F.col(unread)).groupBy(group).agg(F.count(F.lit(1)).alias("__u"))
    base = base.where(F.col("__f") <= per_file)
    read = base.where(~F.col(unread)).join(some, group, "left")
    room = places - F.least(F.lit(kept), F.coalesce("__u", F.lit(0)))
    one = cut_lineage(first(read, [group], places, "__n").where(F.col("__n") <= room).select(group, item, file))

    def used(df):
        return df.groupBy(group, file).agg(F.count(F.lit(1)).alias("__used")), df.groupBy(group).agg(F.count(F.lit(1)).alias("__taken"))

    def fill(pool, done):
        by_file, by_group = used(done)
        again = pool.drop("__f").join(done.select(group, item), [group, item], "left_anti")
        again = first(again, [group, file], per_file, "__f").join(by_file, [group, file], "left").join(by_group, group, "left")
        open_ = again.where(F.col("__f") + F.coalesce("__used", F.lit(0)) <= per_file)
        return first(open_, [group], places, "__n").where(F.col("__n") <= places - F.coalesce("__taken", F.lit(0))).select(group, item, file)
    two = cut_lineage(one.unionByName(fill(base.where(F.col(unread)), one)))
    three = two.unionByName(fill(base.where(~F.col(unread)), two))
    chosen = base.join(three.select(group, item), [group, item], "left_semi")
    w = Window.partitionBy(group).orderBy(F.col(unread), *order)
    return chosen.select(group, item, file, unread, F.row_number().over(w).cast("long").alias("place"))


def variety(offers: DataFrame, group: str, item: str, place: str, top: int = 3) -> DataFrame:
    """For each offer, how many other groups have it near the top too, and the first of them."""
    tops = offers.where(F.col(place) <= top)
    per = tops.groupBy(item).agg(F.count(F.lit(1)).alias("__n"), F.min(group).alias("__first"))
    second = tops.join(per, item).where(F.col(group) != F.col("__first")).groupBy(item).agg(F.min(group).alias("__second"))
    j = offers.join(per, item).join(second, item, "left")
    own = (F.col(place) <= top).cast("long")
    return j.select(group, item, (F.col("__n") - own).alias("others"), F.when(
        F.col("__first") == F.col(group), F.col("__second")).otherwise(F.col("__first")).alias("first_other")).where("others > 0")


def evict(units: DataFrame, used: str, ident: str, size: str, need: int, chunk_width: int) -> DataFrame:
    """The longest unused rows, taken until enough room is made: those whose running total before them is
    still short. One order over the whole table, run up slice by slice."""
    d = units.withColumn("__one", F.lit(1))
    run = ordered_scan(d, ["__one"], [used, ident], by_width(used, chunk_width), {"__before": running_sum(F.col(size), inclusive=False)})
    return run.where(F.col("__before") < need).select(*units.columns)


def natural_key(name: Column) -> Column:
    """Sort key that orders runs of digits by value, however long, and letters without case: a run of digits is
    led by its length."""
    pieces = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    def led(p):
        value = F.coalesce(F.nullif(F.regexp_replace(p, "^0+", ""), F.lit("")), F.lit("0"))
        return F.concat(F.lpad(F.length(value).cast("string"), 10, "0"), value)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), led(p)).otherwise(p)), "")


def spread_picks(spans: DataFrame, ident: str, s: str, e: str, favoured: str, tries: str, count: int, apart: int) -> DataFrame:
    """Farthest-point picks: the favoured moment, then the try farthest from those picked, at least ``apart``
    away. ``tries`` is a short array per span, so it works row by row."""
    @F.pandas_udf("array<bigint>")
    def pick(fav: pd.Series, grid: pd.Series) -> pd.Series:
        out = []
        for f, g in zip(fav, grid):
            got = [] if pd.isna(f) else [int(f)]
            pool = np.asarray([] if g is None else g, dtype=np.int64)
            while len(got) < count and len(pool):
                away = np.min(np.abs(pool[:, None] - np.asarray(got)[None, :]), axis=1) if got else np.full(len(pool), np.iinfo(np.int64).max)
                at = int(np.lexsort((-pool, -away))[0])
                if away[at] < apart:
                    break
                got.append(int(pool[at]))
            out.append(sorted(got))
        return pd.Series(out)
    return spans.select(ident, F.explode(pick(F.col(favoured).cast("double"), F.col(tries))).alias("at"))
