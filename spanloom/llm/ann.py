"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a bounded sample, split again and again into balanced halves. Every vector goes to the list of its nearest centroid
and, if it lies near a boundary, to further lists as well. A graph over the centroids, small enough to be broadcast, is searched
for both. A query reads the lists whose centroid is not much farther than its nearest one. Lists longer than ``piece`` rows, such
as that of a very common vector, are split into pieces by a hash of the id, and each query meets all pieces of its lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.session import cut_lineage

LINKS = 24  # neighbours of a centroid in the graph


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square overflows; cosines stay exactly as they are."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def unit(m: np.ndarray) -> np.ndarray:
    m = scaled(m)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def split(points: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of balanced groups of at most ``most`` points: each group is cut at the median along the line between two means."""
    open_groups, means = [np.arange(len(points))], []
    while open_groups:
        group = open_groups.pop()
        x = points[group]
        if len(group) <= most or (x == x[0]).all():
            means.append(x.mean(axis=0))
            continue
        a, b = x[rng.choice(len(x), 2, replace=False)].astype(np.float64)
        for _ in range(8):
            side = (x @ (a - b)) - (a @ a - b @ b) / 2
            near = np.zeros(len(x), bool)
            near[np.argsort(-side, kind="stable")[:len(x) // 2]] = True
            a, b = x[near].mean(axis=0), x[~near].mean(axis=0)
        open_groups += [group[near], group[~near]]
    return np.array(means)


@dataclass
class Centroids:
    at: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, means: np.ndarray) -> Centroids:
        links = []
        for start in range(0, len(means), 512):
            d = ((means ** 2).sum(axis=1) - 2 * means[start:start + 512] @ means.T)
            d[np.arange(d.shape[0]), start + np.arange(d.shape[0])] = np.inf
            k = min(LINKS - 2, len(means) - 1)
            links.append(np.argpartition(d, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((d.shape[0], 0), np.int64))
        near = np.concatenate(links)
        i = np.arange(len(means))
        # Two links along a ring, far apart in general, keep the graph in one piece.
        far = np.stack([(i + 1) % len(means), (i + max(1, len(means) // 2)) % len(means)], axis=1)
        return cls(means, np.concatenate([near, far], axis=1), np.unique(np.linspace(0, len(means) - 1, min(8, len(means))).astype(np.int64)))

    def search(self, q: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``wide`` nearest centroids that a best-first walk finds for each row, nearest first, and their distances."""
        n, wide = len(q), min(wide, len(self.at))
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, len(self.at)), bool)

        def away(ids):
            diff = self.at[ids] - q[:, None, :]
            return np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
        ids = np.tile(self.entries, (n, 1))
        seen[rows, ids] = True
        far, done = away(ids), np.zeros(ids.shape, bool)
        while True:
            waiting = np.where(done, np.inf, far)
            best = waiting.argmin(axis=1)
            if not np.isfinite(waiting[rows[:, 0], best]).any():
                break
            done[rows[:, 0], best] = True
            new = self.links[ids[rows[:, 0], best]]
            old = seen[rows, new]
            seen[rows, new] = True
            d = np.where(old, np.inf, away(new))
            # A centroid may be linked twice from one; its second mention counts as seen.
            first = np.sort(new, axis=1)
            if (first[:, 1:] == first[:, :-1]).any():
                order = np.argsort(new, axis=1, kind="stable")
                again = np.zeros(new.shape, bool)
                sorted_new = np.take_along_axis(new, order, axis=1)
                np.put_along_axis(again, order[:, 1:], sorted_new[:, 1:] == sorted_new[:, :-1], axis=1)
                d[again] = np.inf
            ids, far, done = np.concatenate([ids, new], axis=1), np.concatenate([far, d], axis=1), np.concatenate([done, np.isinf(d)], axis=1)
            if ids.shape[1] > wide:
                keep = np.argpartition(far, wide - 1, axis=1)[:, :wide]
                ids, far, done = (np.take_along_axis(x, keep, axis=1) for x in (ids, far, done))
                done |= np.isinf(far)
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)

    def homes(self, x: np.ndarray, wide: int, ratio: float, most: int, apart: float = 0.25) -> list[list[int]]:
        """The lists of each row: its nearest, and others hardly farther, unless they lie much closer to a list already taken than to the row."""
        ids, far = self.search(x, wide)
        taken = []
        for row, d in zip(ids, far):
            mine = [int(row[0])]
            for c, e in zip(row[1:], d[1:]):
                if not e <= ratio * d[0] or len(mine) >= most:
                    break
                if all(((self.at[c] - self.at[t]) ** 2).sum() > apart * e * e for t in mine):
                    mine.append(int(c))
            taken.append(mine)
        return taken


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """Ids and vectors, as doubles, of the rows that take part."""
    v = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(fine, F.lit(False)))


def _best(k: int):
    """For one piece of a list: each query's ``k`` best by (cosine, smaller id). Products in blocks choose, and what comes within
    rounding of the k-th is computed again pair by pair, so that equal vectors have equal scores."""
    def run(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and asked.num_rows:
            ids, v, of, q = rows.column("id").to_numpy(), unit(matrix(rows.column("v"))), asked.column("query_id").to_numpy(), unit(matrix(asked.column("q")))
            raw_v, raw_q = scaled(matrix(rows.column("v"))), scaled(matrix(asked.column("q")))
            norm = np.sqrt((raw_v * raw_v).sum(axis=1))
            for start in range(0, len(of), 256):
                near = q[start:start + 256] @ v.T
                near[of[start:start + 256, None] == ids[None, :]] = -np.inf
                for i, row in enumerate(near, start):
                    at = np.flatnonzero(np.isfinite(row))
                    if len(at) > k:
                        at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k] - 1e-9]
                    if len(at):
                        exact = (raw_v[at] * raw_q[i]).sum(axis=1) / (norm[at] * np.sqrt((raw_q[i] * raw_q[i]).sum()))
                        best = np.lexsort((ids[at], -exact))[:k]
                        out.append((np.full(len(best), of[i]), ids[at][best], exact[best]))
        joined = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, t) for c, t in ((0, np.int64), (1, np.int64), (2, np.float64))]
        return pa.table({"query_id": joined[0], "vec_id": joined[1], "score": joined[2]})
    return run


def nearest(vectors: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 5, sample: int = 16384, per_list: int = 32,
            copies: int = 8, boundary: float = 1.25, wide: int = 96, ratio: float = 1.35, piece: int = 4096) -> DataFrame:
    """One row per query and neighbour found: query_id, rank (from 1), vec_id and score, the cosine in double precision.

    ``queries`` has the columns of ``vectors``; a query's own row (the same id) is no candidate. Ties go to the smaller id. Centroids are fitted
    on at most ``sample`` vectors, those whose ids have the smallest hashes; every vector is indexed. A query reads the lists
    that are at most ``ratio`` times as far as its nearest, and in any case enough lists to hold ``k`` candidates.

    Rows with a null id, or whose vector is null, empty, zero, or holds null or non-finite components, take no part, nor do those
    of another length than the vectors with the most common one. Rows repeated under an id count once, with the best score.
    An empty table gives an empty result. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    every, asked = usable(vectors, id, vector), usable(queries, id, vector)
    common = every.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = common["n"] if common else 0
    every, asked = every.where(F.size("v") == width), asked.where(F.size("v") == width)
    learnt = every.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    means = split(unit(matrix(learnt.column("v"))), per_list, np.random.default_rng(6)) if learnt.num_rows else np.zeros((1, max(1, width)))
    shared = spark.sparkContext.broadcast(Centroids.of(means))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                homes = shared.value.homes(unit(matrix(part.column(1))), 3 * copies, boundary, copies)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(homes, pa.list_(pa.int32()))], names=["id", "v", "lists"])

    placed = cut_lineage(every.mapInArrow(place, "id long, v array<double>, lists array<int>"))
    posted = placed.select("id", "v", F.posexplode("lists").alias("turn", "list"))
    # One row per list, and no more lists than the sample has points.
    sizes = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("turn") == 0).cast("long")).alias("own")).toArrow()
    own, pieces = np.zeros(len(means), np.int64), np.ones(len(means), np.int64)
    own[sizes.column("list").to_numpy()] = sizes.column("own").to_numpy()
    pieces[sizes.column("list").to_numpy()] = -(-sizes.column("n").to_numpy() // piece)
    told = spark.sparkContext.broadcast(own)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = told.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                q = unit(matrix(part.column(1)))
                ids, far = shared.value.search(q, wide)
                enough = np.cumsum(own[ids], axis=1) - own[ids] <= k  # before this list, not enough for k and the query itself
                wanted = (far <= ratio * far[:, :1] + 1e-12) | enough
                lists = [row[w].tolist() for row, w in zip(ids, wanted)]
                for at in np.flatnonzero(own[ids].sum(axis=1) <= k):  # all that were found hold too few: every list
                    lists[at] = list(range(len(own)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "q", "lists"])

    pieces_df = spark.createDataFrame(pa.table({"list": np.arange(len(pieces), dtype=np.int32), "pieces": pieces.astype(np.int32)}))
    lists = F.broadcast(pieces_df)  # one row per list
    posted = posted.join(lists, "list").select("list", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), "id", "v")
    sought = asked.mapInArrow(read, "query_id long, q array<double>, lists array<int>").select("query_id", "q", F.explode("lists").alias("list"))
    sought = sought.join(lists, "list").select("list", "query_id", "q", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    found = posted.groupBy("list", "piece").cogroup(sought.groupBy("list", "piece")).applyInArrow(_best(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
