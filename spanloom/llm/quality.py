"""A quality classifier by nearest-neighbour voting in a latent-semantic space.

A text's terms are trigrams of character kinds (letters of either case, digits, white space, each punctuation mark) and repeats of words, so
that a score follows how a text is made and not which words or languages it uses. A bounded sample of labelled rows gives term
weights, the latent space and the labelled vectors; these are broadcast, and every document is compared with all of them, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import two_columns

TERMS = 4096
KINDS = 48
BLOCK = 1 << 20  # bytes of a text looked at together
ROWS = 256  # documents compared together


def _kind_table() -> np.ndarray:
    """Bytes to kinds: 0 other, 1 lower case, 2 upper case, 3 digit, 4 line feed, 5 other white space, 6 beyond ASCII, then each mark."""
    table = np.zeros(256, np.int64)
    marks = iter(range(7, KINDS))
    for b in range(256):
        c = chr(b)
        if b > 127:
            table[b] = 6
        elif c.islower() or c.isupper():
            table[b] = 1 + c.isupper()
        elif c.isdigit():
            table[b] = 3
        elif c.isspace():
            table[b] = 5 - (c == "\n")
        elif b > 32 and b < 127:
            table[b] = next(marks)
    return table


_KIND = _kind_table()
_SLOT = np.random.default_rng(8).integers(8, TERMS, KINDS ** 3)  # the first eight terms are for repeats


def term_counts(text: bytes) -> np.ndarray:
    """Counts of a whole text's terms."""
    counts = np.zeros(TERMS, np.float32)
    for at in range(0, len(text), BLOCK):
        k = _KIND[np.frombuffer(text[at:at + BLOCK + 2], np.uint8)]
        if len(k) > 2:
            counts += np.bincount(_SLOT[(k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:]], minlength=TERMS)
        words = text[at:at + BLOCK].split()
        counts[0] += len(words)
        counts[1] += sum(map(eq, words, words[1:]))
        counts[2] += sum(map(eq, words, words[2:]))
        counts[3] += sum(map(bytes.isupper, words))
    return counts


@dataclass
class Model:
    weights: np.ndarray  # of the terms
    space: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # of the labelled rows, of unit length
    labels: np.ndarray
    near: int

    def vector(self, counts: np.ndarray) -> np.ndarray:
        """Rows of counts into the latent space, of unit length; a row without terms stays zero."""
        rate = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)) * self.weights
        z = rate @ self.space
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest labelled rows, each counted by its similarity; the mean label where none is similar."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        similar = self.vector(counts) @ self.vectors.T
        k = min(self.near, similar.shape[1])
        at = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(similar, at, axis=1), 0).astype(np.float64) ** 8
        total = weight.sum(axis=1)
        mean = float(self.labels.mean())
        return np.where(total > 1e-9, (weight * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-9), mean)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [term_counts(t.as_buffer().to_pybytes()) for t in batch.column(1)]
        at = [np.flatnonzero(r).astype(np.int32) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(rows, at)], pa.list_(pa.float32()))],
                                         names=["label", "at", "counts"])


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = 3000,
          dimensions: int = 64, near: int = 15) -> Model:
    """Fits on at most ``rows`` labelled rows, those whose ids have the smallest hashes: no more than that reaches the driver.

    Labels other than 0 and 1 (null too) are not used. Of an id with several labels or texts, every pair is a row, up to the bound.
    """
    known = labels.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and id is not null").distinct()
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    sample = two_columns(docs, id, text).join(F.broadcast(chosen), "id").select("label", F.encode("text", "UTF-8").alias("text"), "id")
    sample = sample.orderBy(F.xxhash64("id"), "id", "label", F.xxhash64("text")).limit(rows)
    found = sample.select("label", "text").mapInArrow(_counted, "label int, at array<int>, counts array<float>").toArrow()
    counts = np.zeros((found.num_rows, TERMS), np.float32)
    for row, (at, values) in enumerate(zip(found.column("at").to_pylist(), found.column("counts").to_pylist())):
        counts[row, at] = values
    y = found.column("label").to_numpy().astype(np.float64)
    if not len(y):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, near)
    weights = np.log((1 + len(y)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)) * weights
    # Truncated decomposition: two power steps from a fixed random start.
    start = np.random.default_rng(1).standard_normal((TERMS, min(dimensions + 16, len(y)))).astype(np.float32)
    for _ in range(2):
        q, _ = np.linalg.qr(x @ start)
        start = x.T @ q
    q, _ = np.linalg.qr(x @ start)
    space = np.linalg.svd(q.T @ x, full_matrices=False)[2][:dimensions].T.astype(np.float32)
    model = Model(weights, np.ascontiguousarray(space), np.zeros((0, 1), np.float32), y, near)
    model.vectors = model.vector(counts)
    return model


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and score, from 0 to 1. Null and empty texts, like all without terms, get the mean label
    (0.5 if nothing was learnt). Null and repeated ids are scored like any other row; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                counts = np.stack([term_counts(t.as_buffer().to_pybytes()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(counts), pa.float64())], names=["id", "score"])
    rows = two_columns(docs, id, text).select("id", F.encode("text", "UTF-8").alias("text"))
    return rows.mapInArrow(run, "id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts score ``least`` or more.

    Each row is judged by its own text, so repeated rows and ids stay or go one by one. A null text counts as empty and, like all
    without terms, has the mean label of what was learnt. An empty table gives an empty result. Only the text goes to Python, and only the
    score comes back, whatever else the rows carry.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        found = [shared.value.scores(np.stack([term_counts(t.encode("utf-8")) for t in texts[start:start + ROWS]])) for start in range(0, len(texts), ROWS)]
        return pd.Series(np.concatenate([np.zeros(0), *found]))
    return docs.where(scored(F.coalesce(F.col(text).cast("string"), F.lit(""))) >= least)


def held_out(id: str | Column = "doc_id", folds: int = 5) -> Column:
    """Rows that are kept from learning: those whose id's checksum is divisible by the number of folds. A null id is not held out."""
    column = F.col(id) if isinstance(id, str) else id
    return F.coalesce(F.crc32(F.encode(column.cast("string"), "UTF-8")) % folds == 0, F.lit(False))
