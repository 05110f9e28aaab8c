"""Filter interaction audit: what each of five filters removes in every order of applying them.

A table of byte classes drives one pass over the UTF-8 bytes of each text. Its only state is whether the byte before lay inside a word, so the
pass runs over whole blocks of bytes at once: it counts code points, capitals and symbols, and every word that ends is inserted into a hash
table, which compares the bytes of words whose hashes are equal. From there on a text is five bits and a digest; documents are only counted,
and the orders are applied to those counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import text_or_empty

SPACE, CAPITAL, SYMBOL, CONTINUES = 1, 2, 4, 8
BLOCK = 1 << 20  # bytes that the pass reads at once
CHUNK = 1 << 22  # bytes of whole texts that share one hash table
MEASURES = ["n_words", "n_distinct", "n_points", "n_capitals", "n_symbols"]

# A filter's letter and the condition under which a text fails it.
RULES: Mapping[str, Column | str] = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_capitals > 5 * n_points",
    "D": "n_symbols > 0",
}
COPY = "E"  # fails what is identical to the text of a smaller id


def byte_classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    table[ord("A"):ord("Z") + 1] = CAPITAL
    table[list(b"#$%&*|")] = SYMBOL
    table[0x80:0xC0] = CONTINUES
    return table


CLASSES = byte_classes()
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class WordTable:
    """Distinct (owner, word) pairs over the bytes of a chunk, in open addressing. Equal hashes are settled by the bytes themselves."""

    def __init__(self, data: np.ndarray):
        self.eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # eight bytes from each place on
        self.slots = np.full(1 << 10, -1, np.int64)
        self.start = self.size = self.owner = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)

    def _piece(self, start: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
        """Bytes ``at`` to ``at`` + 8 of each word, as far as it reaches."""
        return self.eight[start + at] & _MASKS[np.minimum(size - at, 8)]

    def _hashes(self, start: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
        h = (owner.astype(np.uint64) * _ODD[2]) ^ (size.astype(np.uint64) * _ODD[1])
        at, on = 0, np.arange(len(start))
        while len(on):
            x = (h[on] ^ self._piece(start[on], size[on], at)) * _ODD[0]
            h[on] = x ^ (x >> np.uint64(29))
            at += 8
            on = on[size[on] > at]
        return h

    def _same(self, mine: tuple, rep: np.ndarray) -> np.ndarray:
        start, size, owner, h = mine
        same = (h == self.hash[rep]) & (size == self.size[rep]) & (owner == self.owner[rep])
        at, on = 0, np.flatnonzero(same)
        while len(on):
            differ = self._piece(start[on], size[on], at) != self._piece(self.start[rep[on]], size[on], at)
            same[on[differ]] = False
            at += 8
            on = on[~differ & (size[on] > at)]
        return same

    def _grow(self, more: int) -> None:
        n = len(self.slots)
        while n < 2 * (len(self.start) + more):
            n *= 2
        if n == len(self.slots):
            return
        self.slots = np.full(n, -1, np.int64)
        mask, left = np.uint64(n - 1), np.arange(len(self.start))
        at = (self.hash & mask).astype(np.int64)
        while len(left):  # all differ, so each only looks for a free slot
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = free
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & (n - 1)

    def insert(self, start: np.ndarray, size: np.ndarray, owner: np.ndarray) -> None:
        self._grow(len(start))
        n = len(self.slots)
        h = self._hashes(start, size, owner)
        at, left = (h & np.uint64(n - 1)).astype(np.int64), np.arange(len(start))
        while len(left):
            holder = self.slots[at[left]]
            claim = left[holder < 0]
            if len(claim):  # of those that meet at a free slot one gets it; the others compare themselves with it
                number = len(self.start) + np.arange(len(claim))
                self.slots[at[claim]] = number
                won = claim[self.slots[at[claim]] == number]
                self.slots[at[won]] = len(self.start) + np.arange(len(won))
                self.start, self.size, self.owner, self.hash = (np.concatenate(x) for x in (
                    (self.start, start[won]), (self.size, size[won]), (self.owner, owner[won]), (self.hash, h[won])))
                holder = self.slots[at[left]]
            same = self._same((start[left], size[left], owner[left], h[left]), holder)
            left = left[~same]
            at[left] = (at[left] + 1) & (n - 1)


def measured(texts: list[bytes]) -> np.ndarray:
    """The MEASURES of each text, one row a text. Words are the longest runs without ASCII white space and may be of any length."""
    out = np.zeros((len(texts), len(MEASURES)), np.int64)
    if not texts:
        return out
    data = np.frombuffer(b" ".join([*texts, b"        "]), np.uint8)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    table, within, begun = WordTable(data), False, 0
    for at in range(0, int(first[-1]), BLOCK):
        kinds = CLASSES[data[at:min(at + BLOCK, int(first[-1]))]]
        inside = kinds != SPACE
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1 + at
        if inside[0] != within:
            turns = np.concatenate([[at], turns])
        if within:
            turns = np.concatenate([[begun], turns])
        within = bool(inside[-1])
        if within:
            begun, turns = int(turns[-1]), turns[:-1]
        start, end = turns[::2], turns[1::2]
        owner = np.searchsorted(first, start, "right") - 1
        table.insert(start, end - start, owner)
        out[:, 0] += np.bincount(owner, minlength=len(texts))
        edges = np.clip(first - at, 0, len(kinds))
        for i, hit in ((2, kinds != CONTINUES), (3, kinds == CAPITAL), (4, kinds == SYMBOL)):
            upto = np.concatenate([[0], np.cumsum(hit)])[edges]
            out[:, i] += upto[1:] - upto[:-1]
    out[:, 1] = np.bincount(table.owner, minlength=len(texts))
    out[:, 2] -= 1  # the space that divides texts
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, size, begun = [], 0, 0
        for i, text in enumerate(batch.column("text")):
            held.append(text.as_buffer().to_pybytes())
            size += len(held[-1])
            if size >= CHUNK or i + 1 == batch.num_rows:
                rows = batch.slice(begun, len(held))
                counts = measured(held)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("part"), pa.array([hashlib.sha256(t).digest() for t in held], pa.binary()), *map(pa.array, counts.T.copy())],
                    names=["id", "part", "digest", *MEASURES])
                held, size, begun = [], 0, i + 1


def text_measures(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, part (null: empty), digest (SHA-256 of the whole text) and the MEASURES. A null text counts as empty
    and has zeros. Repeated rows are measured like any other, an empty table gives an empty result, other columns are not looked at."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.encode(text_or_empty(text), "UTF-8").alias("text"))
    return rows.mapInArrow(_measure, "id long, part string, digest binary, " + ", ".join(f"{m} long" for m in MEASURES))


def failure_counts(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source",
                   rules: Mapping[str, Column | str] = RULES, copy: str = COPY) -> DataFrame:
    """How many documents of a part fail just these filters: part, fails (bit i for the i-th letter of ``rules`` and then ``copy``), good, toxic, n.

    A document fails ``copy`` if a row with a smaller id has the identical text, in whatever part. Texts are held against each other by their
    SHA-256. Rows with a null id neither fail ``copy`` nor make others fail it, and have no labels; rows repeated under the smallest id all
    pass it. ``labels`` may be null, absent or repeated for an id: it is good if any of its rows has quality 1, toxic if any has toxic 1.
    Rows are brought together by the text's digest only after equal ones were counted, so a group of copies arrives as one row per part and label.
    """
    bits = sum((F.when(F.expr(r) if isinstance(r, str) else r, F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules.values())), F.lit(0))
    rows = text_measures(docs, id, text, part).groupBy("id", "digest", "part", bits.alias("fails")).agg(F.count(F.lit(1)).alias("n"))
    said = labels.select(F.col(id).cast("long").alias("id"), "quality", "toxic").where("id is not null").groupBy("id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Rows without an id have no partner; numbers of their own keep them from meeting in one task.
    rows = rows.withColumn("named", F.col("id").isNotNull()).withColumn("key", F.coalesce("id", F.monotonically_increasing_id()))
    said = said.select(F.col("id").alias("key"), F.lit(True).alias("named"), "good", "toxic")
    told = rows.join(said, ["key", "named"], "left").select("id", "digest", "part", "fails", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    each = told.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("named"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    # One row per text, part and label from here on. The rows of the smallest id of a text pass.
    least = F.min("first.id").over(W.partitionBy("digest"))
    copies = F.col("named") - F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    each = each.withColumn("least", least).withColumn("copies", copies)
    both = F.explode(F.array(F.struct(F.col("fails"), (F.col("n") - F.col("copies")).alias("n")),
                             F.struct((F.col("fails") + (1 << len(rules))).alias("fails"), F.col("copies").alias("n"))))
    return each.select("part", "good", "toxic", both.alias("x")).groupBy("part", "x.fails", "good", "toxic").agg(F.sum("x.n").alias("n")).where("n > 0")


def filter_audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source",
                 rules: Mapping[str, Column | str] = RULES, copy: str = COPY) -> DataFrame:
    """For each part, each order of the filters and each step of it: part, filter_order, step (from 1), kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley, all counts of documents of that part.

    ``kept`` pass this filter and all before it, ``removed`` are the first to fail here, ``redundant`` fail here but were removed before,
    ``unique_fails`` fail no other filter, ``shapley`` is the sum of the filter's ``removed`` over all orders. Steps without such documents
    have zeros. ``failure_counts`` says how nulls, repeats and labels count; an empty table gives an empty result.
    """
    letters = "".join(rules) + copy
    orders = ["".join(p) for p in permutations(letters)]
    steps = [(o, i + 1, 1 << letters.index(o[i]), sum(1 << letters.index(x) for x in o[:i])) for o in orders for i in range(len(letters))]
    table = ", ".join(f"struct('{o}' AS filter_order, {i} AS step, {own} AS own, {before} AS before)" for o, i, own, before in steps)
    # At most 4 * 2 ** filters rows a part, each spread over the fixed list of steps.
    met = failure_counts(docs, labels, id, text, part, rules, copy).select("*", F.expr(f"inline(array({table}))"))
    fails, early = F.col("fails").bitwiseAND(F.col("own")) > 0, F.col("fails").bitwiseAND(F.col("before")) > 0
    here = fails & ~early

    def total(when: Column, name: str) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(F.lit(0))).cast("long").alias(name)
    out = met.groupBy("part", "filter_order", "step", "own").agg(
        total(~fails & ~early, "kept"), total(here, "removed"), total(fails & early, "redundant"), total(F.col("fails") == F.col("own"), "unique_fails"),
        total(here & F.col("good"), "good_lost"), total(here & F.col("toxic"), "toxic_lost"))
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "own"))).drop("own")
