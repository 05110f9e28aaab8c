"""Voices, look-alikes and overlapping spans: what hangs together, against brute force."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest

from spanloom.operators import versions, voices
from spanloom.operators.intervals import interval_components
from spanloom.operators.similar import look_alikes, look_classes
from spanloom.operators.voices import bucketed, join_voices, tables_and_bits


def groups_of(n, linked):
    at = list(range(n))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return [root(i) for i in range(n)]


def voices_answer(rows):
    rows = sorted(rows)
    usable = [v is not None and len(v) > 0 and any(v) for _, _, v, _ in rows]
    apart = lambda a, b: 2.0 if len(a) != len(b) else 1 - float(np.dot(a, b)) / float(np.sqrt(np.dot(a, a) * np.dot(b, b)))
    count = collections.Counter(f for _, f, _, _ in rows)
    reach = [0.6 if count[f] == 1 or f is None else 0.45 for _, f, _, _ in rows]

    def linked(i, j):
        (_, f, v, _), (_, g, w, _) = rows[i], rows[j]
        return usable[i] and usable[j] and apart(v, w) < (0.3 if f == g and f is not None else max(reach[i], reach[j]))
    group = groups_of(len(rows), linked)
    prints = {}
    for g in {g for g, u in zip(group, usable) if u}:
        own = [i for i in range(len(rows)) if group[i] == g]
        prints[g] = sum(np.array(rows[i][2]) * rows[i][3] for i in own) / sum(rows[i][3] for i in own)
    best = [min(((round(apart(rows[i][2], p), 9), g) for g, p in prints.items()), default=None) if usable[i] else None for i in range(len(rows))]
    taken = collections.defaultdict(list)
    for i, b in enumerate(best):
        if b is not None and b[0] < reach[i]:
            taken[("none", i) if rows[i][1] is None else rows[i][1], b[1]].append((-rows[i][3], rows[i][0], i))
    stays = {i for own in taken.values() for n, (_, _, i) in enumerate(sorted(own)) if n == 0 or best[i][0] < 0.3}
    name = {}
    for i in sorted(stays):
        name.setdefault(best[i][1], rows[i][0])
    return [(rows[i][0], name[best[i][1]] if i in stays else rows[i][0], round(best[i][0], 6) if i in stays else 0.0 if usable[i] else None) for i in range(len(rows))]


def heard(seed, n):
    pick, rng = random.Random(seed), np.random.default_rng(seed)
    people = rng.standard_normal((9, 12))
    rows = []
    for i in range(n):
        v = people[i % 9] + rng.standard_normal(12) * pick.choice([0.1, 0.4, 0.8])
        rows.append((i * 3 - 20, pick.choice([f"f{pick.randrange(n // 3)}", f"lone{i}"]), v.tolist(), float(pick.randint(1, 9))))
    rows += [(9000, "f1", None, 1.0), (9001, "f1", [], 1.0), (9002, "f2", [0.0] * 12, 2.0), (9003, "f3", rows[5][2], 1.0), (9004, "f3", rows[5][2], 4.0),
             (9005, None, rows[7][2], 1.0), (9006, None, rows[7][2], 1.0), (9007, "short", [1.0, 2.0], 1.0)]
    return rows


def as_voices(spark, rows):
    return spark.createDataFrame([(i, f, v, s, "x", 1) for i, f, v, s in rows], "id long, file string, v array<double>, seconds double, label string, print int")


@pytest.mark.parametrize("seed,block", [(1, 1000), (2, 1000), (3, 40)])
def test_voices(spark, monkeypatch, seed, block):
    """Also with many blocks a bucket: the planes are left out there, so that nothing is missed."""
    if block < 1000:
        monkeypatch.setattr(voices, "tables_and_bits", lambda *a: (1, 0))
    rows = heard(seed, 150)
    got = join_voices(as_voices(spark, rows), "id", "file", "v", "seconds", block).collect()
    assert [(r.id, r.label, r.distance) for r in sorted(got)] == voices_answer(rows)


def test_a_chain_of_voices_comes_apart(spark):
    """Five voices, each within reach of the next, whose ends sit far from their middle."""
    at = np.radians([0, 50, 100, 150, 200])
    rows = [(i, f"f{i}", [float(np.cos(a)), float(np.sin(a))], 1.0) for i, a in enumerate(at)] + [(10 + i, f"f{i}", None, 1.0) for i in range(5)]
    got = {r.id: r.label for r in join_voices(as_voices(spark, rows), "id", "file", "v", "seconds").collect()}
    assert got == {i: label for i, label, _ in voices_answer(rows)} and [got[i] for i in range(5)] == [0, 1, 1, 1, 4]


def test_buckets_grow_with_the_vectors_and_miss_little(spark):
    assert tables_and_bits(1000, 0.6) == (1, 0)
    sizes = [tables_and_bits(n, 0.6)[0] / n for n in (10_000, 1_000_000, 100_000_000)]
    assert sizes[0] > sizes[1] > sizes[2]  # copies of a vector grow slower than vectors
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 16))
    turned = base + rng.standard_normal((150, 16)) * 0.5
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, turned]))]
    met = bucketed(spark.createDataFrame(rows, "id long, v array<double>"), 0.45, block=20)
    groups = met.groupBy("bucket", "lo", "hi").agg({"id": "collect_list"}).collect()
    assert max(len(g[3]) for g in groups) <= 80
    found = {(a, b) for g in groups for a in g[3] for b in g[3]}
    near = [i for i in range(150) if 1 - base[i] @ turned[i] / np.linalg.norm(base[i]) / np.linalg.norm(turned[i]) < 0.45]
    assert sum((i, 150 + i) in found for i in near) >= 0.97 * len(near) > 100


def test_look_alikes(spark):
    r = random.Random(5)
    base = [[r.getrandbits(63) for _ in range(3)] for _ in range(6)]
    rows = []
    for i in range(90):
        h = list(base[i % 6])
        if i % 3:
            for k in range(3):
                for _ in range(r.randrange(0, 9)):
                    h[k] ^= 1 << r.randrange(63)
        rows.append((i, r.choice(["a", "a", "b", None]), *h))
    rows += [(100, "a", None, 1, 1)]
    d = spark.createDataFrame(rows, "id long, key string, h0 long, h1 long, h2 long")
    hashes = ["h0", "h1", "h2"]
    first = {}
    for i, _, *h in rows[:-1]:
        first.setdefault(tuple(h), i)
    bits, pairs = {}, collections.Counter()
    for n, x in enumerate(rows[:-1]):
        for y in rows[n + 1:-1]:
            far = sorted(bin(a ^ b).count("1") for a, b in zip(x[2:], y[2:]))[1]
            if far <= 10 and y[0] != x[0] + 1 and (x[1] is None or y[1] is None or x[1] != y[1]):
                at = tuple(sorted((first[x[2:]], first[y[2:]])))
                bits[at], pairs[at] = far, pairs[at] + 1
    got = {(x.first, x.second): (x.bits, x.pairs) for x in look_alikes(d, "id", "key", "id", hashes, 10).collect()}
    assert got == {k: (bits[k], pairs[k]) for k in bits} and any(a == b for a, b in got)
    assert {r.id: r["class"] for r in look_classes(d, "id", hashes).collect()} == {r[0]: first[r[2:]] for r in rows[:-1]}


def test_many_copies_are_one_class(spark):
    d = spark.range(20_000).selectExpr("id", "id % 2 AS key", "7L AS h0", "8L AS h1", "9L AS h2")
    assert [tuple(r) for r in look_alikes(d, "id", "key", "id", ["h0", "h1", "h2"], 10).collect()] == [(0, 0, 0, 10_000 * 10_000 - 19_999)]


def test_spans_that_hang_together(spark):
    pick = random.Random(6)
    rows = [(pick.choice(["a", "b", None]), s := pick.randrange(400), s + pick.choice([-3, 0, 1, 2, 5, 30]), i) for i in range(150)] + [("a", None, 5, 900), ("a", 5, None, 901)]
    d = spark.createDataFrame(rows, "key string, s long, e long, id long")
    held = [r for r in rows if r[1] is not None and r[2] is not None and r[1] < r[2]]
    group = groups_of(len(held), lambda i, j: held[i][0] == held[j][0] and held[i][1] < held[j][2] and held[j][1] < held[i][2])
    own = collections.defaultdict(list)
    for r, g in zip(held, group):
        own[g].append(r[3])
    want = sorted((i, min(x)) for x in own.values() if len(x) > 1 for i in x)
    assert sorted(map(tuple, interval_components(d, ["key"], "s", "e", "id").collect())) == want


def staying_answer(index):
    length, back = [1] * len(index), [-1] * len(index)
    for k, x in enumerate(index):
        for j in range(k):
            if index[j] < x and length[j] + 1 > length[k]:
                length[k], back[k] = length[j] + 1, j
    keep, at = set(), length.index(max(length)) if index else -1
    while at >= 0:
        keep.add(at)
        at = back[at]
    return keep


def test_what_stays_in_order(spark):
    pick, rows, want = random.Random(7), [], set()
    for plan in range(40):
        order = list(range(pick.randint(1, 40)))
        for _ in range(pick.choice([0, 1, 3, 30])):
            a, b = sorted(pick.choices(range(len(order) + 1), k=2))
            order = order[:a] + order[b:] + order[a:b]
        rows += [(None if plan == 0 else plan, 3 * old, 2 * new) for new, old in enumerate(order)]
        want |= {(None if plan == 0 else plan, 2 * new) for new in staying_answer(order)}
    got = versions.staying(spark.createDataFrame(rows, "plan long, o long, n long"), ["plan"], "o", "n")
    assert {(r.plan, r.n) for r in got.where("__stays").collect()} == want and got.count() == len(rows)


def test_a_long_plan_is_a_few_runs(spark):
    """A plan of 200,000 items with two blocks swapped: no array holds more than its runs."""
    n = 200_000
    d = spark.range(n).selectExpr("1L AS plan", "id AS o", f"CASE WHEN id < 50000 THEN id + 100000 WHEN id < 150000 THEN id - 50000 ELSE id END AS n")
    got = versions.staying(d, ["plan"], "o", "n").groupBy("__stays").count().collect()
    assert {r["__stays"]: r["count"] for r in got} == {True: 150_000, False: 50_000}


def test_many_voices_are_joined_in_passes(spark, monkeypatch):
    """What hangs together is held against some voices, not copied into buckets, and nothing is missed (round three, F7)."""
    def none(*a):
        raise AssertionError("copied into buckets")
    monkeypatch.setattr(voices, "bucketed", none)
    rng = np.random.default_rng(8)
    rows = [(i, f"f{i // 2}" if i % 3 else f"lone{i}", (rng.standard_normal(4) + [1, 0, 0, 0]).tolist(), float(i % 5 + 1)) for i in range(400)]
    got = join_voices(as_voices(spark, rows), "id", "file", "v", "seconds", 10).collect()
    assert [(r.id, r.label, r.distance) for r in sorted(got)] == voices_answer(rows)


def test_voices_that_passes_leave_apart_meet_in_buckets(spark, monkeypatch):
    """Many small groups: passes over a few voices each would not end, and there are many prints."""
    monkeypatch.setattr(voices, "tables_and_bits", lambda *a: (1, 0))
    rng, used, bucketed_ = np.random.default_rng(10), [], voices.bucketed
    monkeypatch.setattr(voices, "bucketed", lambda *a: used.append(1) or bucketed_(*a))
    people = rng.standard_normal((90, 40))
    rows = [(i, f"f{i % 70}", (people[i % 90] + rng.standard_normal(40) * 0.3).tolist(), float(i % 4 + 1)) for i in range(200)]
    got = join_voices(as_voices(spark, rows), "id", "file", "v", "seconds", 2).collect()
    assert len(used) == 2 and [(r.id, r.label, r.distance) for r in sorted(got)] == voices_answer(rows)


def test_rounds_of_few_edges_are_not_dealt_over_all_partitions(spark, monkeypatch):
    """op9 and pipeline: on check_h every round wrote its few thousand edges to 211 files, again for each exchange."""
    from spanloom.operators import graph
    held, keep = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: held.append(keep(df)) or held[-1])
    monkeypatch.setattr(graph, "ROWS_A_TASK", 100, raising=False)
    names = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(150).selectExpr("id div 50 * 100 + id % 50 AS a", "id div 50 * 100 + id % 50 + 1 AS b")
        got = {r.node: r.component for r in graph.components(edges, "a", "b").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {100 * g + i: 100 * g for g in range(3) for i in range(51)}
    assert max(df.rdd.getNumPartitions() for df in held[1:]) <= 3
