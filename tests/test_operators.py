"""Operators against brute force on random fixtures, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import graph, intervals as iv, ordered as od, sequence as sq, topk, versions as ve


def spans(seed, n, reach=400, longest=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if r.random() < 0.6 else r.randrange(1, 5)
        s = r.randrange(reach)
        size = 0 if r.random() < 0.05 else r.randrange(1, longest) if r.random() < 0.9 else r.randrange(1, reach)
        out.append((key, i, s, s + size))
    return out


@pytest.mark.parametrize("levels,width", [(1, 7), (2, 3), (3, 1)])
def test_overlap_join(spark, levels, width):
    a, b = spans(1, 80), spans(2, 70)
    da = spark.createDataFrame(a, "key long, i long, s long, e long")
    db = spark.createDataFrame(b, "key long, j long, bs long, be long")
    got = sorted((r.i, r.j) for r in iv.overlap_join(da, db, ["key"], ("s", "e"), ("bs", "be"), width, levels).collect())
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert got == want


@pytest.mark.parametrize("edges,tol", [("[)", 0), ("()", 0), ("[]", 2), ("(]", 0)])
def test_point_join(spark, edges, tol):
    b = spans(3, 60)
    r = random.Random(4)
    p = [(r.randrange(5), i, r.randrange(420)) for i in range(80)]
    dp = spark.createDataFrame(p, "key long, i long, t long")
    db = spark.createDataFrame(b, "key long, j long, bs long, be long")
    got = sorted((x.i, x.j) for x in iv.point_join(dp, db, ["key"], "t", ("bs", "be"), 5, 2, edges, tol).collect())

    def holds(t, s, e):
        low = t >= s - tol if edges[0] == "[" else t > s - tol
        return low and (t <= e + tol if edges[1] == "]" else t < e + tol)
    assert got == sorted((x[1], y[1]) for x in p for y in b if x[0] == y[0] and holds(x[2], y[2], y[3]))


def test_coalesce_and_subtract(spark):
    a, b = [x for x in spans(5, 60) if x[3] > x[2]], [x for x in spans(6, 40) if x[3] > x[2]]
    da = spark.createDataFrame(a, "key long, i long, s long, e long")
    db = spark.createDataFrame(b, "key long, j long, bs long, be long")
    left = iv.subtract_spans(da, db, ["key"], ["i"], ("s", "e"), ("bs", "be"), 7, 50, "j").collect()
    got = sorted((r.i, t) for r in left for t in range(r.ps, r.pe))
    want = sorted((x[1], t) for x in a for t in range(x[2], x[3]) if not any(y[0] == x[0] and y[2] <= t < y[3] for y in b))
    assert got == want
    union = iv.coalesce_spans(db, ["key"], "bs", "be", "j", 50).collect()
    assert sorted({(r.key, t) for r in union for t in range(r.bs, r.be)}) == sorted({(y[0], t) for y in b for t in range(y[2], y[3])})


def test_asof_and_nearest(spark):
    r = random.Random(7)
    p = [(r.randrange(3), i, r.randrange(300)) for i in range(60)]
    m = [(r.randrange(3), r.randrange(300)) for _ in range(40)]
    dp = spark.createDataFrame(p, "key long, i long, t long")
    dm = spark.createDataFrame(m, "key long, x long")
    back = {x.i: x.found for x in iv.asof(dp, dm, ["key"], "t", "x", "i", 40).collect()}
    ahead = {x.i: x.found for x in iv.asof(dp, dm, ["key"], "t", "x", "i", 40, forward=True, tolerance=3).collect()}
    near = {x.i: x.found for x in iv.nearest(dp, dm, ["key"], "t", "x", "i", 9, 40).collect()}
    for k, i, t in p:
        marks = [x for kk, x in m if kk == k]
        assert back[i] == max((x for x in marks if x <= t), default=None)
        assert ahead[i] == min((x for x in marks if x >= t - 3), default=None)
        assert near[i] == min((x for x in marks if abs(x - t) <= 9), key=lambda x: (abs(x - t), -x), default=None)


def test_ordered_scan(spark):
    r = random.Random(8)
    rows = [(r.choice([0, 0, 0, 1, 2]), i, r.randrange(200), None if r.random() < 0.3 else r.randrange(50)) for i in range(120)]
    d = spark.createDataFrame(rows, "key long, i long, t long, v long")
    v = F.col("v")
    got = {x.i: x for x in od.ordered_scan(d, ["key"], ["t", "i"], od.by_width("t", 13), {
        "p": od.prev(v), "n": od.nxt(v), "rs": od.running_sum(v), "rx": od.running_max(v, False), "lv": od.last_value(v),
        "fv": od.first_value(v, False), "rn": od.row_number()}).collect()}
    for key in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == key), key=lambda x: (x[2], x[1]))
        for n, x in enumerate(mine):
            g, vs = got[x[1]], [y[3] for y in mine]
            assert g.p == (vs[n - 1] if n else None) and g.n == (vs[n + 1] if n + 1 < len(vs) else None)
            assert g.rs == sum(y for y in vs[:n + 1] if y is not None) and g.rn == n + 1
            assert g.rx == max((y for y in vs[:n] if y is not None), default=None)
            assert g.lv == next((y for y in reversed(vs[:n + 1]) if y is not None), None)
            assert g.fv == next((y for y in vs[n + 1:] if y is not None), None)


def test_exact_quantiles(spark):
    import numpy as np
    r = random.Random(9)
    rows = [(r.choice([0, 0, 0, 1]), float(r.randrange(40))) for _ in range(101)] + [(2, 5.0)]
    d = spark.createDataFrame(rows, "key long, v double")
    for x in od.exact_quantiles(d, ["key"], "v", {"a": 0.5, "b": 0.1, "c": 0.95}, 3.0).collect():
        mine = [v for k, v in rows if k == x.key]
        assert np.allclose([x.a, x.b, x.c], np.percentile(mine, [50, 10, 95]))


@pytest.mark.parametrize("seed", range(4))
def test_greedy_match(spark, seed):
    r = random.Random(seed)
    edges = list({(i, j): (i, j, r.randrange(0, 6)) for i, j in ((r.randrange(15), r.randrange(15)) for _ in range(60))}.values())
    want, ui, uj = [], set(), set()
    for i, j, w in sorted(edges, key=lambda x: (-x[2], x[0], x[1])):
        if w > 0 and i not in ui and j not in uj:
            want.append((i, j))
            ui.add(i)
            uj.add(j)
    d = spark.createDataFrame(edges, "i long, j long, w long")
    assert sorted((x.i, x.j) for x in graph.greedy_match(d, "i", "j", "w").collect()) == sorted(want)


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(r.randrange(50, 90), r.randrange(50, 90)) for _ in range(25)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: root(n) for n in parent}


def test_pick_in_order(spark):
    rows = [(k, i, i + 1 + (i * 7) % 4) for k in range(3) for i in range(1, 60, 1 + k)]
    d = spark.createDataFrame(rows, "key long, i long, r long")
    want = []
    for k in range(3):
        free = 0
        for kk, i, resume in rows:
            if kk == k and i >= free:
                want.append((k, i))
                free = resume
    assert sorted((x.key, x.i) for x in sq.pick_in_order(d, ["key"], "i", "r").collect()) == sorted(want)


def test_split_long(spark):
    r = random.Random(11)
    words, t = [], 0
    for n in range(60):
        t += r.choice([0, 0, 1, 2, 3])
        words.append((1, n, t, t + 2))
        t += 2

    def split(run):
        gaps = [(run[k + 1][2] - run[k][3], k) for k in range(len(run) - 1)]
        g, k = max(gaps, default=(0, -1))
        if run[-1][3] - run[0][2] > 12 and g >= 1:
            return split(run[:k + 1]) + split(run[k + 1:])
        return [run]
    want = sorted((w[1], part[0][1]) for part in split(words) for w in part)
    d = spark.createDataFrame(words, "key long, o long, s long, e long")
    assert sorted((x.o, x.part) for x in sq.split_long(d, ["key"], "o", "s", "e", 12, 1).collect()) == want


def test_sequence_diff(spark):
    cols = "plan long, pos long, what string, s long, e long"
    before = [(1, n, w, n, n + 1) for n, w in enumerate("abcda", 1)]
    after = [(1, 1, "b", 2, 3), (1, 2, "a", 1, 2), (1, 3, "c", 3, 9), (1, 4, "a", 5, 6), (1, 5, "x", 0, 1)]
    got = {(x.what, x.new_pos): x.status for x in ve.sequence_diff(spark.createDataFrame(before, cols), spark.createDataFrame(after, cols), ["plan"], "pos", "what", "s", "e").collect()}
    assert got == {("b", 1): "kept", ("a", 2): "moved", ("c", 3): "retrimmed", ("a", 4): "kept", ("x", 5): "added", ("d", None): "dropped"}


def test_knn_blocks(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(1)
    v, qs = rng.normal(size=(50, 4)), rng.normal(size=(7, 4))
    dv = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    dq = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(qs)], "q long, query array<double>")
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    got = {(x.q, x.place): x.id for x in topk.knn(dv, dq, "id", "v", "q", 3).collect()}
    cos = (qs / np.linalg.norm(qs, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    assert got == {(i, k + 1): int(j) for i in range(7) for k, j in enumerate(np.argsort(-cos[i])[:3])}
