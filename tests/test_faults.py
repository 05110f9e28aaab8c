"""Rows that once were lost, merged or put in the wrong place."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import names, ordered, plans, rollup, topk
from spanloom.operators.hearing import _align
from spanloom.operators.ordered import by_width, ordered_scan
from spanloom.operators.sequence import _fold_runs


def test_ordered_scan_is_a_plain_window(spark):
    """Null keys and order values stay, and a key with nine tenths of its rows in one chunk width is many ranges."""
    pick = random.Random(2)
    rows = [(None if i % 11 == 0 else "hot" if i % 10 else f"k{i % 7}", None if i % 97 == 0 else pick.randrange(900), i, None if i % 5 == 0 else i % 13) for i in range(4000)]
    df = spark.createDataFrame(rows, "key string, at long, id long, v long")
    outs = {"before": ordered.prev(F.col("v")), "after": ordered.nxt(F.col("v")), "run": ordered.running_sum(F.col("v")), "most": ordered.running_max(F.col("v")),
            "latest": ordered.last_value(F.col("v")), "coming": ordered.first_value(F.col("v")), "n": ordered.row_number(), "all": ordered.total_sum(F.col("v"))}
    got = ordered_scan(df, ["key"], ["at", "id"], by_width("at", 1000), outs)
    w = W.partitionBy("key").orderBy("at", "id")
    up, down = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    want = df.select("*", F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after"), F.coalesce(F.sum("v").over(up), F.lit(0)).alias("run"),
                     F.max("v").over(up).alias("most"), F.last("v", True).over(up).alias("latest"), F.first("v", True).over(down).alias("coming"),
                     F.row_number().over(w).cast("long").alias("n"), F.sum("v").over(W.partitionBy("key")).alias("all"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    dealt = df.repartitionByRange(8, "key", "at", "id").groupBy("key", F.spark_partition_id().alias("p")).count()
    assert dealt.agg(F.max("count")).first()[0] < 1500


def test_a_scan_sees_a_rewritten_file(spark, tmp_path):
    """Two scans of one folder, rewritten between them by another writer; and no scan leaves anything cached."""
    def scan(value):
        pq.write_table(pa.table({"k": ["a"] * 4, "t": [1, 2, 3, 4], "v": [value] * 4}), tmp_path / "rows.parquet")
        d = spark.read.parquet(str(tmp_path))
        runs = ordered.islands(d, ["k"], ["t"], None, {"__p": ordered.prev(F.col("v"))}, F.col("__p").isNull() | (F.col("t") == 3))
        return sorted((r.s, r.grp) for r in ordered_scan(runs, ["k"], ["t"], None, {"s": ordered.running_sum(F.col("v"))}).collect())
    assert scan(1) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    assert scan(10) == [(10, 1), (20, 1), (30, 2), (40, 2)]
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_natural_key_reads_whole_numbers(spark):
    given = ["a" + "9" * 25, "a1" + "0" * 25, "a2", "a10", "a0010b", "a" + "9" * 24 + "8", "b"]
    rows = spark.createDataFrame([(x,) for x in given], "name string").select("name", topk.natural_key(F.col("name")).alias("k")).orderBy("k").collect()
    assert [r.name for r in rows] == ["a2", "a10", "a0010b", "a" + "9" * 24 + "8", "a" + "9" * 25, "a1" + "0" * 25, "b"]
    assert len({r.k for r in rows}) == len(given)


def test_missing_terms_look_into_whole_texts(spark):
    texts = spark.createDataFrame([("We flew to New York, by AT&T plane.",), ("C++ and wait... more",), (None,)], "t string")
    given = ["New York", "AT&T", "york, by", "New Yorker", "c++", "++", "...", "....", "wait... m", "lane", "(new", "plan", "ew yo", "", "zebra"]
    terms = spark.createDataFrame([(x,) for x in given], "w string")
    assert {r.w for r in names.missing_terms(texts, "t", terms, "w").collect()} == {"New Yorker", "....", "(new", "zebra"}


def test_fingerprint_tells_rows_apart(spark):
    rows = [(1, "a|b", "c"), (2, "a", "b|c"), (3, None, "c"), (4, "~", "c"), (5, "-", "c"), (6, "1:a", ""), (7, "", "1:a")]
    got = rollup.fingerprint(spark.createDataFrame(rows, "k long, x string, y string"), ["k"], ["x", "y"], "v1").collect()
    assert len({r.fingerprint for r in got}) == len(rows)


def test_long_plans_are_said_to_be(spark):
    items = lambda n: [("A" if i % 2 else "N", 10.0) for i in range(n)]
    df = spark.createDataFrame([(1, items(4)), (2, items(13))], "plan long, items array<struct<role: string, seconds: double>>")
    got = {r.plan: r for r in plans.subset_cutdowns(df, "plan", "items", 20, 30, ["A", "N"], "R").collect()}
    assert (got[1].too_many, got[1].shortest, got[1].longest) == (False, 20.0, 40.0) and got[2].too_many and got[2].shortest is None


def folded(runs, shortest):
    """Fold the shortest run, again and again, looking at all of them each time."""
    import pandas as pd
    out = _fold_runs(pd.DataFrame(runs, columns=["start", "end", "level"]), shortest)
    left = [list(r) for r in runs]
    while len(left) > 1 and min(b - a for a, b, _ in left) < shortest:
        i = min(range(len(left)), key=lambda k: (left[k][1] - left[k][0], k))
        size = [b - a for a, b, _ in left]
        j = i + 1 if i == 0 or (i + 1 < len(left) and size[i + 1] > size[i - 1]) else i - 1
        lo = min(i, j)
        left[lo:lo + 2] = [[left[lo][0], left[lo + 1][1], left[j][2]]]
        left = merged(left)
    return out, left


def merged(runs):
    out = []
    for a, b, level in runs:
        if out and out[-1][2] == level:
            out[-1][1] = b
        else:
            out.append([a, b, level])
    return out


def test_folding_takes_the_shortest_first():
    pick = random.Random(3)
    for _ in range(300):
        at, runs = 0, []
        for _ in range(pick.randint(1, 15)):
            size = pick.randint(1, 6)
            runs.append((at, at + size, pick.choice([x for x in "abc" if not runs or x != runs[-1][2]])))
            at += size
        got, want = folded(runs, 4)
        assert got == want


def test_shared_runs_by_looking_everywhere(spark):
    pick, rows, want = random.Random(4), [], {}
    for n in range(300):
        said, told = ("".join(pick.choice("ab ,見1A") for _ in range(pick.randint(0, 25))) for _ in range(2))
        rows.append((n, said, told))
        said, told = said.lower(), told.lower()
        shared = {}
        for i in range(len(told)):
            for j in range(i + 1, len(told) + 1):
                if told[i:j] in said and told[i:j].isalnum():
                    shared[i, j] = told[i:j]
        found = [t for (i, j), t in sorted(shared.items()) if not any(a <= i and j <= b and (a, b) != (i, j) for a, b in shared)]
        found = list(dict.fromkeys(f for f in found if len(f) >= (3 if f.isascii() else 2) and not f.isdigit()))
        want[n] = sorted((f for f in found if not any(f != o and f in o for o in found)), key=lambda f: -len(f))
    d = spark.createDataFrame(rows, "n long, a string, b string")
    assert {r.n: r.x for r in d.select("n", text.shared_runs(F.col("a"), F.col("b"), ("none",)).alias("x")).collect()} == want
    assert d.limit(1).select(text.shared_runs(F.lit(None).cast("string"), F.col("b"))).first()[0] is None


def test_times_out_of_order_are_given_up():
    word = lambda n, text, s, e, prob=0.9: {"ord": n, "text": text, "s": s, "e": e, "prob": prob}
    stored = [word(0, "one", 0, 100_000), word(1, "two", 100_000, 200_000), word(2, "three", 200_000, 300_000)]
    heard = [word(0, "one", 0, 110_000), word(1, "two", 400_000, 500_000), word(2, "three", 210_000, 310_000)]
    assert [r[3] for r in _align(stored, heard)] == ["retimed", "kept", "kept"]
    assert [r[3] for r in _align(stored, [word(0, "one", 0, 90_000), word(1, "two", 95_000, 190_000, 0.05)])] == ["retimed", "doubted", "apart"]
