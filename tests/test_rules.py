"""Hand-built cases: one that must be found, one that must not, NULLs, ties and empty keys."""

import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from spanloom.functions import predicates as pr, scalars as sc, text as tx
from spanloom.operators import intervals as iv, ordered as od, plans as pl, sequence as sq, transcript as tr, versions as ve
from spanloom.operators.rollup import Rule, combine_scores, energy_mean
from spanloom.sources import logs, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_flatten_analyses(spark, tmp_path):
    doc = {"asset_id": "a", "duration": 9.0, "silences": [{"start": 0, "end": 1}], "scenes": None,
           "transcript": {"segments": [{"start": 1, "end": 2, "text": "hi", "words": [{"start": 1, "end": 2, "text": "hi", "probability": None}]}]}}
    (tmp_path / "x.json").write_text(json.dumps(doc) + "\n" + json.dumps({"asset_id": "b"}))
    flat = logs.flatten_analyses(logs.read_analyses(spark, str(tmp_path)))
    assert rows(flat["spans"]) == [("a", "silence", 0.0, 1.0)]
    assert rows(flat["words"]) == [("a", 0, 0, 1.0, 2.0, "hi", None)]
    assert flat["shots"].count() == 0


def test_frame_records_from_a_file(spark, tmp_path):
    (tmp_path / "m.txt").write_text("junk=1\nframe:0 pts_time:0.5\nlevel=-3\nbad=nan\nlevel=-4\nframe:1 pts_time:1.5\nonly=-inf\n")
    lines = logs.read_lines(spark, str(tmp_path))
    got = logs.frame_records(lines, ["file"], ["block", "pos"], F.col("block")).select("rec", "seconds", "values").collect()
    assert sorted((r.rec, r.seconds, dict(r["values"])) for r in got) == [(1, 0.5, {"level": -4.0}), (2, 1.5, {})]


def test_unended_event_runs_to_the_end(spark):
    log = spark.createDataFrame([(1, 0, "on"), (1, 2, "on"), (1, 5, "off"), (1, 7, "on"), (2, 1, "off")], "key long, t long, kind string")
    fin = spark.createDataFrame([(1, 9), (2, 9)], "key long, fin long")
    assert rows(logs.pair_events(log, ["key"], ["t"], od.by_width("t", 4), "kind", "t", "on", "off", fin)) == [(1, 2, 5), (1, 7, 9)]


def test_kinds_and_licences(spark):
    d = spark.createDataFrame([(True, True, 0.95, 0.0, 0.0), (True, False, 0.95, 0.0, 0.0), (False, True, 0.2, 0.6, 0.0), (False, True, 0.95, 0.1, 0.0), (False, False, 0.95, 0.0, 0.0)],
                              "sp boolean, au boolean, q double, b double, z double")
    kinds = [r[0] for r in d.select(pr.clip_kind(F.col("sp"), F.col("au"), F.col("q"), F.col("b"), F.col("z"))).collect()]
    assert kinds == ["silence", "speech", "unusable", "silence", "ambient"]
    lic = spark.createDataFrame([("CC BY-NC-ND", False), ("CC BY-NC", True), ("CC BY", False), ("odd", True), (None, False)], "l string, p boolean")
    assert [r[0] for r in lic.select(pr.licence_problem(F.lit(True), F.col("l"), F.col("p"))).collect()] == [
        "does not allow commercial use or changes", None, None, "say the licence", "say the licence"]


def test_made_up(spark):
    seg = spark.createDataFrame([(1, "中文字幕——YK"), (2, "a a a a a a"), (3, "real words"), (4, "謝謝大家"), (5, "low low2"), (6, "x y")], "seg long, text string")
    w = [(2, i, 10 * i, 10 * i + 5, "a", 0.9) for i in range(6)]
    w += [(3, 0, 0, 5, "real", 0.9), (3, 1, 5, 9, "words", None), (5, 0, 0, 5, "low", 0.05), (5, 1, 5, 9, "low2", 0.05), (6, 0, 0, 0, "x", 0.01), (6, 1, 1, 4, "y", 0.9)]
    words = spark.createDataFrame(w, "seg long, ord long, s long, e long, text string, prob double")
    got = {r.seg: r.made_up for r in tr.made_up(seg, words, ["seg"], "ord", 4).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True}


def test_scores(spark):
    p = spark.createDataFrame([(1, "loudness", -120.0, 1.0), (1, "loudness", -20.0, 9.0), (1, "blur", None, 5.0), (1, "speech", 1.0, 2.0)], "id long, n string, v double, w double")
    whole = spark.createDataFrame([(1, 10.0)], "id long, whole double")
    assert rows(combine_scores(p, ["id"], "n", "v", "w", whole=whole)) == [(1, "loudness", -20.46), (1, "speech", 0.2)]
    typical = spark.createDataFrame([(1, "noise_floor", -60.0, 20.0), (1, "noise_floor", -30.0, 60.0)], "id long, n string, v double, w double")
    assert rows(combine_scores(typical, ["id"], "n", "v", "w")) == [(1, "noise_floor", -30.0)]
    assert spark.createDataFrame([(-120.0, 1.0)], "d double, w double").select(energy_mean(F.col("d"), F.col("w"))).first()[0] == -120.0
    assert Rule().decimals == 3


def test_text_helpers(spark):
    d = spark.createDataFrame([("Hello, big world!", [Row(start=0.0, end=1.0, text="hello"), Row(start=1.0, end=2.0, text="bigg"), Row(start=2.0, end=3.0, text="orld")])],
                              "t string, w array<struct<start:double,end:double,text:string>>")
    assert [x["text"] for x in d.select(tx.text_on_words(F.col("t"), F.col("w"))).first()[0]] == ["Hello, ", "big w", "orld!"]
    two = spark.createDataFrame([("我們去機構測試 abc 123", "機構測試 xabcx 123 這個")], "a string, b string")
    assert two.select(tx.shared_runs(F.col("a"), F.col("b"))).first()[0] == ["機構測試", "abc"]
    assert two.select(tx.shared_runs(F.lit("say hello there"), F.lit("well hello the"))).first()[0] == ["hello"]
    assert two.select(tx.normalized(F.lit("ＡＢ 測 試 buy now"))).first()[0] == "ab測試buy now"
    assert two.select(sc.tokens(F.lit("Go 機構測"))).first()[0] == ["go", "機構", "構測"]
    assert two.select(sc.file_label(F.lit("/x/13-機構測試4.mp4")), sc.file_label(F.lit("/x/IMG_1234.MOV"))).first()[:] == ("機構測試4", "")


def test_structure_and_moves(spark):
    beats = spark.createDataFrame([(1, 1, "hook"), (1, 2, "end"), (2, 1, "end"), (2, 2, "hook"), (3, 1, None), (4, 1, "odd")], "plan long, pos long, role string")
    got = rows(pl.structure_problems(beats, "plan", "pos", "role", {"hook": 0, "end": 1}, {"hook": 1}, ["end"], "hook"))
    assert got == [(2, "hook not first"), (2, "out of order"), (2, "wrong ending"), (3, "unsaid role"), (4, "foreign role")]
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, None)], "id long, parent long")
    moves = spark.createDataFrame([(1, 3), (2, 9), (3, 3)], "id long, target long")
    assert rows(pl.move_problems(moves, tree, "id", "parent")) == [(1, 3), (3, 3)]
    assert rows(pl.ancestors(tree, "id", "parent")) == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (9, 9, 0)]


def test_folders_in_a_ring(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (5, 6), (6, 5), (7, 5), (8, 8), (9, 7)], "id long, parent long")
    ends = {r.id: (r.root, r.depth) for r in pl.ancestors(tree, "id", "parent").collect()}
    assert ends == {1: (1, 0), 2: (1, 1), **{i: (None, None) for i in (5, 6, 7, 8, 9)}}
    moves = spark.createDataFrame([(5, 9), (9, 5), (8, 8), (6, 7), (1, 9), (1, 2), (7, 9)], "id long, target long")
    assert rows(pl.move_problems(moves, tree, "id", "parent")) == [(1, 2), (5, 9), (6, 7), (7, 9), (8, 8)]


def test_captions_and_footage(spark):
    cols = "key long, id long, s long, e long, text string"
    old = spark.createDataFrame([(1, 1, 0, 10, "one two"), (1, 2, 10, 20, "three"), (1, 3, 40, 50, "gone"), (1, 4, 60, 70, "same")], cols)
    new = spark.createDataFrame([(1, 5, 0, 5, "one"), (1, 6, 5, 10, "two"), (1, 7, 10, 20, "thre"), (1, 8, 61, 70, "same"), (1, 9, 80, 90, "more")], cols)
    got = ve.caption_changes(old, new, "key", "id", "s", "e", "text", F.regexp_replace("t", "[^a-z]", ""), 0, 5, 30)
    assert rows(got) == [(1, 1, 1, 1, 1, 1)]
    clips = "key long, id long, s long, e long, tl long, tle long"
    before = spark.createDataFrame([(1, 1, 0, 100, 0, 100), (1, 2, 200, 300, 100, 200), (1, 3, 500, 550, 200, 250)], clips)
    after = spark.createDataFrame([(1, 4, 0, 80, 0, 80), (1, 5, 700, 800, 100, 200)], clips)
    assert rows(ve.footage_changes(before, after, "key", "s", "e", ("tl", "tle"), "id", 1, 50, 1000)) == [(1, 1, 0, 1, 1, 20, 20)]


def test_follow_and_sections():
    import numpy as np
    import pandas as pd
    ats = np.arange(10, dtype=float)
    where = np.array([0, 0, 0.5, 0, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5])
    assert sq.follow(ats, where, 10.0, 0.1, 2.0, 1.5) == [(0.0, 0.0), (4.0, 0.5)]
    runs = pd.DataFrame([(0, 10, "quiet"), (10, 12, "full"), (12, 30, "quiet"), (30, 33, "middle")], columns=["start", "end", "level"])
    assert sq._fold_runs(runs, 8) == [[0, 33, "quiet"]]


def test_headroom_edges(spark):
    a = spark.createDataFrame([(1, 1, 10, 20, 100), (1, 2, 40, 50, 100)], "key long, id long, s long, e long, fin long")
    q = spark.createDataFrame([(1, 5, 10), (1, 20, 30)], "key long, qs long, qe long")
    got = iv.headroom(a, q, ["key"], ["id"], ("s", "e"), ("qs", "qe"), "fin", 16, 0).select("id", "safe_in", "safe_out")
    assert rows(got) == [(1, 5, 10), (2, 0, 0)]


def test_footage_of_both_versions_is_joined_once(spark, monkeypatch):
    """each side joined the versions anew, two times over; the pieces left of many spans are those of brute force."""
    import random
    calls, join = [], ve.overlap_join
    monkeypatch.setattr(ve, "overlap_join", lambda *a, **k: calls.append(1) or join(*a, **k))
    clips, pick = "key long, id long, s long, e long, tl long, tle long", random.Random(14)

    def version(first):
        out = []
        for key in (1, 2):
            for i in range(60):
                s = pick.randrange(4000)
                out.append((key, first + 100 * key + i, s, s + pick.randrange(1, 60), 0, 1))
        return out

    def union(rows_, key):
        out = []
        for s, e in sorted((r[2], r[3]) for r in rows_ if r[0] == key):
            if out and s - out[-1][1] <= 1:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return out

    def edges(mine, theirs):
        lens = []
        for s, e in mine:
            over = [(x, y) for x, y in theirs if min(e, y) - max(s, x) > 0]
            if any(min(e, y) - max(s, x) > 1 for x, y in over):
                at = s
                for x, y in [*over, (e, e)]:
                    lens += [x - at] if x - at > 1 else []
                    at = max(at, y)
        return lens
    a, b = version(0), version(1000)
    got = ve.footage_changes(spark.createDataFrame(a, clips), spark.createDataFrame(b, clips), "key", "s", "e", ("tl", "tle"), "id", 1, 50, 1000)
    got = {r.key: (r.edges, r.largest_edge, r.edge_us) for r in got.collect()}
    for key in (1, 2):
        lens = edges(union(a, key), union(b, key)) + edges(union(b, key), union(a, key))
        assert got[key] == (len(lens), max(lens), sum(lens)) and len(lens) > 10
    assert len(calls) == 2
