"""Keyed tables, caption files and streams over restarts, against plain answers; and the entry without an optional package."""

from __future__ import annotations

import collections
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanloom.plans import load_all
from spanloom.plans.registry import QUERIES
from spanloom.sources import logs, sinks
from spanloom.sources.keyed import KeyedTable
from spanloom.streaming import live

ROOT = Path(__file__).resolve().parents[1]
MINUTE = 60_000_000


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def held(spark, rows):
    return spark.createDataFrame(rows, "key long, v long, x string")


def files_under(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_keyed_table_rewrites_what_it_touches(spark, tmp_path):
    pick, table, want = random.Random(1), KeyedTable(spark, f"{tmp_path}/t", ["key"], ["v"], buckets=32), {}
    for epoch, batch in enumerate([[(k, 1, f"a{k}") for k in range(300)] + [(None, 1, "none")], [(k, pick.choice([0, 2]), "b") for k in range(5, 15)], [(999, 3, "new"), (None, 5, "later")]]):
        before = dict(table._manifest(table.latest_version())["buckets"]) if epoch else {}
        table.merge(held(spark, batch), epoch)
        for k, v, x in batch:
            if k not in want or v > want[k][0]:
                want[k] = (v, x)
        assert rows_of(table.read()) == sorted(((k, *r) for k, r in want.items()), key=str)
        after = table._manifest(table.latest_version())["buckets"]
        assert epoch == 0 or sum(after[b] != before.get(b) for b in after) <= len(batch)
    known, number = files_under(tmp_path), table.latest_version()
    assert table.merge(held(spark, [(1, 9, "again")]), 2) == number == table.merge(held(spark, []), 3)  # seen before, and empty
    assert files_under(tmp_path) == known
    assert rows_of(table.read(number - 1)) != rows_of(table.read(number))
    named = {f for n in (number - 1, number) for f in table._manifest(n)["buckets"].values()}
    assert {os.path.dirname(f) for f in known} == {f"t/data/{f}" for f in named}  # nothing older is left


def test_a_reader_keeps_its_version_during_a_commit(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["key"], ["v"], buckets=4)
    table.merge(held(spark, [(k, 1, "a") for k in range(20)]))
    reader = table.read()
    table.merge(held(spark, [(k, 2, "b") for k in range(20)]))
    assert {r.x for r in reader.collect()} == {"a"} and {r.x for r in table.read().collect()} == {"b"}


def test_two_writers_of_one_version(spark, tmp_path):
    a = KeyedTable(spark, str(tmp_path), ["key"], ["v"])
    a.merge(held(spark, [(1, 1, "a")]))
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        a._commit(0, a._manifest(0))
    assert rows_of(a.read()) == [(1, 1, "a")]
    with pytest.raises(ValueError):
        KeyedTable(spark, f"{tmp_path}/none", ["key"], ["v"]).read()


def came(spark, parts):
    """Rows (minute, part) as events with a key, a time and when they came."""
    rows = [("k", at, part) for part, own in enumerate(parts) for at in own]
    return spark.createDataFrame(rows, "key string, at long, come long").withColumn("ts", F.timestamp_micros(F.col("at") * MINUTE)).withColumn("db", F.lit(-20.0))


def test_late_rows_are_dropped_and_a_restart_goes_on(spark):
    parts = [[0, 10, 70], [65, 5, 200], [30, 80, 130], [10, 205, 400], [500]]
    got = live.replayed(came(spark, parts), "come", len(parts), lambda ev, out: live.run(live.levels(ev, "key", "ts", "db", "10 minutes", "1 hour"), out))
    want, mark = collections.Counter(), 0
    for own in parts:
        want.update(at // 60 for at in own if (at // 60 + 1) * 60 > mark)
        mark = max(mark, max(own) - 10)
    assert {(r.start.hour, r.n) for r in got.collect()} == {(w, n) for w, n in want.items() if (w + 1) * 60 <= mark}
    assert want[0] == 2 and want[1] == 2  # 5, 30 and 10 came too late for the first hour, 80 for the second


def test_sittings_grow_over_restarts(spark):
    parts = [[0, 50], [20, 100], [75, 300], [310], [2000]]
    got = live.replayed(came(spark, parts), "come", len(parts), lambda ev, out: live.run(live.sessions(ev, "key", "ts", "5 hours", "30 minutes"), out))
    assert sorted((int(r.start.timestamp()) // 60, int(r.end.timestamp()) // 60, r.n) for r in got.collect()) == [(0, 130, 5), (300, 340, 2)]


def test_first_seen_over_restarts(spark):
    got = live.replayed(came(spark, [[0, 1], [2], [3]]), "come", 3, lambda ev, out: live.run(live.first_seen(ev, ["key"], "ts", "1 day"), out))
    assert rows_of(got) == [("k",)]


def test_quiet_keys_over_restarts(spark):
    """A key is reported once its timer ran out in a later run; one that spoke again in time is not."""
    rows = [(1, 1, False, 0), (2, 1, True, 0), (3, 1, False, 0), (3, 40, False, 1), (9, 100, False, 1), (9, 400, False, 2)]
    beats = spark.createDataFrame(rows, "key long, at long, gone boolean, come long").withColumn("ts", F.timestamp_micros(F.col("at") * MINUTE)).withColumn("us", F.col("at") * MINUTE)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    with live.rocksdb_state(spark):
        got = live.replayed(beats, "come", 2, lambda ev, out: live.run(live.abandoned(ev, "key", "ts", "1 minute", 30 * 60_000, 90 * 60_000), out))
    assert spark.conf.get(setting, None) == before
    assert {(r.key, r.last_us // MINUTE, r.why) for r in got.collect()} == {(1, 1, "silent"), (2, 1, "worker gone"), (3, 40, "silent")}


def test_upserts_are_applied_once(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["key"], ["come"], buckets=4)
    rows = came(spark, [[1], [2], [3]])
    got = live.replayed(rows, "come", 3, lambda ev, out: live.upsert_stream(ev, table, out))
    assert [(r.key, r.at) for r in got.collect()] == [("k", 3)] and table.latest_version() == 2
    folder = f"{tmp_path}/in"
    rows.limit(0).write.parquet(folder)
    empty = KeyedTable(spark, f"{tmp_path}/e", ["key"], ["come"])
    assert live.upsert_stream(live.file_stream(spark, folder, "*.parquet", rows.schema), empty, f"{tmp_path}/s").count() == 0


def test_captions_read_back(spark, tmp_path):
    cues = spark.createDataFrame([(k, n, n * 1_000_000, n * 1_000_000 + 999_500, t) for k in (1, 2) for n, t in enumerate(["one", "two\n\nlines", "three\n"], 1)], "key long, n long, s long, e long, text string")
    sinks.write_srt(sinks.srt_blocks(cues), f"{tmp_path}/srt", "key")
    got = {(r.key, r.n): r.block for r in sinks.read_srt(spark, f"{tmp_path}/srt", "key", "long").collect()}
    assert len(got) == 6 and got[1, 1] == "1\n00:00:01,000 --> 00:00:02,000\none\n" and got[2, 2].endswith("\ntwo\nlines\n") and got[1, 3].endswith("\nthree\n")


def test_absent_and_null_parts_are_kept_apart(spark):
    texts = [('{"asset_id":"a","silences":[]}',), ('{"asset_id":"b","silences":null}',), ('{"asset_id":"c"}',), ('{"asset_id":"d","silences":[{"start":1,"end":2}]}',), ("no json",), (None,)]
    df = spark.createDataFrame(texts, "t string")
    assert {(r.key, r.state) for r in logs.part_states(df, "t", ["silences"]).collect()} == {("a", "empty"), ("b", "null"), ("c", "absent"), ("d", "filled")}
    assert rows_of(logs.flatten_analyses(logs.parse_analyses(df, "t"))["spans"]) == [("d", "silence", 1.0, 2.0)]


def test_a_moved_shot_gives_other_ids(spark):
    from spanloom.operators.timeline import build_timeline
    d = spark.createDataFrame

    def built(cut):
        clips = build_timeline(
            d([("f", 0, 1000, True)], "key string, begin long, fin long, has_audio boolean"), d([("f", 1, 100, 200, "hello", False), ("f", 2, 300, 400, "made up", True)], "key string, id long, s long, e long, text string, made_up boolean"),
            d([("f", 200, 290)], "key string, qs long, qe long"), d([("f", cut)], "key string, cut long"), d([("f", 500, 560)], "key string, ds long, de long"),
            d([("f", 640, 700), ("f", 650, 980)], "key string, fs long, fe long"), d([("f", "S1", 90, 210)], "key string, speaker string, ts long, te long"), 50, 64, 64, "v")
        return sorted(map(tuple, clips.select("s", "e", "kind", "speaker", "frozen", "id").collect()))
    one, two = built(600), built(610)
    assert [c[:5] for c in one] == [(0, 100, "ambient", None, 0.0), (100, 200, "speech", "S1", 0.0), (200, 300, "silence", None, 0.0), (300, 400, "ambient", None, 0.0),
                                    (400, 600, "ambient", None, 0.0), (600, 1000, "unusable", None, 0.85)]
    assert one == built(600) and not {c[5] for c in one} & {c[5] for c in two}


def test_entry_stands_without_an_optional_package():
    load_all()
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout.split()[0]) == len(QUERIES) > 190, out.stderr[-500:]


def test_caption_folders_are_listed_by_few_tasks(spark, tmp_path):
    """a task for each key's folder listed it, and Spark's writer made each file; odd, null and long keys come back whole."""
    keys = ["a/b=c", "d e", "é%", None, *(f"k{i}" for i in range(60))]
    rows = [(k, n, f"{n}\n{k}") for k in keys for n in range(1, 300 if k == "k7" else 4)]
    path = f"{tmp_path}/srt"
    sinks.write_srt(spark.createDataFrame(rows, "key string, n long, block string"), path, "key")
    spark.sparkContext.setJobGroup("listing", "listing")
    read = sinks.read_srt(spark, path, "key", "string")
    jobs = spark.sparkContext.statusTracker()
    tasks = [jobs.getStageInfo(s).numTasks for j in jobs.getJobIdsForGroup("listing") for s in jobs.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= sinks.LISTERS
    assert {(r.key, r.n, r.block) for r in read.collect()} == {(k, n, b + "\n") for k, n, b in rows}
    assert sorted(p.name for p in (tmp_path / "srt").iterdir() if not p.name.startswith("key=")) == ["_SUCCESS"]
