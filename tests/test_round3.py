"""What the findings of the third round named, each beside brute force or its SQL on tables that show it."""

import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from oracle import compare
from spanloom.operators.names import missing_terms
from spanloom.operators.ordered import exact_quantiles
from spanloom.plans import load_all
from spanloom.plans.registry import ORACLE, QUERIES

load_all()


def beside_sql(spark, folder, key, **tables):
    """None when the query over these tables gives the rows of its SQL."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name, rows in tables.items():
        con.register("rows", rows)
        con.execute(f"COPY (SELECT * FROM rows) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return compare(spark, con, str(folder), key, QUERIES[key], ORACLE[key])


def events(rows):
    t = pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "ts", "value"])
    return t.assign(ts=(pd.Timestamp("2024-01-01") + pd.to_timedelta(t["ts"], unit="min")).astype("datetime64[us]"), value=t["value"].astype(float), props="{}")


def test_a_long_text_is_not_held_once_a_run(spark):
    """20,000 different runs in one text of 130 kB: 2.6 GB if each run came with the text."""
    text = " ".join(f"w{i:05d}" for i in range(20_000))
    terms = spark.createDataFrame([("00007 w00008",), ("w00007  w00008",), ("w19998 w19999",), ("9 w00010 w0",), ("w00001 w00003",)], "w string")
    assert {r.w for r in missing_terms(spark.createDataFrame([(text,)], "t string"), "t", terms, "w").collect()} == {"w00007  w00008", "w00001 w00003"}


def test_masked_bands_are_not_broadcast(spark):
    from spanloom.operators.similar import look_alikes
    looks = spark.range(50).selectExpr("id", "id % 3 AS key", "id * 77 AS h0", "id * 91 AS h1", "id AS h2")
    plan = look_alikes(looks, "id", "key", "id", ["h0", "h1", "h2"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [slot" in plan and "BroadcastHashJoin [slot" not in plan


def test_look_alikes_of_one_key_are_told(spark, tmp_path):
    pick = random.Random(4)
    base = [[pick.uniform(-1, 1) for _ in range(64)] for _ in range(4)]
    near = [[x + pick.uniform(-0.01, 0.01) for x in base[i % 4]] for i in range(20)]
    table = pd.DataFrame({"vec_id": range(24), "embedding": base + near, "label": [i % 4 // 2 for i in range(24)]})
    assert beside_sql(spark, tmp_path, "jn_hash_similar", embeddings=table) == (None, len(QUERIES["jn_hash_similar"](spark, str(tmp_path)).collect()))
    alike = QUERIES["jn_hash_similar"](spark, str(tmp_path)).where("row = 'alike'").collect()
    assert sum(r.pairs for r in alike) > 40 and any(r.apart == 0 for r in alike)


def test_a_purchase_of_no_length_belongs_to_the_run_it_falls_into(spark, tmp_path):
    rows = [(1, 1, "purchase", 0, 5), (2, 1, "purchase", 20, 0), (3, 1, "purchase", 200, 0), (4, 1, "purchase", 200, 1), (5, 1, "purchase", 205, 0), (6, 2, "purchase", 0, 1), (7, 2, "purchase", 0, 0),
            (8, 3, "purchase", 0, 2), (9, 3, "purchase", 5, None)]
    assert beside_sql(spark, tmp_path, "set_components", events=events(rows)) == (None, 8)


def test_a_middle_value_is_as_far_from_both_sides(spark, tmp_path):
    pick = random.Random(8)
    rows = [(3 * u + i, u, "view", 100 * i, pick.randrange(60_000) / 100) for u in range(400) for i in range(3)]
    diff, n = beside_sql(spark, tmp_path, "win_level_steps", events=events(rows))
    assert diff is None and n > 200
    d = spark.createDataFrame([(1, 0.1), (1, 0.7)], "k int, v double")
    assert exact_quantiles(d, ["k"], "v", {"q": 0.5}, 1.0).first().q == 0.1 * 0.5 + 0.7 * 0.5


def test_lines_become_objects_a_few_at_a_time():
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import types as T

    from spanloom.functions.text import by_slices
    words = pa.array([[{"text": "word", "start": float(i), "end": 1.0} for i in range(80)]] * 3000)
    run = by_slices(lambda t, w: [{"n": len(w), "t": t}], T.ArrayType(T.StructType([T.StructField("n", T.LongType()), T.StructField("t", T.StringType())]))).func
    tracemalloc.start()
    made = run(pa.array([str(i) for i in range(3000)]), words)
    assert tracemalloc.get_traced_memory()[1] < 10_000_000  # 3000 lines of 80 words as objects are over 60 MB
    tracemalloc.stop()
    assert made.to_pylist() == [[{"n": 80, "t": str(i)}] for i in range(3000)] and len(run(words.slice(0, 0), words.slice(0, 0))) == 0


def test_words_go_through_the_scan_without_what_is_not_wanted(spark):
    from spanloom.sources import tables
    assert tables.words(spark, "/root/testdata/sf0.001", only=()).columns == ["key", "ord", "s", "e", "prob"]


def test_rounds_see_runs_of_words_only(spark, monkeypatch):
    from spanloom.operators import sequence
    held = []
    keep = sequence.cut_lineage
    monkeypatch.setattr(sequence, "cut_lineage", lambda df: held.append(keep(df)) or held[-1])
    d = spark.range(600).selectExpr("'a' AS key", "id AS o", "id * 10 + id div 100 * 50 AS s", "id * 10 + id div 100 * 50 + 10 AS e")
    got = sequence.split_long(d, ["key"], "o", "s", "e", 1200, 50).groupBy("part").count().collect()
    assert sorted((r.part, r["count"]) for r in got) == [(100 * i, 100) for i in range(6)]
    assert max(x.count() for x in held[1:]) == 6


def test_lines_are_the_same_folded_and_walked(spark, monkeypatch):
    from spanloom.operators import sequence
    pick = random.Random(3)
    rows, at = [], 0
    for i in range(300):
        at += pick.randrange(4)
        rows.append(("long" if i < 250 else None, i, "x" * pick.choice([1, 2, 5, 9, 30]), at, at + pick.randrange(12)))
    d = spark.createDataFrame(rows, "key string, o long, t string, s long, e long")
    lines = lambda: sorted(map(tuple, sequence.caption_lines(d, ["key"], "o", "t", "s", "e", 20, 9).where("key is not null").collect()))
    folded = lines()
    assert len(folded) > 50 and sequence.caption_lines(d, ["key"], "o", "t", "s", "e", 20, 9).where("key is null").count() > 5
    monkeypatch.setattr(sequence, "SHORT", 100)
    assert lines() == folded


def test_the_first_text_is_lowered_once(spark):
    """not again for every stretch that is looked up in it; a word told twice and one shared as a whole give their runs once, in order."""
    from spanloom.functions.text import shared_runs
    rows = spark.createDataFrame([("The GARDEN gate", "gardener garden gate Gate xgatx")], "a string, b string").select(shared_runs(F.col("a"), F.col("b")).alias("r"))
    assert "Contains(lower(" not in rows._jdf.queryExecution().analyzed().toString()
    assert [list(r.r) for r in rows.collect()] == [["garden", "gate"]]


def test_middles_are_not_joined_to_weights_that_nothing_reads(spark):
    """without a whole length the parts were read, grouped and joined a second time."""
    from spanloom.operators.rollup import Rule, combine_scores
    parts = spark.createDataFrame([(1, "m", 1.0, 2), (1, "m", 3.0, 1), (1, "x", 5.0, 1), (2, "m", 4.0, 1)], "id long, name string, v double, w long")
    out = combine_scores(parts, ["id"], "name", "v", "w", {"m": Rule("median"), "x": Rule("max")})
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # the median's own scan
    assert sorted(tuple(r) for r in out.collect()) == [(1, "m", 1.0), (1, "x", 5.0), (2, "m", 4.0)]


def test_candidates_of_quotas_are_read_once(spark):
    """they were grouped and joined three times, again for what is returned; unread ones of one file still keep their places."""
    from spanloom.operators import topk
    cands = spark.range(12).selectExpr("id div 6 AS g", "id AS item", "IF(id % 6 < 3, 'a', concat('f', id)) AS file", "id % 6 < 3 AS unread")
    out = topk.with_quotas(cands, "g", "item", "file", "unread", [F.col("item")], places=4, per_file=1, kept=2)
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.g, r.item, r.place) for r in out.collect()) == [
        (0, 0, 4), (0, 3, 1), (0, 4, 2), (0, 5, 3), (1, 6, 4), (1, 9, 1), (1, 10, 2), (1, 11, 3)]


def test_words_that_differ_in_their_signs_share_their_runs(monkeypatch):
    """A run is merged once whatever stands around it, and outlasts a full memory while it is in use."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from spanloom.llm import bpe as module
    path = public_tokenizers.path("word_bpe_49k.json")
    library, bpe, merged = Tokenizer.from_file(path), module.Encoder(path), []
    keep = bpe.merged_many
    monkeypatch.setattr(bpe, "merged_many", lambda runs: merged.extend(runs) or keep(runs))
    texts = ["thing, Thing. (thing) thing's\x1cthing", "thing\xa0éß\u0085日本語 İstanbul thing", "<|endoftext|>thing<|endoftext|>", "", "Ⱥb 1２3 ẛ̣"]
    assert [np.frombuffer(x, np.uint32).tolist() for x in bpe.encode_many([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert merged.count(b"thing") == 1
    monkeypatch.setattr(module, "RUNS", 8)
    for i in range(9):
        bpe.encode_many([f"thing{',.;:!?()&'[i]} {'abcdefghi'[i]}{'xyzuvwopq'[i]}x {'ihgfedcba'[i]}yy".encode()])
    assert merged.count(b"thing") == 1


def test_counts_of_words_are_dealt_out_before_they_are_summed(spark, monkeypatch):
    """Those of one boundary come from several turns, so sums before the shuffle hold nearly all rows and grow with a task's input."""
    from spanloom.operators import sequence
    monkeypatch.setattr(sequence, "MEETING", 40, raising=False)
    tokens = spark.createDataFrame([("k", t, w) for t in range(8) for w in "abcde"], "key string, turn long, token string")
    got = sequence.vocabulary_overlap(tokens, ["key"], "turn")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 7" in plan  # 40 counts at six boundaries each, 40 a task
    assert {(r.turn, round(r.overlap, 9)) for r in got.collect()} == {(b, 1.0) for b in range(1, 8)}
