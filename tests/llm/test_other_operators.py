"""Near-duplicate dedup, BPE, suffix dedup, neighbours, shards and the pipeline, against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import near, shards, suffix
from spanloom.llm.ann import Centroids, nearest, split, unit
from spanloom.llm.bpe import Decoder, Encoder, decode, encode, lookahead, round_trip
from spanloom.llm.queries import QUERIES
from spanloom.session import shared_folder
from tests.llm.cases import lower, odd_rows, prose, table, words

HIGH = (1 << 63) - 1
PATH = public_tokenizers.path("word_bpe_49k.json")


def near_answer(rows, width, percent=80):
    sets = []
    for _, t, _ in rows:
        w = words(lower(t or ""))
        sets.append(frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    pairs = {(i, j) for own in holders.values() for i in own for j in own if i < j}
    for i, j in pairs:
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            at[root(i)] = root(j)
    rank = [HIGH if d is None else d for d, *_ in rows]
    least = collections.defaultdict(lambda: HIGH)
    for i in range(len(rows)):
        least[root(i)] = min(least[root(i)], rank[i])
    back = lambda x: None if x == HIGH else x
    return collections.Counter((d, len(s), back(least[root(i)]), d == back(least[root(i)])) for i, ((d, *_), s) in enumerate(zip(rows, sets)))


def family(base: str, n: int, start: int, seed: int) -> list[tuple]:
    """Copies of a text with one to twenty words replaced, so that some are linked only through others and some with none."""
    pick, out = random.Random(seed), []
    for i in range(n):
        w = base.split()
        for k in pick.sample(range(len(w)), pick.randint(1, 20)):
            w[k] = f"new{pick.randint(0, 10 ** 9)}"
        out.append((start + i, " ".join(w), "n"))
    return out


def test_near_duplicates(spark):
    rows = odd_rows() + family(prose(9, 150), 150, 1000, 1) + family(prose(10, 300), 30, 2000, 2)
    for width in (4, 5):
        got = near.near_duplicates(table(spark, rows), width=width).collect()
        assert collections.Counter(map(tuple, got)) == near_answer(rows, width)
    assert near.near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_in_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(near, "SPLIT", 8)
    monkeypatch.setattr(near, "BLOCK", 8)
    rows = family(prose(9, 150), 120, 1000, 3)
    assert collections.Counter(map(tuple, near.near_duplicates(table(spark, rows), width=4).collect())) == near_answer(rows, 4)


def test_one_of_each_judges_rows_by_their_own_text(spark):
    """Null ids and ids of two texts: near copies go though another row under their id stays."""
    rows = odd_rows() + [(None, prose(12, 90), "a"), (None, None, "a"), (None, "alone without an id", "a"), (26, prose(12, 90) + " end", "b")]
    rows.sort(key=lambda r: HIGH if r[0] is None else r[0])  # so that places, unlike ids unique, have the same order
    kept = collections.Counter(rows[i] for i, _, least, _ in near_answer([(i, t, s) for i, (_, t, s) in enumerate(rows)], 5) if rows[i][0] == rows[least][0])
    got = near.one_of_each(table(spark, rows))
    assert got.columns == table(spark, rows).columns
    assert collections.Counter((r.doc_id, r.text, r.source) for r in got.collect()) == kept
    assert kept[25, "one id", "f"] and not kept[25, "two texts " + prose(1, 120), "f"] and kept[None, "alone without an id", "a"]
    assert not kept[None, prose(1, 120), "a"] and not kept[None, prose(12, 90), "a"]


def test_near_duplicates_hold_no_large_bucket(spark, monkeypatch):
    """One bucket of 300 classes, of which 297 are a component: no task's group is larger than two blocks, and the rows of the last step follow the bucket's size."""
    monkeypatch.setattr(near, "SPLIT", 16)
    base = prose(11, 200).split()
    rows = [(i, " ".join(base + [f"end{i}"]), "n") for i in range(297)]
    for i in range(3):  # the words of most of the text, but under the threshold
        w = list(base)
        for k in range(i, len(w), 16):
            w[k] = f"other{i}x{k}"
        rows.append((1000 + i, " ".join(w), "n"))
    kind, seen = type(table(spark, [])), []
    plain = kind.mapInArrow

    def spied(df, fn, schema, *more):
        if "key" in df.columns:
            keys = [c for c in ("key", "lo", "hi", "block") if c in df.columns and (c != "block" or "lo" not in df.columns)]
            groups = [r["count"] for r in df.groupBy(*keys).count().collect()]
            of = df.groupBy("key").agg({"node": "approx_count_distinct"}).count()
            seen.append((fn.__qualname__, max(groups, default=0), sum(groups), of))
        return plain(df, fn, schema, *more)
    monkeypatch.setattr(kind, "mapInArrow", spied)
    got = near.near_duplicates(table(spark, rows), width=1, percent=95)
    assert collections.Counter(map(tuple, got.collect())) == near_answer(rows, 1, 95)
    assert any("_across" in name for name, *_ in seen)
    for name, most, all_, buckets in seen:
        assert most <= 4 * 16, (name, most)
        assert "_across" not in name or all_ <= buckets * (300 + 20 * 3), (name, all_, buckets)


def test_signatures_estimate_similarity():
    pick = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        x = pick.integers(0, 1 << 63, 2000, dtype=np.uint64)
        a, b = x[:int(1000 * (1 + share))][:1000], x[1000 - int(1000 * share):][:1000]
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        pa_, pb_ = near.packed(near.minima(a)), near.packed(near.minima(b))
        assert abs(near.estimate(int(near.agreeing(pa_[None], pb_[None])[0, 0])) - truth) < 0.2


def test_bpe(spark):
    library = Tokenizer.from_file(PATH)
    rows = odd_rows() + [(500, "x" + "thinexhilarating" * 2000, "a"), (501, "日本語" * 3000, "a"), (502, "&" * 3001, "a")]
    got = decode(encode(table(spark, rows), PATH), PATH).collect()
    want = collections.Counter()
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert collections.Counter((r.id, tuple(r.ids), r.text) for r in got) == want
    assert collections.Counter((r.id, tuple(r.ids), r.text) for r in round_trip(table(spark, rows), PATH).collect()) == want
    assert encode(table(spark, []), PATH).count() == 0 and round_trip(table(spark, []), PATH).count() == 0


def test_bpe_query_is_the_library(spark):
    """Every row of the query on the smallest tables, digests included, beside the library."""
    library, want = Tokenizer.from_file(PATH), {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op3_bpe"](spark, "/root/testdata/sf0.001").collect()} == want


def test_runs_merged_together_are_merged_alike():
    bpe, pick = Encoder(PATH), random.Random(8)
    runs = list({"".join(pick.choice("thinexaélrs") for _ in range(pick.randint(1, 40))).encode() for _ in range(400)})
    alone = []
    for r in runs:
        symbols = [bpe.letters[b] for b in r]
        symbols[-1] += bpe.suffix
        alone.append(np.array([bpe.vocab[s] for s in bpe.merged(symbols)], np.uint32).tobytes())
    assert bpe.merged_many(runs) == alone


def test_suffix_query_is_brute_force(spark):
    docs = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    seen, want = {}, {}
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if seen.setdefault(t[i:i + 50], d) < d:
                gone[i:i + 50] = b"\x01" * 50
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        want[d] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op5_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()} == want


def test_near_query_is_brute_force(spark):
    rows = [(r.doc_id, r.text, None) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = QUERIES["op9_near_dedup"](spark, "/root/testdata/sf0.001").select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert collections.Counter(map(tuple, got)) == near_answer(rows, 4)


def test_ann_query_finds_the_nearest(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    found, right = collections.defaultdict(list), 0
    for r in QUERIES["op6_ann"](spark, "/root/testdata/sf0.001").collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in ids.tolist() if i % 50 == 0}
    for q_, own in found.items():
        cos = v @ v[ids == q_][0]
        want = sorted((-c, i) for c, i in zip(cos.tolist(), ids.tolist()) if i != q_)[:5]
        right += len({i for _, i in want} & {i for _, i, _ in own})
        assert [r for r, *_ in sorted(own)] == [1, 2, 3, 4, 5] and all(abs(s - cos[ids == i][0]) < 1e-9 for _, i, s in own)
    assert right >= 0.9 * 5 * len(found)


def test_quality_query_holds_out_a_fifth(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op8_quality"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and labels.get(r.doc_id) in (0, 1)]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held) > 20


def test_bpe_streams_in_one_window():
    library, bpe, pick = Tokenizer.from_file(PATH), Encoder(PATH), random.Random(4)
    for letters in ("ab", "aeinrst", "thinandexhilarating"):
        run = "".join(pick.choice(letters) for _ in range(20_000))
        taken = 0

        def source():
            nonlocal taken
            for b in run.encode():
                taken += 1
                yield b
        ids, held = [], 0
        for token in bpe.stream(source()):
            ids.append(token)
            held = max(held, taken - sum(len(bpe_text[i]) for i in ids[-1:]))
        assert ids == library.encode(run, add_special_tokens=False).ids
    assert all(bpe.ranks.get(bpe_parts.get(s, ("", "")), -1) < r for (u, v), r in bpe.ranks.items() for s in (u, v) if s in bpe_parts)


bpe_parts = {u + v: (u, v) for u, v in Encoder(PATH).ranks}
bpe_text = {i: s for s, i in Encoder(PATH).vocab.items()}


def test_lookahead_is_enough():
    """Whatever follows a prefix, its tokens that end ``lookahead`` before its end stay."""
    pick, stable = random.Random(5), 0
    for _ in range(200):
        letters = "abc"
        merges, known = [], list(letters)
        while len(merges) < 8:
            u, v = pick.choice(known), pick.choice(known)
            if (u, v) not in merges and len(u + v) < 7 and u + v not in known:
                merges.append((u, v))
                known.append(u + v)
        look = lookahead(merges)
        bpe = Encoder.__new__(Encoder)
        bpe.ranks = {m: i for i, m in enumerate(merges)}
        ends = lambda tokens: set(np.cumsum([len(t) for t in tokens]).tolist())
        prefix = [pick.choice(letters) for _ in range(40)]
        outs = [{e for e in ends(bpe.merged(prefix + [pick.choice(letters) for _ in range(n)])) if e <= 40 - look} for n in (1, 2, 3, 5, 8, 13, 30)]
        assert all(o == outs[0] for o in outs)
        stable += len(outs[0])
    assert stable > 200


def test_decoder_keeps_cut_characters():
    bpe, text = Encoder(PATH), Decoder(PATH, pieces=False)
    ids = np.frombuffer(b"".join(bpe.encode("日本語 don't éß".encode())), np.uint32)
    from spanloom.llm import bpe as module
    before, module.DECODED = module.DECODED, 1
    try:
        assert "".join(text.decode(ids)) == "日本語 don 't éß "
    finally:
        module.DECODED = before


def repeat_answer(rows, length):
    rank = lambda d: HIGH if d is None else d
    first: dict[bytes, int] = {}
    for d, t, _ in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first[b[i:i + length]] = min(rank(d), first.get(b[i:i + length], HIGH))
    out = collections.Counter()
    for d, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < rank(d):
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)] += 1
    return out


def test_suffix_dedup(spark, monkeypatch):
    rows = odd_rows() + [(600, "\0" * 100 + prose(2, 30), "a"), (601, "\0" * 60, "b"), (602, prose(1, 120)[7:300] + prose(2, 30)[:49], "a")]
    for length in (50, 30):
        got = suffix.without_repeats(table(spark, rows), length=length).collect()
        assert collections.Counter((*r[:4], bytes(r.kept)) for r in got) == repeat_answer(rows, length)
    assert suffix.without_repeats(table(spark, [])).count() == 0


def test_run_index_finds_neighbours():
    pick = random.Random(6)
    for text in ("banana", "aaaaaaaaab", "".join(pick.choice("ab") for _ in range(300)), ("".join(pick.choice("abc") for _ in range(40)) + "#") * 6):
        t = np.frombuffer(text.encode(), np.uint8).astype(np.uint16) + 1
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix.suffix_array(t).tolist() == order
        index = suffix.RunIndex(t)
        neighbour, match = index.stream()
        runs = 1 + sum(a != b for a, b in zip(index.letters, index.letters[1:]))
        assert index.lengths.sum() == len(text) and runs <= len(index.letters) <= runs + 2
        for row, i in enumerate(order):
            j = order[row - 1] if row else -1
            common = next((k for k in range(len(text)) if max(i, j) + k >= len(text) or text[i + k] != text[j + k]), 0) if row else 0
            assert (neighbour[i], match[i]) == (j, common)


def test_small_parts_and_chunks_agree(monkeypatch):
    rows = pa.table({"id": [d for d, t, _ in odd_rows() if d], "text": pa.array([(t or "").encode() for d, t, _ in odd_rows() if d], pa.binary())})
    whole = suffix.Part(rows, 50)
    monkeypatch.setattr(suffix, "STEP", 700)
    cut = suffix.Part(rows, 50)
    assert whole.counts.sum() == cut.counts.sum() and set(whole.anchors) == set(cut.anchors)


def vectors(spark, n=1500):
    pick = np.random.default_rng(3)
    x = pick.standard_normal((n, 12)).astype(np.float32)
    x[100:500] = x[100]  # a very common vector
    rows = [(i, v.tolist(), "x", 0.0) for i, v in enumerate(x)]
    rows += [(2000, None, "x", 0.0), (2050, [0.0] * 12, "x", 0.0), (2100, [float("nan")] + [1.0] * 11, "x", 0.0), (2150, [float("inf")] * 12, "x", 0.0),
             (2200, [None] + [1.0] * 11, "x", 0.0), (2250, [], "x", 0.0), (2300, [1.0] * 5, "x", 0.0), (None, [1.0] * 12, "x", 0.0), (50, x[50].tolist(), "x", 0.0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string, score double"), x


def test_nearest(spark):
    df, x = vectors(spark)
    got = collections.defaultdict(list)
    for r in nearest(df, df.where("vec_id % 50 = 0"), piece=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    u = unit(x.astype(np.float64))
    assert sorted(got) == list(range(0, 1500, 50))
    hits = 0
    for q, found in got.items():
        s = u @ u[q]
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len(set(want) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(s[v] - c) < 1e-12 for _, v, c in found)
        assert [(-c, v) for _, v, c in found] == sorted((-c, v) for _, v, c in found)
    assert hits >= 0.9 * 5 * len(got)
    assert [v for _, v, _ in got[100]] == [101, 102, 103, 104, 105] and [v for _, v, _ in got[150]] == [100, 101, 102, 103, 104]
    few = df.where("vec_id < 4")
    assert nearest(few, few.where("vec_id = 0")).count() == 3 and nearest(df.limit(0), df.limit(0)).count() == 0


def test_graph_walk_finds_near_centroids():
    pick = np.random.default_rng(2)
    points = unit(pick.standard_normal((4000, 16)))
    means = split(points, 32, pick)
    graph, q = Centroids.of(means), points[:200]
    ids, far = graph.search(q, 32)
    d = np.sqrt(((q[:, None] - means[None]) ** 2).sum(axis=2))
    assert (np.diff(far, axis=1) >= 0).all() and np.allclose(np.take_along_axis(d, ids, axis=1), far)
    assert np.mean([len(set(i) & set(np.argsort(e)[:32])) / 32 for i, e in zip(ids, d)]) > 0.95


def test_slots_permute():
    for n in (1, 2, 3, 5, 100, 4096, 10_007):
        to = shards.slots(np.arange(n), n, 5)
        assert sorted(to.tolist()) == list(range(n))
    assert shards.slots(np.arange(1000), 1000, 5).tolist() != shards.slots(np.arange(1000), 1000, 6).tolist()


def test_shards(spark):
    library, rows = Tokenizer.from_file(PATH), odd_rows()
    folder = shared_folder(spark, "shards-test")
    listed = shards.write_training_order(table(spark, rows), folder, ids="text", tokenizer=PATH, length=64, shard_rows=100).orderBy("first").collect()
    want = collections.Counter()
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.update((shards.NO_ID if d is None else d, k // 64, tuple(ids[k:k + 64])) for k in range(0, len(ids), 64))
    n = sum(want.values())
    assert [(r.shard, r.first, r.rows) for r in listed] == [(k, 100 * k, min(100, n - 100 * k)) for k in range(-(-n // 100))]
    read = shards.read_slots(folder, 0, n + 5, 64, shard_rows=100)
    assert collections.Counter((int(r["id"]), int(r["seq"]), tuple(r["ids"][:r["n"]].tolist())) for r in read) == want
    assert (shards.read_slots(folder, 150, 120, 64, shard_rows=100) == read[150:270]).all()
    back = {r.slot: r for r in shards.read_shards(spark, folder, 64, shard_rows=100).collect()}
    assert sorted(back) == list(range(n)) and all((back[i].id if back[i].id is not None else shards.NO_ID, back[i].seq) == (r["id"], r["seq"]) for i, r in enumerate(read))
    ids = spark.createDataFrame([(1, [1, 2, 3], "a"), (2, None, "b"), (3, [], "c"), (3, [70_000], "c")], "doc_id long, ids array<int>, records string")
    folder = shared_folder(spark, "shards-test")
    assert shards.write_training_order(ids, folder, length=2, width=4).collect()[0].rows == 3
    assert sorted((int(r["id"]), r["ids"].tolist()) for r in shards.read_slots(folder, 0, 9, 2, 4)) == [(1, [1, 2]), (1, [3, 0]), (3, [70_000, 0])]
    assert shards.write_training_order(ids.limit(0), shared_folder(spark, "shards-test")).count() == 0


def test_pipeline_keeps_to_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    good = corpus_pipeline.good_only(spark, docs, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(labels.get(r.doc_id) == 1 for r in good) >= 0.97 * sum(q == 1 for q in labels.values())
    rows = [(r.doc_id, r.text, r.source) for r in good]
    best = {}
    for d, t, s in rows:
        k = "".join(words(t))
        best[k] = min(best.get(k, (1, 0)), (-len(t or ""), d))
    alone = [(d, t, s) for d, t, s in rows if best["".join(words(t))][1] == d]
    single = {d for d, _, c, kept in near_answer(alone, 5) if kept}
    staged = docs.where(docs.doc_id.isin([d for d, *_ in rows]))
    exact = corpus_pipeline.without_copies(spark, staged, sf)
    assert {r.doc_id for r in exact.collect()} == {d for d, *_ in alone}
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, exact, sf).collect()} == single
    out = corpus_pipeline.run(spark, sf).collect()
    library, text = Tokenizer.from_file(PATH), {d: t for d, t, _ in rows}
    assert {r.doc_id for r in out} <= single and max(collections.Counter(r.doc_id for r in out).values()) <= 3
    assert all(r.n_tokens == len(library.encode(text[r.doc_id] or "", add_special_tokens=False).ids) for r in out)
