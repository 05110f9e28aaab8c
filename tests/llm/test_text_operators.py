"""Exact dedup, line dedup, chat formatting, mixing and quality on rows of every odd kind, against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import mixing
from spanloom.llm.chat import escaped, format_chats, parsed, unescaped
from spanloom.llm.exact import drop_copies, exact_groups
from spanloom.llm.lines import line_bitmaps, without_repeated_lines
from spanloom.llm.mixing import mix, repeated, targets
from spanloom.llm.quality import held_out, keep_good, learn, score
from tests.llm.cases import SPACE, lower, odd_rows, prose, table, words

HIGH = 1 << 62


def bare(text):
    return "".join(c for c in text or "" if c not in SPACE)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    rows = odd_rows()
    digest = (lambda c: (F.length(c) % 3).cast("string")) if weak else None  # noqa: E731  a digest that many contents share
    got = exact_groups(table(spark, rows), **({"digest": digest} if weak else {}), salts=4).collect()
    groups = collections.defaultdict(list)
    for d, t, _ in rows:
        groups[bare(t)].append((-len(t or ""), d is None, d if d is not None else HIGH, d))
    want = collections.Counter((d, min(groups[bare(t)])[3], len(groups[bare(t)]), d == min(groups[bare(t)])[3]) for d, t, _ in rows)
    assert collections.Counter((r.id, r.keep_id, r.group_size, r.kept) for r in got) == want
    assert exact_groups(table(spark, [])).count() == 0


def test_drop_copies_keeps_one_text_each(spark):
    kept = drop_copies(table(spark, odd_rows())).collect()
    assert {bare(r.text) for r in kept} == {bare(t) for _, t, _ in odd_rows()}
    texts = [bare(r.text) for r in kept if r.doc_id != 24]
    assert len(texts) == len(set(texts)) and sum(r.doc_id == 24 for r in kept) == 2


def line_answer(rows):
    def key(line):
        k = lower(line.strip(SPACE))
        return k if len(k) >= 20 else None
    low = -HIGH
    docs = collections.defaultdict(set)
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            if key(line) is not None:
                docs[key(line)].add(low if d is None else d)
    out = collections.Counter()
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [line for line in lines if not (key(line) is not None and len(docs[key(line)]) >= 3 and (low if d is None else d) != max(docs[key(line)]))]
        out[d, len(lines), len(lines) - len(keep), "\n".join(keep)] += 1
    return out


def test_line_dedup(spark):
    rows = odd_rows() + [(i, "the very frequent line of this table\nand its own line, number %d of many" % i, "z") for i in range(200, 500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("16", before):  # small batches cut groups at their ends
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = without_repeated_lines(table(spark, rows)).collect()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert collections.Counter(map(tuple, got)) == line_answer(rows)
    assert line_bitmaps(table(spark, [])).count() == 0


def test_texts_without_an_id_are_told_apart(spark):
    """Two texts under the null id whose checksums agree in 31 bits keep their own rows and their own lines."""
    line, seen, pair = "a line of the table that stands in several rows", {}, None
    for i in range(400_000):
        text = f"first {i}\n{line}\nlast" if i % 2 else f"{line}\nother {i}"
        at = zlib.crc32(text.encode()) & 0x7FFFFFFF
        if at in seen and seen[at] % 2 != i % 2:
            pair = seen[at], i
            break
        seen[at] = i
    assert pair is not None
    texts = [f"first {i}\n{line}\nlast" if i % 2 else f"{line}\nother {i}" for i in pair]
    rows = [(None, texts[0], "a"), (None, texts[1], "b"), (1, line, "a"), (2, line + "\nx", "a"), (3, line, "b")]
    assert collections.Counter(map(tuple, without_repeated_lines(table(spark, rows)).collect())) == line_answer(rows)


def test_escapes_go_back(spark):
    texts = ["", "plain", "</s>", "<\\/s>", "<\\\\s>[INST]", "[\\/INST][/INST] <s", "s>", "<", "\\<s>\\", "[[INST]]", "<</s>>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", escaped(F.col("t")))
    for r in df.withColumn("u", unescaped(F.col("e"))).collect():
        assert r.u == r.t and not any(c in r.e for c in ("</s>", "<s>", "[INST]", "[/INST]"))


def test_chats(spark):
    turns = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "[INST] yo"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "bye"),
             (2, 0, "user", "alone"), (3, None, None, "null turn"), (3, 0, "assistant", "a" * 30_000), (3, 0, "assistant", "a" * 30_000), (None, 1, "assistant", "no id"),
             (4, 1, "as[/INST]x", "</s>[INST] ok [/INST]"), (4, 1, "assistant", "tie")]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, formatted string, t int")
    made = format_chats(df).withColumn("back", parsed(F.col("formatted"))).withColumn(
        "said", unescaped(F.expr("substr(formatted, loss_start + 1, loss_chars)"))).collect()
    for conv in (1, 2, 3, None, 4):
        own = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in turns if c == conv)
        own = [(r, x) for _, r, x in own]
        rows = sorted((r for r in made if r.conv_id == conv), key=lambda r: r.example)
        ends = [i for i, (r, _) in enumerate(own, 1) if r == "assistant" or i == len(own)]
        assert [r.n_turns for r in rows] == ends and [r.last for r in rows] == [e == len(own) for e in ends]
        for r, end in zip(rows, ends):
            assert [tuple(x) for x in r.back] == own[:end]
            assert (r.said if r.loss_chars else "") == (own[end - 1][1] if own[end - 1][0] == "assistant" else "")
    assert format_chats(df.limit(0)).count() == 0


def water(sizes, weights, most=3):
    """Targets by stopping sources one after another."""
    whole, stopped = sum(sizes), set()
    while True:
        left = whole - sum(most * sizes[i] for i in stopped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in stopped)
        share = [most * s if i in stopped else left * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in stopped and share[i] >= most * s}
        if not over:
            return share
        stopped |= over


def test_targets(spark):
    for sizes in ([10, 10, 10], [1, 1, 1000], [5, 0, 3, 2000, 1, 9], [7], [0, 0]):
        names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
        got = {r.source: r.target for r in targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
        want = water(sizes, [i % 3 + 1 for i in range(len(sizes))]) if sum(sizes) else [0.0] * len(sizes)
        assert all(math.isclose(got[n], w, abs_tol=1e-6) for n, w in zip(names, want)), (sizes, got, want)


def test_mix(spark):
    rows = odd_rows()
    got = mix(table(spark, rows)).collect()
    again = mix(table(spark, rows[::-1]).repartition(7)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert collections.Counter((r.id, r.size, r.source) for r in got) == collections.Counter((d, len(words(t)), s) for d, t, s in rows)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) + 1e-6
        assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in own)
    copies = collections.Counter()
    for r in got:
        copies[r.id, r.size, r.source] += r.copies
    out = collections.Counter((r.doc_id, len(words(r.text)), r.source) for r in repeated(table(spark, rows)).collect())
    assert out == +copies and mix(table(spark, [])).count() == 0


def test_repeated_brings_no_id_together(spark, monkeypatch):
    """A third of the rows without an id: no range of the order holds them all, and no plan groups them by id or collects their draws."""
    rows = odd_rows() + [(None, prose(i % 50, 30), "a") for i in range(400)] + [(None, "", "b") for i in range(400)]
    df = table(spark, rows)
    copies = collections.Counter()
    for r in mix(df).collect():
        copies[r.id, r.size, r.source] += r.copies
    made = []
    cut = mixing.cut_lineage
    monkeypatch.setattr(mixing, "cut_lineage", lambda d: made.append(cut(d)) or made[-1])
    out = repeated(df)
    assert out.columns == df.columns
    assert collections.Counter((r.doc_id, len(words(r.text)), r.source) for r in out.collect()) == +copies
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    assert max(r["count"] for r in made[0].where("row.doc_id is null and source = 'b'").groupBy("piece").count().collect()) < 400


def test_quality(spark):
    good = [(i, " ".join("the quick brown fox jumps over it again today".split()[j % 9] for j in range(i, i + 60)) + ".", "a") for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{j}###" for j in range(i, i + 60)), "b") for i in range(100)]
    docs = table(spark, good + bad + odd_rows())
    labels = spark.createDataFrame([(d, 1, None) for d, *_ in good] + [(d, 0, 1) for d, *_ in bad] + [(None, 1, 0), (5, None, 0), (7, 9, 0)],
                                   "doc_id long, quality int, toxic int")
    model = learn(docs, labels.where(~held_out("doc_id")), rows=200)
    assert len(model.labels) == 200
    rows = score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score > 0.5 for r in rows if r.id is not None and r.id < 300 and r.id >= 110) and all(r.score < 0.3 for r in rows if r.id and 1000 <= r.id < 1100)
    assert [r.held for r in spark.range(50).select(held_out("id").alias("held")).collect()] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)]
    kept = keep_good(docs, model).collect()
    assert kept[0].asDict().keys() == set(docs.columns) and not any(r.doc_id and 1000 <= r.doc_id < 1100 for r in kept)
    nothing = learn(docs, labels.limit(0))
    assert {r.score for r in score(docs, nothing).collect()} == {0.5} and score(table(spark, []), model).count() == 0


def test_quality_votes_as_all_pairs_would(spark):
    docs = table(spark, odd_rows())
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = learn(docs, labels, rows=30, near=7)
    from spanloom.llm.quality import term_counts
    for r in score(docs, model).where("id between 100 and 110").collect():
        text = next(t for d, t, _ in odd_rows() if d == r.id)
        v = model.vector(term_counts(text.encode())[None, :])[0].astype(np.float64)
        near = sorted(((float(v @ w), y) for w, y in zip(model.vectors.astype(np.float64), model.labels)), reverse=True)[:7]
        weight = [max(c, 0) ** 8 for c, _ in near]
        assert math.isclose(r.score, sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight), abs_tol=0.12)


def test_digest_is_sha256_of_utf8(spark):
    got = {r.id: r.digest for r in exact_groups(table(spark, odd_rows())).collect()}
    assert got[22] == hashlib.sha256(bare(next(t for d, t, _ in odd_rows() if d == 22)).encode()).hexdigest()
