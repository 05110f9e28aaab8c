"""WARC archives, the filter audit and spelling variants: against brute force, and every query here beside its SQL."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import itertools
import random
import re
import zlib

import pytest

from oracle import compare, connect
from spanloom.llm import filters, spelling, warc
from spanloom.llm.filters import failure_counts, filter_audit, measured, text_measures
from spanloom.llm.queries import ORACLE, QUERIES
from spanloom.llm.spelling import near_words, one_code_point_lost, spelling_groups, word_counts
from spanloom.llm.warc import range_bounds, read_warc, write_warc
from spanloom.session import shared_folder
from tests.llm.cases import odd_rows, prose, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_beside_its_sql(spark, con, key):
    diff, n = compare(spark, con, SF, key, QUERIES[key], ORACLE[key])
    assert diff is None and n, diff


# Filter audit

def plain_measures(text: bytes) -> list[int]:
    words, said = text.split(), text.decode()
    return [len(words), len(set(words)), len(said), len(re.findall("[A-Z]", said)), len(re.findall(r"[#$%&*|]", said))]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_measures_of_texts(monkeypatch, block):
    monkeypatch.setattr(filters, "BLOCK", block)
    pick = random.Random(block)
    for _ in range(20):
        texts = ["".join(pick.choice("ab AB\t\n\x0b#é日 cdefghijk") for _ in range(pick.choice([0, 1, 3, 50, 800]))).encode() for _ in range(pick.randint(1, 20))]
        texts += [b"x" * pick.randint(1, 40), b"averyveryverylongword1 averyveryverylongword2 averyveryverylongword1"]
        assert measured(texts).tolist() == [plain_measures(t) for t in texts]


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(filters.WordTable, "_hashes", lambda self, start, size, owner: (start * 0).astype("uint64"))
    texts = [prose(i, 60).encode() for i in range(5)] + [b"one two one", b""]
    assert measured(texts).tolist() == [plain_measures(t) for t in texts]


def audit_answer(rows, labels):
    good = collections.defaultdict(bool)
    toxic = collections.defaultdict(bool)
    for d, q, t in labels:
        if d is not None:
            good[d] |= q == 1
            toxic[d] |= t == 1
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    judged = []
    for d, t, s in rows:
        words, distinct, points, capitals, symbols = plain_measures((t or "").encode())
        fails = {"A": words < 50, "B": 100 * distinct < 65 * words, "C": 100 * capitals > 5 * points, "D": symbols > 0, "E": d is not None and least[t or ""] < d}
        judged.append((s or "", fails, good.get(d, False), toxic.get(d, False)))
    out, shapley = [], collections.Counter()
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [j for j in left if j[1][f]]
                left = [j for j in left if not j[1][f]]
                shapley[part, f] += len(gone)
                out.append([part, order, step, len(left), len(gone), sum(j[1][f] and any(j[1][x] for x in order[:step - 1]) for j in own),
                            sum(j[1][f] and sum(j[1].values()) == 1 for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_of_odd_rows(spark):
    rows = odd_rows() + [(300 + i, f"{prose(9, 60)} # {i % 3}", "a") for i in range(9)] + [(400, "SHOUTING " * 60, "b"), (401, "SHOUTING " * 60, "a"), (None, None, None)]
    labels = [(d, i % 2, i % 3 % 2) for i, (d, *_) in enumerate(rows)] + [(None, 1, 1), (1, None, None), (99999, 1, 1)]
    said = spark.createDataFrame([(*x, "n", 5) for x in labels], "doc_id long, quality int, toxic int, part string, n int")
    got = filter_audit(table(spark, rows), said).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(map(tuple, got.collect())) == audit_answer(rows, labels)


def test_audit_of_nothing(spark):
    none = table(spark, odd_rows()).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(none, labels).count() == 0 and failure_counts(none, labels).count() == 0 and text_measures(none).count() == 0


# Spelling variants

def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelling_answer(n: dict[str, int], times: int = 10):
    by = collections.defaultdict(list)
    for w in n:
        for i in range(len(w)):
            by[i, w[:i] + w[i + 1:]].append(w)
    beside = collections.defaultdict(set)
    for (_, less), own in by.items():
        for a in own:
            beside[a] |= {b for b in own if b != a}
            if less in n:
                beside[a].add(less)
                beside[less].add(a)
    form = {}
    for w in n:
        best = min(beside[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, n[w], len(beside[w]), form[w] or "", n[form[w]] if form[w] is not None else -1, root(w)) for w in n)


def as_rows(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", -1 if r.form_n is None else r.form_n, r.root) for r in df.collect())


@pytest.mark.parametrize("short", [48, 3])
def test_states_find_each_pair_once(monkeypatch, short):
    monkeypatch.setattr(spelling, "SHORT", short)
    pick = random.Random(short)
    for _ in range(25):
        words = sorted({"".join(pick.choice("aab") for _ in range(pick.randint(1, 9))) for _ in range(60)})
        found = []
        for s in range(10):
            for lo, hi, below in spelling.halves(s, 0, 0, s + 1):
                states = collections.defaultdict(list)
                for w in words:
                    if len(w) in (s, s + 1):
                        states[w[:lo], w[len(w) - hi:]].append(w)
                for own in states.values():
                    found += [tuple(sorted(p)) for p in spelling.pairs_of_state(own, s, lo, hi, below)]
        assert sorted(found) == sorted(p for p in itertools.combinations(words, 2) if near(*p))


@pytest.mark.parametrize("most", [20_000, 3])
def test_groups_of_words(spark, most):
    pick, n = random.Random(most), {}
    for stem in [prose(i, 1) + prose(90 + i, 1) for i in range(40)] + ["aaaaaaa", "bbbbbbbbbb", "q" * 4000, ""]:
        n[stem] = pick.choice([1, 20, 500, 8000])
        for _ in range(12):
            i, c = pick.randint(0, len(stem)), pick.choice("abcé日")
            n.setdefault(pick.choice([stem[:i] + c + stem[i:], stem[:i] + c + stem[i + 1:], stem[:i] + stem[i + 1:]]), pick.choice([1, 2, 30, 800]))
    words = spark.createDataFrame([*n.items(), (None, 9)], "word string, n long")
    assert as_rows(spelling_groups(words, most=most)) == spelling_answer(n)
    assert near_words(words, most).where("word = near").count() == 0


def test_word_counts_and_their_groups(spark):
    rows = odd_rows() + [(500 + i, "Sisyphus rolled; Sisiphus ROLLED Ärgernis ärgernis×ärgernis " * (i % 5), "a") for i in range(20)] + [(None, "Nameless nameless", None)]
    n = collections.Counter()
    for d, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    counted = word_counts(table(spark, rows), change=one_code_point_lost)
    assert dict(map(tuple, counted.collect())) == n
    assert as_rows(spelling_groups(counted)) == spelling_answer(n)
    none = word_counts(table(spark, rows).limit(0))
    assert none.count() == 0 and spelling_groups(none).count() == 0


# WARC

def pages_of(spark, rows):
    return spark.createDataFrame([(d, u, h, "n", 5, "x", "y") for d, u, h in rows], "page_id long, url string, html string, id string, n int, digest string, top string")


def warc_answer(rows, least=0):
    key = lambda d: -(1 << 63) if d is None else d
    top = {}
    for d, _, h in rows:
        top[h or ""] = max(top.get(h or "", key(None)), key(d))
    out = []
    for d, u, h in rows:
        body = (h or "").encode()
        again = key(d) < top[h or ""] and len(body) >= least
        out.append((d, u, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", top[h or ""] if again else None, None if again else body))
    return collections.Counter(out)


def odd_pages():
    tricky = "HTTP/1.1 200\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\né日"
    return [(1, "http://a/1", "<p>x"), (2, "http://a/ü %41\r\nX: y", "<p>x"), (3, None, tricky), (4, "u", None), (5, "u", ""), (6, "", None), (None, "u", "<p>x"), (None, "u", None),
            (None, "u", "lone"), (None, "v", "lone"), (7, "u", "same row"), (7, "u", "same row"), (8, "u", "x" * 300_000), (8, "v", "x" * 300_000), (-5, "u", tricky)] + [
        (100 + i, f"http://b/{i}", f"<html>{prose(i % 23, 50)}</html>") for i in range(80)] + [(900, "hot", "hot page")] * 60


@pytest.mark.parametrize("least", [0, 10])
def test_archive_reads_back(spark, least):
    rows, folder = odd_pages(), shared_folder(spark, "warc")
    manifest = write_warc(pages_of(spark, rows), folder, least_bytes=least, file_bytes=4000)
    got = [(r.row_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in read_warc(spark, folder).collect()]
    assert collections.Counter(got) == warc_answer(rows, least)
    files = manifest.collect()
    assert sum(f.records for f in files) == len(rows) and all(f.bytes <= 4000 or f.records == 1 for f in files) and len(files) > 8
    with pytest.raises(ValueError):
        write_warc(pages_of(spark, rows), folder)


def test_same_rows_give_the_same_files(spark):
    rows, made = list(dict.fromkeys(odd_pages())), []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        folder = shared_folder(spark, "warc")
        write_warc(pages_of(spark, rows).repartition(seed + 2), folder, file_bytes=9000)
        made.append({r.name: r.sha256 for r in spark.read.parquet(f"{folder}/manifest").collect()})
        files, base = warc.store(folder)
        left = [x.base_name for x in files.get_file_info(warc.pa.fs.FileSelector(base)) if not x.base_name.startswith(".")]
        assert sorted(left) == sorted([*made[-1], "manifest"])  # nothing temporary stays
    assert made[0] == made[1]


def test_files_are_plain_warc(spark):
    folder = shared_folder(spark, "warc")
    write_warc(pages_of(spark, [(1, "http://a", "<p>"), (2, "http://b", "<p>")]), folder)
    files, base = warc.store(folder)
    whole = b"".join(gzip.decompress(files.open_input_stream(f"{base}/{r.name}", compression=None).read()) for r in spark.read.parquet(f"{folder}/manifest").collect())
    assert re.findall(rb"WARC-Type: (\w+)", whole).count(b"warcinfo") >= 1 and whole.endswith(b"\r\n\r\n")
    name = re.search(rb"WARC-Type: response\r\nWARC-Record-ID: (\S+)", whole).group(1)
    assert re.search(rb"WARC-Refers-To: (\S+)", whole).group(1) == name


def test_damaged_archive_is_refused(spark):
    folder = shared_folder(spark, "warc")
    name = write_warc(pages_of(spark, [(1, "http://a", "<p>")]), folder).first().name
    files, base = warc.store(folder)
    content = gzip.decompress(files.open_input_stream(f"{base}/{name}", compression=None).read()).replace(b"<p>", b"<q>")
    with files.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(gzip.compress(content))
    with pytest.raises(Exception, match="another digest|not as its manifest"):
        read_warc(spark, folder).collect()


def test_empty_archive(spark):
    folder = shared_folder(spark, "warc")
    assert write_warc(pages_of(spark, [(1, "u", "x")]).limit(0), folder).count() == 0 and read_warc(spark, folder).count() == 0


def test_a_heavy_key_fills_several_ranges(spark):
    keys = spark.createDataFrame([(i, bytearray(b"d"), 7, 1) for i in range(100)] + [(50, bytearray(b"e"), 7, 900)], "id long, digest binary, place long, weight long")
    bounds = range_bounds(keys, 10)
    assert len(bounds) == 9 and bounds.count((50, b"e", 7)) >= 7
