"""Spelling variants: words one edit apart, found by finite-state composition.

The vocabulary is an acceptor V, one edit a transducer E; the pairs are what V o E o V accepts. A pair of words, the shorter of length s,
agrees up to its edit and after it, so the composition is enumerated by initial states: a state stands for the words of lengths s and s + 1
that share ``lo`` code points on the left and ``hi`` on the right, and it finds the pairs whose common prefix is at least ``lo`` and less than
``below``. Cutting what lies between in half gives two smaller states that share out those pairs. Every word begins in the states cut
once; a state with more than ``most`` words is cut again, until what lies between is one code point. So each pair is found in one state, and
no task holds more than ``most`` words at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import partitions, text_or_empty
from spanloom.session import cut_lineage

RUN = "[A-Za-zÀ-ÿ]+"
FLUSH = 1 << 17  # different words that a task counts before it hands them on
SHORT = 48  # code points between the shared ends up to which an acceptor is built
SALTS = 64
STATE = ["s", "lo", "hi", "below", "left", "right"]


def one_code_point_lost(id: str, run: str) -> str:
    """A run as it is written under an id when one in 31, chosen by checksum, loses a code point."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{id}:".encode()))
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counted(run: str, least: int, change: Callable[[str, str], str] | None):
    runs = re.compile(run)

    def flushed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for id, text in zip(batch.column("id"), batch.column("text")):
                low = text.as_buffer().to_pybytes().lower().decode()  # bytes are lower-cased from A-Z only
                for word, n in Counter(runs.findall(low)).items():
                    if len(word) >= least:
                        if change is not None:
                            word = change(id.as_py(), word)
                            if len(word) < least:
                                continue
                        held[word] += n
                if len(held) >= FLUSH:
                    yield flushed(held)
                    held.clear()
        yield flushed(held)
    return work


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", run: str = RUN, least_chars: int = 7, least_n: int = 2,
                change: Callable[[str, str], str] | None = None) -> DataFrame:
    """word, n: the runs of whole texts in lower case (A-Z only) of at least ``least_chars`` code points that occur at least ``least_n`` times.

    ``change(id, run)`` may give another spelling of a run of at least ``least_chars``; its result counts by its own length. A null id reads as
    an empty string there. Null and empty texts have no runs, repeated rows count each time, an empty table gives an empty result.
    """
    rows = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.encode(text_or_empty(text), "UTF-8").alias("text"))
    found = rows.mapInArrow(_counted(run, least_chars, change), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def acceptor(words: list[str]) -> tuple[int, list]:
    """The minimised acceptor of different words in order: its initial state and, per state, whether it accepts and its arcs by code point."""
    states, known = [], {}

    def build(a: int, b: int, depth: int) -> int:
        final = len(words[a]) == depth
        arcs, i = {}, a + final
        while i < b:
            j, c = i, words[i][depth]
            while j < b and words[j][depth] == c:
                j += 1
            arcs[c] = build(i, j, depth + 1)
            i = j
        key = (final, *arcs.items())
        if key not in known:  # states with the same words ahead are one
            known[key] = len(states)
            states.append((final, arcs))
        return known[key]
    return build(0, len(words), 0), states


def composed(words: list[str], length: int) -> Iterator[tuple[str, str]]:
    """The pairs one edit apart whose shorter word has ``length``, of different words in order of lengths ``length`` and one more. The edit
    stands where the common prefix ends, so each pair comes once; of a pair of one length the smaller word comes first, else the shorter."""
    start, states = acceptor(words)
    meeting: dict[tuple, bool] = {}

    def meet(p: int, q: int, rest: int) -> bool:
        """Whether both states have a word of ``rest`` code points ahead."""
        p, q = min(p, q), max(p, q)
        found = meeting.get((p, q, rest))
        if found is None:
            (end_p, arcs_p), (end_q, arcs_q) = states[p], states[q]
            found = end_p and end_q if rest == 0 else any(c in arcs_q and meet(to, arcs_q[c], rest - 1) for c, to in arcs_p.items())
            meeting[(p, q, rest)] = found
        return found

    def shared(p: int, q: int, rest: int, but: str | None = None) -> Iterator[str]:
        if not meet(p, q, rest):
            return
        if rest == 0:
            yield ""
            return
        arcs = states[q][1]
        for c, to in states[p][1].items():
            if c != but and c in arcs:
                for tail in shared(to, arcs[c], rest - 1):
                    yield c + tail
    todo = [(start, "")]
    while todo:
        at, read = todo.pop()
        arcs = list(states[at][1].items())
        rest = length - len(read)
        for i, (a, to) in enumerate(arcs):
            if rest:
                for b, other in arcs[i + 1:]:
                    for tail in shared(to, other, rest - 1):
                        yield read + a + tail, read + b + tail
            if rest >= 0:
                for tail in shared(at, to, rest, but=a):
                    yield read + tail, read + a + tail
            todo.append((to, read + a))


def halves(s: int, lo: int, hi: int, below: int) -> list[tuple[int, int, int]]:
    """(lo, hi, below) of the two states that a state is cut into."""
    between = s - lo - hi
    cut = lo + (between + 1) // 2
    return [(cut, hi, below), (lo, hi + between // 2, min(below, cut))]


def prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def pairs_of_state(words: list[str], s: int, lo: int, hi: int, below: int) -> Iterator[tuple[str, str]]:
    """Pairs of a state's words (all different) as the module says. A wide gap between the shared ends is cut here as well."""
    if len(words) < 2 or lo >= below:
        return
    if s - lo - hi > SHORT:
        for part in halves(s, lo, hi, below):
            groups: dict[tuple, list[str]] = {}
            for w in words:
                groups.setdefault((w[:part[0]], w[len(w) - part[1]:]), []).append(w)
            for own in groups.values():
                yield from pairs_of_state(own, s, *part)
        return
    left, right = words[0][:lo], words[0][len(words[0]) - hi:]
    for a, b in composed(sorted(w[lo:len(w) - hi] for w in words), s - lo - hi):
        a, b = left + a + right, left + b + right
        if below > s or prefix(a, b) < below:
            yield a, b


def _enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by state and word; gives every pair both ways."""
    def told(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                                          names=["word", "near", "near_n"])

    def of_state(state: tuple, held: list[tuple]) -> Iterator[tuple]:
        if len(held) > 1:
            n = dict(held)
            for a, b in pairs_of_state(list(n), *state[:4]):
                yield a, b, n[b]
                yield b, a, n[a]
    state, held, found = None, [], []
    for batch in batches:
        for *key, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if key != state:
                if held:
                    found.extend(of_state(state, held))
                state, held = key, []
            held.append((word, n))
            if len(found) >= 1 << 15:
                yield told(found)
                found = []
    if held:
        found.extend(of_state(state, held))
    yield told(found)


def _in_states(rows: DataFrame) -> DataFrame:
    """Rows with s, lo, hi, below, word, n, each in the two states that its own is cut into."""
    between = F.col("s") - F.col("lo") - F.col("hi")
    cut = F.col("lo") + F.floor((between + 1) / 2)
    both = F.explode(F.array(F.struct(cut.alias("lo"), F.col("hi"), F.col("below")),
                             F.struct(F.col("lo"), (F.col("hi") + F.floor(between / 2)).alias("hi"), F.least("below", cut).alias("below"))))
    rows = rows.select("s", "word", "n", both.alias("x")).select("s", *(F.col(f"x.{c}").cast("int").alias(c) for c in ("lo", "hi", "below")), "word", "n")
    return rows.where("lo < below").select("s", "lo", "hi", "below", F.substring("word", F.lit(1), F.col("lo")).alias("left"),
                                           F.substring("word", F.length("word") - F.col("hi") + 1, F.col("hi")).alias("right"), "word", "n")


def near_words(words: DataFrame, most: int = 20_000) -> DataFrame:
    """word, near, near_n: all pairs of different words one inserted, deleted or replaced code point apart, both ways.

    ``words`` has word and n, each word once; null words are left out. ``most`` bounds the words of a state, not the pairs: larger states
    are cut until none is larger (or nothing is left to cut, where a state holds the words that differ in one place).
    """
    at = words.where("word is not null").withColumn("s", F.explode(F.array(F.length("word"), F.length("word") - 1))).where("s >= 0")
    rows, ready = _in_states(at.select("s", F.lit(0).alias("lo"), F.lit(0).alias("hi"), (F.col("s") + 1).alias("below"), "word", "n")), None
    while True:
        rows = cut_lineage(rows)
        large = rows.groupBy(*STATE).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > most).where("s - lo - hi > 1")
        large = cut_lineage(large.select(*STATE, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(True).alias("large")))
        if large.isEmpty():
            break
        marked = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("long")).join(large, [*STATE, "salt"], "left")
        marked = cut_lineage(marked.drop("salt"))
        left = marked.where("large is null").drop("large")
        ready = left if ready is None else ready.unionByName(left)
        rows = _in_states(marked.where("large").select("s", "lo", "hi", "below", "word", "n"))
    ready = rows if ready is None else ready.unionByName(rows)
    return (ready.repartition(partitions(words), *STATE).sortWithinPartitions(*STATE, "word")
            .mapInArrow(_enumerated, "word string, near string, near_n long"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following the forms of (word, form) ends. No form may lead back to its word. The steps double every round."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = cut_lineage(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if met.where("moved").isEmpty():
            return met.select("word", "root")
        at = met.select("word", "root")


def spelling_groups(words: DataFrame, times: int = 10, most: int = 20_000) -> DataFrame:
    """One row per word of (word, n): word, n, n_near, form, form_n and root.

    ``form`` is the near word with the largest n, of equal ones the smallest in code-point order, if its n is at least ``times`` the word's;
    else null. ``root`` follows the forms to the last. A form is followed by at most one per factor ``times`` of n, so the rounds are few. Null
    words are left out; words must not repeat. An empty table gives an empty result.
    """
    words = cut_lineage(words.where("word is not null").select("word", "n"))
    best = near_words(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))

    def if_large(c: str) -> Column:
        return F.when(F.col("form_n") >= times * F.col("n"), F.col(c)).alias(c)
    told = cut_lineage(told.select("word", "n", "n_near", if_large("form"), if_large("form_n")))
    ends = roots(told.where("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
