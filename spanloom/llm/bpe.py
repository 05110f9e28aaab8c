"""Byte-pair encoding and decoding as streaming transducers.

From a merge list follows how far a text's unknown continuation can reach back (``lookahead``): what stands further than that
before the end of the bytes read so far is final. So a run of any length is encoded through one window, whose tokens are emitted
once they are stable. Decoding feeds tokens' bytes to an incremental UTF-8 decoder, which keeps at most three bytes.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = 100_000  # runs of letters or signs remembered as used of late, and as many as used before that
GROUP = 1 << 20  # bytes of texts whose new runs are merged together
SHORT = 48  # bytes up to which a run is merged by plain passes, and characters up to which it is remembered
NEAR = 0x250  # code points below it, which all tables have alike, are told apart by a pattern of their own
SPACE = re.compile(rb"[\x20\x09-\x0D]")
NEVER = 1 << 60  # the rank of a pair that is not merged
DECODED = 1 << 15  # ids decoded at a time


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


@lru_cache(4)
def ranges(kind: str, end: int = 0x110000) -> str:
    """The code points of a general category below ``end``, as the inside of a character class."""
    inside = np.array([0, *(unicodedata.category(chr(c))[0] == kind for c in range(end)), 0], np.int8)
    turns = np.flatnonzero(np.diff(inside))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()))


def lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """Bytes before the end of a prefix in which its tokens may still change, however the text goes on.

    A change spreads to the left only through a merge (u, v) whose v begins at the left edge of what has changed. That edge
    was set by an earlier merge with left part u', so u' begins v: it is v itself or lies on v's chain of left parts. The
    longest such chain, counted in the bytes of its left parts, is found in one pass over the merges in order of rank.
    """
    left, reach = {}, {}
    for u, v in merges:
        bare = len(u.removesuffix(suffix)) if suffix else len(u)
        longest, part = 0, v
        while part is not None:
            longest, part = max(longest, reach.get(part, 0)), left.get(part)
        reach[u] = max(reach.get(u, 0), bare + longest)
        left[u + v] = u
    return max(reach.values(), default=0)


class Encoder:
    """Encodes as the tokenizer file says: added tokens, NFC and lower case where asked for, its pattern, byte letters, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, kinds = told["model"], json.dumps([told["normalizer"], told["pre_tokenizer"]])
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.look = lookahead(merges, self.suffix)
        self.letters = byte_letters()
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.composed, self.lower = '"NFC"' in kinds, '"Lowercase"' in kinds
        pattern = next(p["pattern"]["Regex"] for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # White space is that of regex also where re reads the pattern, which counts four more signs.
        near = pattern.replace(r"\s", "".join(f"\\U{c:08x}" for c in range(NEAR) if regex.match(r"\s", chr(c))))
        for kind in "LN":  # letters and numbers as this Python's Unicode tables have them, whatever those of regex are
            near, pattern = near.replace(f"\\p{{{kind}}}", ranges(kind, NEAR)), pattern.replace(f"\\p{{{kind}}}", ranges(kind))
        self.near, self.pattern = re.compile(near), regex.compile(pattern)
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # The merges by pairs of ids, each in the first free place from where its hash points.
        table = np.array([(self.vocab[u], self.vocab[v], self.vocab[u + v]) for u, v in merges], np.int64).reshape(-1, 3)
        self.bits = max(4, len(table).bit_length() + 2)
        self.pairs, self.pair_rank, self.pair_id = np.full(1 << self.bits, -1), np.full(1 << self.bits, NEVER), np.zeros(1 << self.bits, np.int64)
        keys = table[:, 0] << 32 | table[:, 1]
        left, at = np.arange(len(keys)), self.places(keys)
        while len(left):
            free, own = np.unique(np.where(self.pairs[at] < 0, at, -1), return_index=True)
            own = own[free >= 0]
            self.pairs[at[own]], self.pair_rank[at[own]], self.pair_id[at[own]] = keys[left[own]], left[own], table[left[own], 2]
            left, at = np.delete(left, own), np.delete(at, own) + 1 & len(self.pairs) - 1
        self.first = np.array([self.vocab[c] for c in self.letters], np.int64)
        self.final = np.array([self.vocab[c + self.suffix] for c in self.letters], np.int64)

    def normal(self, text: str) -> str:
        if self.composed:
            text = unicodedata.normalize("NFC", text)
        # Letters are lowered one by one: sigma has one small form wherever it stands.
        return text.replace("Σ", "σ").lower() if self.lower else text

    def merged(self, symbols: list[str]) -> list[str]:
        """The symbols after all merges, lowest rank first, the leftmost first among equals."""
        ranks = self.ranks
        if len(symbols) > SHORT:
            return self._merged_long(symbols)
        symbols = list(symbols)
        worth = [ranks.get(p, NEVER) for p in zip(symbols, symbols[1:])]
        while worth and (best := min(worth)) < NEVER:
            i = worth.index(best)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            del worth[i]
            if i:
                worth[i - 1] = ranks.get((symbols[i - 1], symbols[i]), NEVER)
            if i < len(worth):
                worth[i] = ranks.get((symbols[i], symbols[i + 1]), NEVER)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        """The same through a queue of pairs and links between neighbours."""
        ranks, n = self.ranks, len(symbols)
        after, before, at = [*range(1, n), -1], [*range(-1, n - 1)], list(symbols)
        queue = [(r, i) for i in range(n - 1) if (r := ranks.get((at[i], at[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if at[i] is None or j < 0 or ranks.get((at[i], at[j])) != rank:
                continue
            at[i], at[j], after[i] = at[i] + at[j], None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := ranks.get((at[k], at[after[k]]))) is not None:
                    heapq.heappush(queue, (r, k))
        return [s for s in at if s is not None]

    def stream(self, run: Iterable[int]) -> Iterator[int]:
        """The ids of one run of bytes, which may be of any length: no more than one window of it is held."""
        letters, vocab, source = self.letters, self.vocab, iter(run)
        window: list[str] = []
        size, ahead = 4 * self.look + 4096, next(source, None)
        while ahead is not None or window:
            while ahead is not None and len(window) < size:
                nxt = next(source, None)
                window.append(letters[ahead] + (self.suffix if nxt is None else ""))
                ahead = nxt
            stable = len(window) - (self.look if ahead is not None else 0)
            done = 0
            for token in self.merged(window):
                length = len(token.removesuffix(self.suffix)) if self.suffix else len(token)
                if done + length > stable:
                    break
                done += length
                yield vocab[token]
            window = window[done:]

    def forget(self) -> None:
        """Drops what is remembered, so that an idle worker holds the tables alone."""
        self.runs, self.older = {}, {}

    def places(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def worth(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair of ids (NEVER if it is not merged) and where it stands in the table."""
        keys = left << 32 | right
        at = self.places(keys)
        found = self.pairs[at]
        on = np.flatnonzero((found != keys) & (found >= 0))
        while len(on):  # another pair stands there
            at[on] = at[on] + 1 & len(self.pairs) - 1
            found = self.pairs[at[on]]
            on = on[(found != keys[on]) & (found >= 0)]
        return self.pair_rank[at], at

    def merged_many(self, runs: list[bytes]) -> list[bytes]:
        """The packed ids of many short runs: in each round every run makes its best merge, the leftmost among equals."""
        done = []  # (runs, their numbers of ids, their ids), as they end
        if not self.ranks:
            raise ValueError("a merge list is needed")
        sizes = np.array([len(r) for r in runs], np.int64)
        ids, ends = self.first[np.frombuffer(b"".join(runs), np.uint8)], np.cumsum(sizes)
        raw = np.frombuffer(b"".join(runs), np.uint8)
        ids[ends - 1] = self.final[raw[ends - 1]]
        own = np.arange(len(runs))
        rank, at = self.worth(ids, np.append(ids[1:], 0))
        rank[ends - 1] = NEVER
        while len(own):
            starts = ends - sizes
            best = np.minimum.reduceat(rank, starts)
            stops = best == NEVER
            if stops.any():
                stay = np.repeat(~stops, sizes)
                done.append((own[stops], sizes[stops], ids[~stay].astype(np.uint32)))
                ids, rank, at = ids[stay], rank[stay], at[stay]
                own, sizes, best = own[~stops], sizes[~stops], best[~stops]
                if not len(own):
                    break
                ends = np.cumsum(sizes)
                starts = ends - sizes
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            run = np.searchsorted(ends, hit, "right")
            place = hit[np.append([True], run[1:] != run[:-1])]  # one a run
            ids[place] = self.pair_id[at[place]]
            stay = np.ones(len(ids), bool)
            stay[place + 1] = False
            ids, rank, at, place = ids[stay], rank[stay], at[stay], place - np.arange(len(place))
            sizes = sizes - 1
            ends = np.cumsum(sizes)
            starts = ends - sizes
            # Only the pairs beside a merge are new.
            last = place == ends - 1
            rank[place[last]] = NEVER
            fresh = np.concatenate([place[~last], place[place > starts] - 1])
            rank[fresh], at[fresh] = self.worth(ids[fresh], ids[fresh + 1])
        order, sizes, ids = (np.concatenate(x) for x in zip(*done))
        packed, ends = ids.tobytes(), np.cumsum(4 * sizes)
        out = [b""] * len(runs)
        for i, a, b in zip(order.tolist(), (ends - 4 * sizes).tolist(), ends.tolist()):
            out[i] = packed[a:b]
        return out

    def pieces(self, text: str) -> list[str]:
        """The runs of a text that are merged each by itself, and the added tokens in it."""
        if "<" not in text:
            return self._runs_of(text)
        out, start = [], 0
        for found in self.special.finditer(text):
            out += [*self._runs_of(text[start:found.start()]), found[0]]
            start = found.end()
        return out + self._runs_of(text[start:])

    def _runs_of(self, text: str) -> list[str]:
        text = self.normal(text)
        near = text.isascii() or np.frombuffer(text.encode("utf-16-le"), np.uint16).max() < NEAR
        return (self.near if near else self.pattern).findall(text)

    def _run(self, piece: str) -> bytes:
        """The packed ids of a run of any length."""
        raw = piece.encode("utf-8")
        if len(raw) > self.look:
            return b"".join(np.fromiter(chunk, np.uint32).tobytes() for chunk in iter(lambda s=self.stream(raw): list(islice(s, DECODED)), []))
        symbols = [self.letters[b] for b in raw]
        symbols[-1] += self.suffix
        return array("I", [self.vocab[s] for s in self.merged(symbols)]).tobytes()

    def learn(self, used: set[str]) -> dict[str, bytes]:
        """The packed ids of all runs in use, those just remembered and others. New short ones are merged together; long ones are not remembered."""
        fresh = used.difference(self.runs)
        if len(self.runs) + len(fresh) > RUNS:
            self.older, self.runs, fresh = self.runs, {}, used
        long = {p: np.uint32(self.added[p]).tobytes() if p in self.added else self._run(p) for p in fresh if len(p) > SHORT or p in self.added}
        known = {p: self.older[p] for p in fresh if p in self.older}
        new = [p for p in fresh if p not in known and p not in long]
        if new:
            known.update(zip(new, self.merged_many([p.encode("utf-8") for p in new])))
        self.runs.update(known)
        return self.runs | long if long else self.runs

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """The packed ids (uint32) of each text in UTF-8. Tokens never span ASCII white space, so a text may be read in chunks cut there."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []

        def flush() -> None:
            ids = self.learn(set().union(*(pieces for _, pieces in held)))
            for i, pieces in held:
                out[i].append(b"".join(map(ids.__getitem__, pieces)))
            held.clear()
        size = 0
        for i, text in enumerate(texts):
            for chunk in chunks(text):
                held.append((i, self.pieces(chunk.decode("utf-8"))))
                size += len(chunk)
                if size >= GROUP:
                    flush()
                    size = 0
        flush()
        return [b"".join(parts) for parts in out]

    def encode(self, text: bytes) -> Iterator[bytes]:
        """The packed ids of one text."""
        yield self.encode_many([text])[0]


def chunks(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes, cut at ASCII white space; without any, in one piece."""
    start = 0
    while len(text) - start > size:
        found = SPACE.search(text, start + size)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end
    yield text[start:] if start else text


class Decoder:
    """Turns ids into text, a batch at a time. ``pieces`` gives the vocabulary's own strings with a space between, as a file without
    a decoder asks for; otherwise ids become the bytes they stand for, and word ends become spaces."""

    def __init__(self, path: str, pieces: bool | None = None):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.pieces = told["decoder"] is None if pieces is None else pieces
        suffix, bytes_of = told["model"].get("end_of_word_suffix") or "", {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
        names = {i: s for s, i in told["model"]["vocab"].items()}
        added = {t["id"]: t["content"] for t in told["added_tokens"]}
        self.table: list[bytes] = []
        for i in range(max([*names, *added]) + 1):
            if i in added or self.pieces:
                self.table.append((added[i] if i in added else names.get(i, "")).encode("utf-8"))
            else:
                s = names.get(i, "")
                ends = bool(suffix) and s.endswith(suffix)
                self.table.append(b"".join(bytes_of[c] for c in (s[: -len(suffix)] if ends else s)) + b" " * ends)

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        state, between = codecs.getincrementaldecoder("utf-8")("replace"), b" " if self.pieces else b""
        for start in range(0, len(ids), DECODED):
            piece = between.join([self.table[i] for i in ids[start:start + DECODED].tolist()])
            yield state.decode(between + piece if start else piece)
        yield state.decode(b"", final=True)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(2)
def decoder(path: str, pieces: bool | None) -> Decoder:
    return Decoder(path, pieces)


def _lists(packed: list[bytes], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.uint32).astype(np.int32)), type=kind)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``GROUP`` bytes of texts each; the texts are in the second column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    turns = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // GROUP)) + 1
    for start, end in pairwise([0, *turns.tolist(), batch.num_rows]):
        yield batch.slice(start, end - start)


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ids, the tokens of the whole text under the tokenizer file at ``path``.

    A null or empty text, or one of white space only, has no tokens. Rows with null or repeated ids are encoded like any other. An
    empty table gives an empty result. Other columns are not looked at. Strings of added tokens inside a text become those tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        try:
            for batch in batches:
                for part in parts(batch):
                    packed = bpe.encode_many([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(1)])
                    yield pa.RecordBatch.from_arrays([part.column(0), _lists(packed, pa.list_(pa.int32()))], names=["id", "ids"])
        finally:
            bpe.forget()
    rows = docs.select(F.col(id).cast("long").alias("id"), F.encode(F.col(text).cast("string"), "UTF-8").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id: str = "id", ids: str = "ids", pieces: bool | None = None) -> DataFrame:
    """One row per row: id, ids and text, decoded with special tokens kept. Null and empty lists give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = decoder(path, pieces)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = ["".join(text_of.decode(x.values.to_numpy())) if x.is_valid else "" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "ids", "text"])
    return encoded.select(F.col(id).cast("long").alias("id"), F.col(ids).alias("ids")).mapInArrow(run, "id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``decode(encode(docs, path), path)`` gives, by one worker a task instead of two."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, text_of = encoder(path), decoder(path, None)
        try:
            for batch in batches:
                for part in parts(batch):
                    packed = bpe.encode_many([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(1)])
                    texts = ["".join(text_of.decode(np.frombuffer(p, np.uint32))) for p in packed]
                    yield pa.RecordBatch.from_arrays([part.column(0), _lists(packed, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["id", "ids", "text"])
        finally:
            bpe.forget()
    rows = docs.select(F.col(id).cast("long").alias("id"), F.encode(F.col(text).cast("string"), "UTF-8").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, text string")
