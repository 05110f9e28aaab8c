"""Rows that every operator has to take, and plain answers to hold the results against."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, key string, digest string, size int, part string"


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    stems = ["".join(pick.choice("abcdefghinorstuéß") for _ in range(pick.randint(2, 9))) for _ in range(max(40, words))]
    return " ".join(pick.choice(stems) for _ in range(words))


def odd_rows() -> list[tuple]:
    """(id, text, source): nulls, empty, blank and very long texts, copies, ties, near copies, repeated rows and ids."""
    base, passage = prose(1, 120), prose(2, 30)
    near = base.split()
    near[60] = "other"
    shared = "a line that stands in several documents here"
    rows = [
        (1, base, "a"), (2, " ".join(near), "a"), (3, "  " + base.replace(" ", "\n"), "b"), (4, base, None), (5, base.upper(), "b"),
        (6, None, "a"), (7, "", None), (8, " \t\n", "c"), (9, None, None), (10, "one two", "c"), (11, "One\ttwo", "c"), (12, "word", "d"),
        (13, f"{shared}\nfirst\n{shared}", "a"), (14, f"x\n\t{shared.upper()} \nsecond", "b"), (15, f"{shared}\r\n{shared}\nlast", "c"),
        (16, f"head {passage} tail", "a"), (17, passage + passage, "b"), (18, f"éé{passage}ßß", None), (19, "x" * 5000, "d"), (20, "x" * 4999, "d"),
        (21, prose(3, 20_000), "e"), (22, "a b\x1cc d é Σίσυφος don't 12 <|endoftext|> 日本語 [INST] </s>", "e"), (23, "\n\n\n", "e"),
        (None, base, "a"), (None, passage, "b"), (24, "repeated row " + passage, "f"), (24, "repeated row " + passage, "f"), (25, "one id", "f"), (25, "two texts " + base, "f"),
    ]
    return rows + [(100 + i, prose(50 + i % 7, 40) + f" {'extra ' * (i % 3)}", random.Random(i).choice("aab")) for i in range(40)]


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The rows as documents, with further columns whose names clash with what the operators use inside."""
    return spark.createDataFrame([(d, t, None, s, 0, -5, "n", "k", "g", -1, "p") for d, t, s in rows], SCHEMA)


def words(text: str | None) -> list[str]:
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out + [word] * bool(word)


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
