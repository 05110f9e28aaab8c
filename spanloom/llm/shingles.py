"""Hashes of runs of words, computed for a whole text at once with numpy."""

from __future__ import annotations

import numpy as np

BLOCK = 100_000  # words hashed at a time, so that memory does not follow the text's length
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def running(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes; differences of them identify substrings."""
    up, _ = _powers_to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[:len(raw)], out=sums[1:])
    return sums


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the substrings from starts to ends; the length takes part."""
    _, back = _powers_to(len(sums))
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.lower().split()


def word_runs(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of fewer words, the one of all; of none, nothing."""
    if not words:
        return np.zeros(0, np.uint64)
    found = []
    for at in range(0, max(1, len(words) - width + 1), BLOCK):
        raw = np.frombuffer(b" ".join(words[at:at + BLOCK + width - 1]), np.uint8)
        gaps = np.flatnonzero(raw == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
        k = min(width, len(starts))
        found.append(between(running(raw), starts[:len(starts) - k + 1], ends[k - 1:]))
    return np.unique(np.concatenate(found))
