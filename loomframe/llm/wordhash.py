"""Hashes of words and of shingles of words, for all the texts of a batch at once.

A word is a maximal run of bytes that are neither space nor one of the five ASCII controls from tab to carriage
return; A to Z count as a to z. Its hash is a polynomial in an odd base over its bytes modulo 2 ** 64, read off
prefix sums and mixed; shingle hashes mix the hashes of their words in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text, or of a long text, that are hashed at a time: as many as the least table of powers is for.
STEP = (1 << 20) - 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse ** i, modulo 2 ** 64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.ones(n, np.uint64)
        filled = 1
        step = np.uint64(base)
        while filled < n:
            more = min(filled, n - filled)
            with np.errstate(over="ignore"):
                p[filled : filled + more] = p[:more] * step
                step = step * step
            filled += more
        out.append(p)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, (n - 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends (in bytes) of the words of all texts, and the number of the first word of each text (length n + 1)."""
    gap = _GAP[data]
    start = ~gap
    start[1:] &= gap[:-1]
    bound = offsets[:-1]
    bound = bound[bound < len(data)]
    start[bound] = ~gap[bound]
    end = ~gap
    end[:-1] &= gap[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    end[last] = ~gap[last]
    begins, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return begins, ends, np.searchsorted(begins, offsets, "left")


def _polynomials(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        return (total[ends] - total[begins]) * down[begins]


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(_polynomials(data, begins, ends))


def word_stream(data: np.ndarray, step: int = STEP) -> Iterator[np.ndarray]:
    """Hashes of the words of one long text, as word_hashes gives them, read `step` bytes at a time; a word may be longer than a step."""
    open_sum = open_len = 0  # a word that has not ended yet
    for at in range(0, len(data), step):
        part = data[at : at + step]
        begins, ends, _ = words(part, np.array([0, len(part)]))
        sums = _polynomials(part, begins, ends)
        goes_on = bool(open_len) and len(begins) > 0 and begins[0] == 0
        if goes_on:
            sums[0] = np.uint64((open_sum + pow(BASE, open_len, 1 << 64) * int(sums[0])) % (1 << 64))
        elif open_len:
            sums = np.concatenate([np.array([open_sum], np.uint64), sums])
        before, open_len = open_len, 0
        if len(begins) and ends[-1] == len(part) and at + step < len(data):
            open_sum, open_len = int(sums[-1]), int(ends[-1] - begins[-1]) + (before if goes_on and len(begins) == 1 else 0)
            sums = sums[:-1]
        yield mix(sums)
    if open_len:
        yield mix(np.array([open_sum], np.uint64))


def long_shingles(data: np.ndarray, width: int, step: int = STEP) -> np.ndarray:
    """The sorted distinct shingle hashes of one long text; nothing but them grows with it."""
    held, out, total = np.zeros(0, np.uint64), [np.zeros(0, np.uint64)], 0
    for word in word_stream(data, step):
        total += len(word)
        held = np.concatenate([held, word])
        if len(held) >= width:
            out.append(np.unique(shingle_hashes(held, np.array([0, len(held)]), width)[0]))
            held = held[len(held) - width + 1 :]
    if 0 < total < width:
        out.append(shingle_hashes(held, np.array([0, total]), width)[0])
    return np.unique(np.concatenate(out))


def shingle_hashes(word: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles in order (one of the whole sequence where it has fewer words), and their offsets."""
    count = np.diff(first)
    shingles = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(shingles)])
    text = np.repeat(np.arange(len(count)), shingles)
    at = first[:-1][text] + np.arange(int(off[-1])) - off[:-1][text]
    length = np.minimum(count, width)[text]
    out = mix(length.astype(np.uint64))
    with np.errstate(over="ignore"):
        for k in range(width):
            there = length > k
            if there.all():
                out = mix(out * np.uint64(3) + word[at + k])
            else:
                out[there] = mix(out[there] * np.uint64(3) + word[at[there] + k])
    return out, off
