"""Sets of hashed word shingles, computed on whole batches of texts at once."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
ROLL = 0xD6E8FEB86659FD93
CHUNK_BYTES = 500_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.cumprod(out, dtype="u8")


def _sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", "u1")
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype("u1")
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype("i1")))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum((data.astype("u8") + np.uint64(1)) * _powers(BASE, len(data)), dtype="u8")])
    word = mixed((sums[ends] - sums[starts]) * _powers(INVERSE, len(data))[starts] + (ends - starts).astype("u8") * np.uint64(ROLL))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, bounds)
    rolled = np.zeros(max(len(word) - words + 1, 0), "u8")
    for k in range(words):
        rolled = rolled * np.uint64(ROLL) + word[k : k + len(rolled)]
    rolled = mixed(rolled)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        n = high - low
        if n >= words:
            found = np.sort(rolled[low : high - words + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif n:
            h = np.uint64(n)
            for w in word[low:high]:
                h = h * np.uint64(ROLL) + w
            out.append(mixed(np.array([h], "u8")))
        else:
            out.append(np.zeros(0, "u8"))
    return out


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of ``words`` words, A-Z in lower case.

    Words are what stands between spaces and the bytes 9 to 13. A text of fewer words has its whole
    sequence as one shingle; a text without words has none.
    """
    out: list[np.ndarray] = []
    some: list[bytes] = []
    size = 0
    with np.errstate(over="ignore"):
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            if some and size + len(data) > CHUNK_BYTES:
                out += _sets(some, words)
                some, size = [], 0
            some.append(data)
            size += len(data) + 1
        if some:
            out += _sets(some, words)
    return out
