"""Hashes of words and word shingles, over a whole slice of texts at once.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z is lower-cased. A word's hash is a
tabulated polynomial over its bytes modulo 2^64, taken from prefix sums, so no
word becomes a Python object; a shingle's combines those of its words. Both
are 64 bits; equal texts have equal hashes on every machine.
"""

from __future__ import annotations

import numpy as np

from quintet.llm import common

U = np.uint64
MASK = (1 << 64) - 1


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values from a seed."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = stream(1, 256)
BASE = 0xD6E8FEB86659FD93
BACK = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, BACK)):
            steps = np.full(max(n, 1 << 20), base, U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def hashes_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """Hashes of the words at these places, about at_once bytes at a time; a longer word is taken whole."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + at_once)))
        first = starts[i]
        s, e = starts[i:j] - first, ends[i:j] - first
        up, down = powers(int(e[-1]) + 1)
        sums = np.zeros(len(up), U)
        np.cumsum(BYTE[raw[first : ends[j - 1]]] * up[:-1], out=sums[1:])
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
        i = j
    return out


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's first index among them (one more at the end)."""
    whole = b" ".join([t or b"" for t in texts] + [b""])
    raw = np.frombuffer(whole.translate(common.LOWER), np.uint8)
    inside = np.concatenate([[False], ~SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    hashes = hashes_of(raw, starts, ends)
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    return hashes, np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))


def sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, ascending; a text of fewer words, but not none, is one shingle."""
    hashes, first = words(texts)
    weights = stream(2, width) | U(1)
    n = len(hashes)
    if n >= width:
        joined = np.zeros(n - width + 1, U)
        for k in range(width):
            joined += hashes[k : n - width + 1 + k] * weights[k]
        joined = mix(joined)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            s = np.sort(joined[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix(np.array([sum(int(h) * int(w) for h, w in zip(hashes[a:b], weights, strict=False)) + int(b - a) & MASK], U)))
        else:
            out.append(np.zeros(0, U))
    return out
