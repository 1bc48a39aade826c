"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 20), b, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and where each text's words begin and end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[1], space.view(np.int8)]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(start) and len(end) and end[0] < start[0]:
        end = end[1:]
    p, q = powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum((_LOWER[data].astype(U) + U(1)) * p, out=total[1:])
    h = mix((total[end] - total[start]) * q[start] + (end - start).astype(U))
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return h, np.searchsorted(start, begins)


def hashed_words(text: bytes, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends, and its hash as it is written; about ``block`` bytes are looked at in one go."""
    data = np.frombuffer(text, np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    h = np.zeros(len(start), U)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + block, "right"))
        if j <= i:  # a word longer than a block
            h[i] = int.from_bytes(blake2b(text[start[i] : end[i]], digest_size=8).digest(), "little")
            i += 1
            continue
        some = data[start[i] : end[j - 1]]
        p, q = powers(len(some))
        total = np.zeros(len(some) + 1, U)
        np.cumsum((some.astype(U) + U(1)) * p, out=total[1:])
        a, z = start[i:j] - start[i], end[i:j] - start[i]
        h[i:j] = mix((total[z] - total[a]) * q[a] + (z - a).astype(U))
        i = j
    return start, end, h


def shingle_sets(texts: list[bytes], n: int = 5) -> Iterator[np.ndarray]:
    """Each text's distinct n-word shingles, sorted; fewer words make one shingle."""
    h, at = word_hashes(texts)
    if len(h) >= n:
        g = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            g = mix(g * U(0xD1342543DE82EF95) + h[k : len(h) - n + 1 + k])
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        elif b > a:
            one = np.array([b - a], U)
            for k in range(a, b):
                one = mix(one * U(0xD1342543DE82EF95) + h[k])
            yield one
        else:
            yield np.zeros(0, U)


def slices(column: Iterable, limit: int = 1 << 20, pairs: bool = False) -> Iterator[tuple[int, list[bytes]]]:
    """Encoded texts of an Arrow column in runs of about ``limit`` bytes, with where each run begins; pairs stay together."""
    held, size, first = [], 0, 0
    for i, t in enumerate(column):
        t = (t.as_py() if isinstance(t, pa.Scalar) else t) or ""
        held.append(t.encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 1
        if size >= limit and not (pairs and len(held) % 2):
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held
