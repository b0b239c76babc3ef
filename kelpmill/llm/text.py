"""Words, hashes and Arrow helpers shared by the operators of this folder."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"[^\W_]+")  # a longest run of letters and digits

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer: a 64-bit bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class WordHashes:
    """64-bit hashes of words, the same in every process; remembers up to `most` words."""

    def __init__(self, most: int = 200_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        for w in set(tokens):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word sequences of a text, in order."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * _GOLD + h[k : len(h) - n + 1 + k])
    return out


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((h >> _U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def batch(names: list[str], columns: list, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=names)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
