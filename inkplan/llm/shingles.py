"""Hashes of words and of runs of words, the same in every process and at every size."""

from __future__ import annotations

import numpy as np
import xxhash

_WORD = xxhash.xxh3_64_intdigest


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORD, words), np.uint64, len(words))


def shingle_set(words: list[bytes], k: int = 5, weights: np.ndarray = odd(64, 5)) -> np.ndarray:
    """Sorted distinct hashes of the k-word runs; of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = len(h) - k + 1
    if n < 1:
        return mix((h * weights[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    total = h[:n] * weights[0]
    for i in range(1, k):
        total += h[i : n + i] * weights[i]
    return np.unique(mix(total))


def lower_words(text: str) -> list[bytes]:
    """A-Z in lower case; words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()
