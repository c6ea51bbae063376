"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from skein.llm.wordcache import WordCache

WORDS = 5
CACHE_WORDS = 200_000
_MIX, _MUL = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
_S31, _S29 = np.uint64(31), np.uint64(29)


@lru_cache(maxsize=1)
def _hashes() -> WordCache:
    return WordCache(lambda w: int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"), CACHE_WORDS)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S31)) * _MIX
    return x ^ (x >> _S29)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))


def shingles(words: list[str] | np.ndarray, size: int = WORDS) -> np.ndarray:
    """A hash for each run of ``size`` words (or hashes of words); one for all of fewer words; none for no words."""
    if not len(words):
        return np.empty(0, np.uint64)
    h = words if isinstance(words, np.ndarray) else word_hashes(words)
    size = min(size, len(words))
    n = len(words) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = out * _MUL + h[k : k + n]
    return mix(out + np.uint64(size))


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Equal hashes made different by how many of them came before."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return mix(hashes)
    at = np.arange(len(hashes))
    starts = np.maximum.accumulate(np.where(np.r_[True, ~same], at, 0))
    out = np.empty_like(hashes)
    out[order] = mix(ordered + (at - starts).astype(np.uint64) * _MUL)
    return out


def family(count: int, seed: int) -> np.ndarray:
    """Odd multipliers of ``count`` hash functions."""
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
