"""64-bit hashes of many segments of one flat array at once (numpy)."""

from __future__ import annotations

import numpy as np

_SEED = np.uint64(0xD1342543DE82EF95)
_KEPT = 1 << 16
_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _made(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _SEED)


def place_keys(places: np.ndarray) -> np.ndarray:
    """A fixed random key for each place in a segment."""
    if "keys" not in _cache:
        _cache["keys"] = _made(_KEPT)
    if places.max(initial=0) < _KEPT:
        return _cache["keys"][places]
    return mix((places.astype(np.uint64) + np.uint64(1)) * _SEED)


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` (uint64) for each non-empty segment, wherever it stands.

    Each value is mixed with its place's key before the sum, so no power of one number
    is behind it: words that any polynomial modulo 2^64 confuses differ here.  Two
    different segments agree by chance once in 2^64.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    inside = values[place + np.repeat(starts, sizes)]
    return mix(np.add.reduceat(mix(inside ^ place_keys(place)), first) + sizes.astype(np.uint64))
