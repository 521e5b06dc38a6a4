"""MinHash signatures and banding with a recall that is tuned on the collision curve.  Vectorised in NumPy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


def collision(j: float, bands: int, rows: int) -> float:
    """The chance that two sets of Jaccard similarity ``j`` share at least one band."""
    return 1.0 - (1.0 - j**rows) ** bands


def tune_bands(j: float, recall: float, max_hashes: int = 256) -> tuple[int, int]:
    """(bands, rows): the most selective banding that still finds pairs of similarity ``j`` with ``recall``."""
    best: tuple[float, int, int] | None = None
    for rows in range(1, 17):
        bands = 1
        while bands * rows <= max_hashes and collision(j, bands, rows) < recall:
            bands += 1
        if bands * rows > max_hashes:
            continue
        noise = sum(collision(x / 20, bands, rows) for x in range(1, int(j * 20 * 0.75) + 1))  # dissimilar pairs met
        if best is None or noise < best[0]:
            best = (noise, bands, rows)
    if best is None:
        raise ValueError(f"a recall of {recall} at similarity {j} needs more than {max_hashes} hashes")
    return best[1], best[2]


@lru_cache(maxsize=8)
def _family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**63, n, dtype=np.uint64)
    return a, b


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def band_keys(tokens: np.ndarray, offsets: np.ndarray, bands: int, rows: int, salt: np.ndarray, seed: int = 7) -> np.ndarray:
    """Keys (sets x bands) of sets of 64-bit tokens laid end to end; no set may be empty.  ``salt`` (one word a set) keeps blocks apart."""
    a, b = _family(bands * rows, seed)
    out = np.empty((len(offsets) - 1, bands), dtype=np.int64)
    t = mix64(tokens)
    starts = offsets[:-1]
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = salt ^ (np.uint64(band + 1) * _MIX)
            for r in range(rows):
                k = band * rows + r
                low = np.minimum.reduceat((t * a[k] + b[k]) >> np.uint64(16), starts)
                key = mix64(key ^ low)
            out[:, band] = key.view(np.int64)
    return out


def tune_paired_bands(product: float, recall: float, max_bands: int = 256) -> int:
    """How many bands of one hash of either part find a pair whose part similarities multiply to ``product``."""
    for bands in range(1, max_bands + 1):
        if collision(product, bands, 1) >= recall:
            return bands
    raise ValueError(f"a recall of {recall} at {product} needs more than {max_bands} bands")


def paired_band_keys(tokens: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, bands: int, salt: np.ndarray, seed: int = 7, ordered: bool = True) -> np.ndarray:
    """Keys (records x bands) of records with two parts, each a set of ``tokens``/``offsets`` (by its number in
    ``first`` and ``second``).  A band is one MinHash of the first part with one of the second; unless ``ordered``, both by
    one hash function and in either order."""
    a, b = _family(2 * bands, seed)
    t = mix64(tokens)
    starts = offsets[:-1]
    out = np.empty((len(first), bands), dtype=np.int64)
    with np.errstate(over="ignore"):
        for k in range(bands):
            one = np.minimum.reduceat((t * a[2 * k] + b[2 * k]) >> np.uint64(16), starts)
            key = mix64(salt ^ (np.uint64(k + 1) * _MIX))
            if ordered:
                two = np.minimum.reduceat((t * a[2 * k + 1] + b[2 * k + 1]) >> np.uint64(16), starts)
                low, high = one[first], two[second]
            else:
                low, high = np.minimum(one[first], one[second]), np.maximum(one[first], one[second])
            out[:, k] = mix64(mix64(key ^ low) ^ high).view(np.int64)
    return out
