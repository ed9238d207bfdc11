"""Exact hypergeometric draws of any size, for the driver."""

from __future__ import annotations

import numpy as np

#: numpy's sampler takes populations below this; larger ones are drawn by inversion.
NUMPY_MOST = 10**9


def _log_factorial(x: np.ndarray) -> np.ndarray:
    """log(x!) by Stirling's series, exact to double precision, with a table below 32."""
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 32)))])
    y = np.maximum(x, 32).astype(np.float64)
    series = y * np.log(y) - y + 0.5 * np.log(2 * np.pi * y) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 32, table[np.minimum(x, 31).astype(np.int64)], series)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` draws without replacement are among the ``good``."""
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(sample, good)
    if low == high:
        return low
    share = good / (good + bad)
    spread = int(16 * np.sqrt(sample * share * (1 - share) + 1)) + 16
    centre = int(sample * share)
    k = np.arange(max(low, centre - spread), min(high, centre + spread) + 1, dtype=np.int64)
    logs = -(_log_factorial(k) + _log_factorial(good - k) + _log_factorial(sample - k) + _log_factorial(bad - sample + k))
    total = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(total, rng.random() * total[-1])])


def split(rng: np.random.Generator, colours: list[int], sample: int) -> list[int]:
    """Multivariate hypergeometric draw: how many of ``sample`` have each colour."""
    out, rest, left = [], sum(colours), sample
    for c in colours:
        rest -= c
        out.append(hypergeometric(rng, c, rest, left) if left and c else 0)
        left -= out[-1]
    return out


def even(total: int, parts: int) -> list[int]:
    """``total`` dealt over ``parts``, at most one apart."""
    return [total // parts + (i < total % parts) for i in range(parts)]
