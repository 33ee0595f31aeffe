"""Cost of kernel evaluations, on the driver; never part of a query."""

from __future__ import annotations

import math
import time

import numpy as np

_rates: dict[int, float] = {}


def ordered_tuples(n: int, r: int) -> int:
    """Ordered tuples of r distinct elements of n."""
    return math.factorial(r) * math.comb(n, r) if 0 < r <= n else 0


def kernel_pairs(n: int, m: int, r: int) -> int:
    """Pairs of the inner product of sets of n and m elements: ordered tuples against combinations."""
    return ordered_tuples(n, r) * math.comb(m, r)


def guard(pairs: int, most: int = 10**12) -> int:
    """The pairs, or an error where a plan would make more than it should."""
    if pairs > most:
        raise ValueError(f"{pairs} kernel pairs are beyond the limit of {most}")
    return pairs


def estimate_comp_time(n_pairs: float, dim: int, label: str = "", verbose: bool = True) -> float:
    """Seconds of one core for so many pairs, by a rate measured once for each dimension."""
    if dim not in _rates:
        rng, n = np.random.default_rng(42), 1000
        u, v, w = rng.standard_normal((dim, n)), rng.standard_normal((dim, n)), rng.standard_normal(n)

        def once() -> float:
            began = time.perf_counter()
            w @ np.exp(-((u[:, :, None] - v[:, None, :]) ** 2).sum(axis=0))
            return time.perf_counter() - began

        once()
        _rates[dim] = n * n / max(once(), 1e-12)
    seconds = float(n_pairs) / _rates[dim]
    if verbose and label:
        for most, unit, scale in ((1, "ms", 1e-3), (60, "s", 1), (3600, "min", 60), (math.inf, "h", 3600)):
            if seconds < most:
                print(f"{label}: about {seconds / scale:.3g} {unit}")
                break
    return seconds
