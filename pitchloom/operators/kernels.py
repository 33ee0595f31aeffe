"""Inner products of expectation tensors in numpy, many rows at once."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ..model import TensorParams

#: Kernels held at once.
BLOCK = 1 << 20
#: From so many kernels of a row on, equal differences of a relative tensor are merged before they meet.
MERGE_FROM = 100_000
#: Decimals to which differences are rounded when they are merged.
MERGED_TO = 9


@dataclass(frozen=True)
class Ragged:
    """Elements of many sets one after the other; set i has those from start[i], size[i] of them."""

    p: np.ndarray
    w: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, column: pa.ListArray) -> Ragged:
        offsets, elems = column.offsets.to_numpy(), column.values
        return cls(elems.field("p").to_numpy(zero_copy_only=False), elems.field("w").to_numpy(zero_copy_only=False), offsets[:-1].astype(np.int64), np.diff(offsets))

    def take(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        where = self.start[at][:, None] + np.arange(n)
        return self.p[where], self.w[where]


@dataclass(frozen=True)
class Literal:
    """One set, the same for every row."""

    p: np.ndarray
    w: np.ndarray

    def repeated(self, rows: int) -> Ragged:
        return Ragged(self.p, self.w, np.zeros(rows, np.int64), np.full(rows, len(self.p)))


@lru_cache(64)
def places(n: int, r: int, ordered: bool) -> np.ndarray:
    """(tuples, r): places of all ordered tuples of distinct elements, or of those that ascend."""
    if r == 1:
        return np.arange(n)[:, None]
    choose = itertools.permutations if ordered else itertools.combinations
    return np.array(list(choose(range(n), r)), np.int32).reshape(-1, r)


def wrapped(d: np.ndarray, t: TensorParams) -> np.ndarray:
    """The nearest periodic image of a difference."""
    return d - t.period * np.round(d / t.period) if t.periodic else d


def form(u: np.ndarray, v: np.ndarray, t: TensorParams) -> np.ndarray:
    """(rows, tuples of u, tuples of v): the quadratic form of the differences of every two tuples (last axis: places)."""
    difference = lambda i: u[:, :, None, i] - v[:, None, :, i]
    if t.relative and t.periodic:
        pairs = itertools.combinations(range(t.r), 2)
        return sum(wrapped((u[..., i] - u[..., j])[:, :, None] - (v[..., i] - v[..., j])[:, None, :], t) ** 2 for i, j in pairs) / t.r
    d = [wrapped(difference(i), t) for i in range(t.r)]
    squares = sum(x * x for x in d)
    return squares - sum(d) ** 2 / t.r if t.relative else squares


def summed(u: np.ndarray, a: np.ndarray, v: np.ndarray, b: np.ndarray, t: TensorParams) -> np.ndarray:
    """For each row, the sum of a b exp(-form / 4 sigma^2), in blocks of tuples of u."""
    out = np.zeros(len(u))
    step = max(1, BLOCK // max(1, len(u) * v.shape[1]))
    for at in range(0, u.shape[1], step):
        kernel = np.exp(-form(u[:, at : at + step], v, t) / (4 * t.sigma**2))
        out += np.einsum("rp,rp->r", a[:, at : at + step], np.einsum("rpc,rc->rp", kernel, b))
    return out


def merged(p: np.ndarray, w: np.ndarray, t: TensorParams, ordered: bool) -> tuple[np.ndarray, np.ndarray]:
    """Tuples of one set moved to u1 = 0, reduced and rounded, each distinct one once with the sum of its weights."""
    at = places(len(p), t.r, ordered)
    c = p[at] - p[at[:, :1]]
    c = np.round(np.mod(c, t.period) if t.periodic else c, MERGED_TO)
    distinct, back = np.unique(c, axis=0, return_inverse=True)
    return distinct, np.bincount(back.ravel(), weights=w[at].prod(axis=1), minlength=len(distinct))


def by_size(a: Ragged, b: Ragged) -> Iterator[tuple[np.ndarray, int, int]]:
    """Rows of equal sizes, with the sizes."""
    sizes = a.size.astype(np.int64) << 32 | b.size.astype(np.int64)
    for size in np.unique(sizes).tolist():
        yield np.flatnonzero(sizes == size), size >> 32, size & 0xFFFFFFFF


def inner(a: Ragged, b: Ragged, t: TensorParams) -> np.ndarray:
    """For each row, ordered tuples of a set against ascending ones of another; NaN where either has fewer than r."""
    out = np.full(len(a.size), np.nan)
    for rows, n, m in by_size(a, b):
        if min(n, m) < t.r:
            continue
        if t.relative and _count(n, t.r) * _count(m, t.r) >= MERGE_FROM:
            for i in rows.tolist():
                one = np.array([i])
                (p, w), (q, x) = a.take(one, n), b.take(one, m)
                (u, y), (v, z) = merged(p[0], w[0], t, True), merged(q[0], x[0], t, False)
                out[i] = summed(u[None], y[None], v[None], z[None], t)[0]
            continue
        us, vs = places(n, t.r, True), places(m, t.r, False)
        step = max(1, BLOCK // (len(us) * len(vs)))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            (p, w), (q, x) = a.take(own, n), b.take(own, m)
            out[own] = summed(p[:, us], w[:, us].prod(axis=-1), q[:, vs], x[:, vs].prod(axis=-1), t)
    return out


def _count(n: int, r: int) -> int:
    """Ordered tuples of r of n elements."""
    total = 1
    for k in range(r):
        total *= n - k
    return total


def smoothed_sums(start: np.ndarray, steps: np.ndarray, count: np.ndarray, kernel: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """For each set, the sums of v and of v log v over all len(kernel)^size bins of its histogram smoothed round the cycle.

    Set i has the tuples (rows of steps, with their counts) from start[i] to start[i + 1], at least one. No more than
    about ``block`` products are held at once: those of many sets, or of one set and some of the bins.
    """
    n, size = len(kernel), steps.shape[1]
    bins, around = n**size, np.r_[kernel, kernel]
    total, moment = np.zeros(len(start) - 1), np.zeros(len(start) - 1)
    at = 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(start, start[at] + block // bins, side="right")) - 1)
        own, c = steps[start[at] : start[end]], count[start[at] : start[end], None].astype(np.float64)
        width = min(bins, max(1, block // len(own)))
        for lo in range(0, bins, width):
            value = c
            for i, place in enumerate(np.unravel_index(np.arange(lo, min(bins, lo + width)), (n,) * size)):
                value = value * around[place[None, :] - own[:, i, None] + n]
            v = np.add.reduceat(value, start[at:end] - start[at], axis=0)
            total[at:end] += v.sum(axis=1)
            moment[at:end] += (v * np.log(np.where(v > 0, v, 1.0))).sum(axis=1)
        at = end
    return total, moment
