"""Brute-force forms in numpy, from the definitions."""

import itertools
import math

import numpy as np


def wrap(d, period):
    return np.mod(d + period / 2, period) - period / 2


def form(d, r, rel, per, period):
    d = np.asarray(d, float)
    if rel and per:
        return sum(wrap(d[i] - d[j], period) ** 2 for i in range(r) for j in range(i + 1, r)) / r
    d = wrap(d, period) if per else d
    return (d**2).sum() - (d.sum() ** 2 / r if rel else 0)


def inner(a, wa, b, wb, sigma, r, rel, per, period):
    total = 0.0
    for i in itertools.permutations(range(len(a)), r):
        for j in itertools.combinations(range(len(b)), r):
            w = np.prod([wa[x] for x in i]) * np.prod([wb[x] for x in j])
            total += w * math.exp(-form([a[x] - b[y] for x, y in zip(i, j)], r, rel, per, period) / (4 * sigma**2))
    return total


def cosine(a, wa, b, wb, *t):
    return inner(a, wa, b, wb, *t) / math.sqrt(inner(a, wa, a, wa, *t) * inner(b, wb, b, wb, *t))


def coherence(p, n, strict=True):
    p, k = sorted(p), len(p)
    size = {(g, i): (p[(i + g) % k] - p[i]) % n for g in range(1, k) for i in range(k)}
    bad = sum((size[h, j] <= size[g, i]) if strict else (size[h, j] < size[g, i]) for (g, i) in size for (h, j) in size if g < h)
    return bad


def apm(s, n, decay=0.0):
    out = np.zeros((n, n))
    for lag, phase, m in itertools.product(range(n), repeat=3):
        a, b = lag * m + phase, lag * (m + 1) + phase
        out[lag, phase] += s[a % n] * math.exp(-decay * a) * s[b % n] * math.exp(-decay * b)
    return out
