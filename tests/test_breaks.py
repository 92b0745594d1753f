"""Pruned change points against the full programme."""

import tracemalloc

import numpy as np
import pytest

from flockwise.operators import breaks


def full(y, penalty=1.0, least=2):
    """Every segment's cost from the kernel's matrix, every start tried."""
    n = len(y)
    d = (y[:, None] - y[None]) ** 2
    scale = np.median(d[d > 0]) if (d > 0).any() else 1.0
    k = np.exp(-np.clip(d / scale, 0.01, 100))
    s = np.zeros((n + 1, n + 1))
    s[1:, 1:] = k.cumsum(0).cumsum(1)
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for b in range(least, n + 1):
        a = np.arange(b - least + 1)
        total = best[a] + (b - a) - (s[b, b] - s[a, b] - s[b, a] + s[a, a]) / (b - a) + penalty
        best[b], back[b] = total.min(), total.argmin()
    out, b = [], n
    while n and back[b] > 0:
        b = back[b]
        out.append(int(b))
    return out[::-1], best[n]


def cost(y, starts, penalty):
    d = (y[:, None] - y[None]) ** 2
    k = np.exp(-np.clip(d / (np.median(d[d > 0]) if (d > 0).any() else 1.0), 0.01, 100))
    edges = [0, *starts, len(y)]
    return sum((b - a) - k[a:b, a:b].sum() / (b - a) for a, b in zip(edges, edges[1:])) + penalty * len(starts)


@pytest.mark.parametrize("least,penalty", [(2, 1.0), (1, 0.2), (5, 0.5)])
def test_breaks_equal_the_full_programme(least, penalty):
    rng = np.random.default_rng(least)
    some = 0
    for n in (0, 1, 2, 3, 10, 40, 200):
        for kind in range(6):
            y = rng.normal(0, 1, n) + (np.arange(n) // max(1, n // (kind + 1))) * kind
            y = np.round(y, 1) if kind % 2 else y
            got = breaks.change_points(y, penalty, least)
            want, total = full(y, penalty, least)
            assert cost(y, got, penalty) == pytest.approx(total, abs=1e-9) if n >= least else got == [], (n, kind)
            assert got == want or kind % 2, (n, kind)  # rounded values have equal totals
            some += len(got)
    assert some > 20


def test_bandwidth_is_the_median_of_distances():
    rng = np.random.default_rng(3)
    for y in (rng.normal(0, 1, 7), rng.normal(0, 1, 60), np.round(rng.normal(0, 1, 51), 1), np.array([1.0, 1.0, 2.0]), np.array([5.0]), np.zeros(4)):
        d = (y[:, None] - y[None]) ** 2
        assert breaks.bandwidth(y) == (np.median(d[d > 0]) if (d > 0).any() else 1.0)


def test_a_long_series_takes_linear_memory():
    rng = np.random.default_rng(4)
    y = np.repeat(rng.permutation(1000) % 7 * 10.0, 100) + rng.normal(0, 0.1, 100_000)
    levels = np.flatnonzero(np.abs(np.diff(y)) > 5) + 1
    assert breaks.change_points(y) == levels.tolist()
    y = y[:10_000]
    tracemalloc.start()
    breaks.change_points(y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * y.nbytes
