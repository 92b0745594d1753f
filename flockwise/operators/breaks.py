"""Change points of a series by the penalised programme with a Gaussian kernel: exact, pruned, in memory linear in the series."""

from __future__ import annotations

import numpy as np

#: Distances are cut to these multiples of the bandwidth.
NEAR, FAR = 0.01, 100.0


def _up_to(y: np.ndarray, limit: float) -> np.ndarray:
    """Of sorted values: how many from each one on are within a squared distance of it, by bisection on the distances themselves."""
    low, high = np.arange(len(y)), np.full(len(y), len(y))
    while (high - low > 1).any():
        middle = (low + high) // 2
        ok = (y[np.minimum(middle, len(y) - 1)] - y) ** 2 <= limit
        low, high = np.where(ok, middle, low), np.where(ok, high, middle)
    return low - np.arange(len(y))


def bandwidth(y: np.ndarray) -> float:
    """The median of all squared distances above 0 (1 without any). Pairs are counted, not listed: the bits of a distance are bisected."""
    y = np.sort(np.asarray(y, float))
    if len(y) < 2 or y[0] == y[-1]:
        return 1.0
    none = int(_up_to(y, 0.0).sum())
    pairs = len(y) * (len(y) - 1) // 2 - none
    if pairs <= 0:
        return 1.0

    def ranked(k: int) -> float:
        """The k-th smallest (from 1) of the distances above 0."""
        low, high = 0, int(np.float64((y[-1] - y[0]) ** 2).view(np.int64))
        while high - low > 1:
            middle = (low + high) // 2
            if int(_up_to(y, float(np.int64(middle).view(np.float64))).sum()) - none >= k:
                high = middle
            else:
                low = middle
        return float(np.int64(high).view(np.float64))

    # all pairs are there in both orders, so the middle of twice their number
    a, b = ranked((pairs + 1) // 2), ranked(pairs // 2 + 1)
    return float(np.mean([a, b]))


def change_points(y: np.ndarray, penalty: float = 1.0, least: int = 2) -> list[int]:
    """Starts of the segments after the first, of least total cost plus `penalty` a change; segments have at least `least` values.

    A segment costs its length less its kernel's sum over its length. The sums of all segments that end here grow by the kernel's row
    of the new value, so no matrix is kept. A start whose cost up to here is above the best total can't be better later either, as
    two parts of a segment cost no more than the whole; it is dropped once a segment of `least` values could stand in between. Of
    equal totals the earliest start wins."""
    y = np.asarray(y, float)
    n, scale = len(y), bandwidth(y)
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    best[0] = -penalty
    start, sums = np.zeros(0, np.int64), np.zeros(0)
    gone = np.zeros(0, np.int64)  # from which end on a start is out
    for b in range(1, n + 1):
        if np.isfinite(best[b - 1]):
            start, sums, gone = np.append(start, b - 1), np.append(sums, 0.0), np.append(gone, n + 1)
        first = int(start[0])
        row = np.exp(-np.clip((y[first:b] - y[b - 1]) ** 2 / scale, NEAR, FAR))
        tail = np.cumsum(row[::-1])[::-1]  # the new value with all from a start on
        sums += 2 * tail[start - first] - row[-1]
        size = b - start
        cost = size - sums / size
        ready = np.flatnonzero(size >= least)
        if not len(ready):
            continue
        total = best[start[ready]] + cost[ready] + penalty
        k = int(total.argmin())
        best[b], back[b] = total[k], start[ready[k]]
        late = total - penalty > best[b] + 1e-9
        gone[ready[late]] = np.minimum(gone[ready[late]], b + least)
        keep = gone > b + 1
        if not keep.all():
            start, sums, gone = start[keep], sums[keep], gone[keep]
    out, b = [], n
    while n and back[b] > 0:
        b = int(back[b])
        out.append(b)
    return out[::-1]
