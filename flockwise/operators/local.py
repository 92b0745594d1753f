"""What a task does with the points of one group, in memory linear in them: density clusters, and numbers of neighbours."""

from __future__ import annotations

import numpy as np

#: Points that look around, and pairs of points that are looked at, in one go.
BLOCK, PAIRS = 1 << 14, 1 << 20
#: Pairs of points below which two parts of cells are compared whole.
LEAF = 1 << 13
#: Pairs of points of a cell and of those that the radius may cut, which the cells' width aims at.
RING = 1 << 17


def ring(d, world):
    """Least displacement on a ring of length `world`, as `space.shift`."""
    return d if world is None else np.where(d > world / 2, d - world, np.where(d < -world / 2, d + world, d))


def runs(start, count):
    """start[0], start[0] + 1, ... count[0] of them, start[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


def merged(n, a, b):
    """Of each of n nodes the least one that links (a, b) lead to."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if (apart := la != lb).any():
            la, lb, a, b = la[apart], lb[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while ((jump := label[label]) != label).any():
                label = jump
        else:
            return label


def clusters(x, y, grid, world, inclusive):
    """For each choice (eps, least) the place of each point's label; the number of points for noise. Points are in the order of ids."""
    n = len(x)
    sound = np.flatnonzero(np.isfinite(x) & np.isfinite(y))  # others are alone
    for eps, least in grid:
        label = np.arange(n) if least <= 1 else np.full(n, n)
        got = _clusters(x[sound], y[sound], eps, least, world, inclusive) if len(sound) else sound
        label[sound] = np.append(sound, n)[got]
        yield label


class Cells:
    """Points in square cells whose diagonal is below the radius: those of a cell are all within it."""

    def __init__(self, x, y, eps, world):
        at = [c if world is None else np.mod(c, world) for c in (x, y)]
        wide = max(np.abs(c).max() for c in at)
        side = eps / np.sqrt(2) * (1 - 1e-9) / (1 + 4e-16 * wide / eps)
        self.around = None
        if world is not None:
            self.around = int(np.ceil(world / side))
            side = world / self.around
        c = [np.floor(v / side).astype(np.int64) for v in at]
        if world is not None:
            c = [np.minimum(v, self.around - 1) for v in c]
        self.at, self.world = at, world
        (self.ux, cx), (self.uy, cy) = (np.unique(v, return_inverse=True) for v in c)
        key = cx * len(self.uy) + cy
        self.order = np.argsort(key, kind="stable")
        self.keys, self.of, self.count = np.unique(key, return_inverse=True, return_counts=True)
        self.start = np.cumsum(self.count) - self.count
        self.x, self.y = self.ux[self.keys // len(self.uy)], self.uy[self.keys % len(self.uy)]

    def near(self, cells):
        """(place among `cells`, other cell) of all cells up to two away, each once, and the cell itself."""
        offsets = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]
        if self.around is not None and self.around < 5:
            offsets = sorted({(a % self.around, b % self.around) for a, b in offsets})
        a, b = (np.array(o, np.int64) for o in zip(*offsets))
        tx, ty = (self.x[cells][:, None] + a).ravel(), (self.y[cells][:, None] + b).ravel()
        if self.around is not None:
            tx, ty = tx % self.around, ty % self.around
        ix, iy = (np.minimum(np.searchsorted(u, t), len(u) - 1) for u, t in ((self.ux, tx), (self.uy, ty)))
        key = ix * len(self.uy) + iy
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = (self.ux[ix] == tx) & (self.uy[iy] == ty) & (self.keys[found] == key)
        return np.flatnonzero(there) // len(offsets), found[there]


def gap(a, b, world):
    """Least and greatest distances between points of boxes (x0, x1, y0, y1)."""
    low, high = 0.0, 0.0
    for k in (0, 2):
        lo, hi = b[k] - a[k + 1], b[k + 1] - a[k]
        near, far = np.maximum(np.maximum(lo, -hi), 0.0), np.maximum(np.abs(lo), np.abs(hi))
        for w in () if world is None else (-world, world):
            near = np.minimum(near, np.maximum(np.maximum(lo + w, -hi - w), 0.0))
            far = np.minimum(far, np.maximum(np.abs(lo + w), np.abs(hi + w)))
        low, high = low + near * near, high + far * far
    return np.sqrt(low), np.sqrt(high)


def _clusters(x, y, eps, least, world, inclusive):
    n, g = len(x), Cells(x, y, eps, world)
    within = (lambda d: d <= eps) if inclusive else (lambda d: d < eps)
    below, above = eps * (1 - 1e-9), eps * (1 + 1e-9)
    full = g.count >= least
    first = np.full(len(full), n)
    np.minimum.at(first, g.of, np.arange(n))
    # a node is a full cell, known by its first point, or a core point of another; only points of other cells look around
    node = np.where(full[g.of], first[g.of], np.arange(n))
    loose = np.flatnonzero(~full[g.of])
    core = full[g.of].copy()
    i = []
    for some in np.split(loose, range(BLOCK, len(loose), BLOCK)):
        seen, other = g.near(g.of[some])
        size = g.count[other]
        for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // PAIRS)) + 1):
            a, b = np.repeat(some[seen[part]], size[part]), g.order[runs(g.start[other[part]], size[part])]
            dx, dy = ring(x[b] - x[a], world), ring(y[b] - y[a], world)
            ok = within(np.sqrt(dx * dx + dy * dy)) & (a != b)
            hits = np.unique(a[ok] * (n + 1) + node[b[ok]], return_counts=True)  # a cell's points once, with their number
            i.append(np.c_[hits[0] // (n + 1), hits[0] % (n + 1), hits[1]])
    links = np.concatenate(i) if i else np.empty((0, 3), np.int64)
    i, j = links[:, 0], links[:, 1]
    core[loose] = (np.bincount(i, links[:, 2], n)[loose] + 1 >= least) if len(links) else 1 >= least
    both = core[i] & core[j]
    label = merged(n, i[both], j[both])
    label = _cell_links(label, g, np.flatnonzero(full), first, x, y, below, above, within)
    out = np.where(core, label[node], n)
    of_core = core[j] & ~core[i]
    np.minimum.at(out, i[of_core], label[j[of_core]])
    # the smallest core of a cluster is the first of its nodes, as a cell's first point stands for it
    return out


def _cell_links(label, g, full, first, x, y, below, above, within):
    """Labels after full cells are joined of which some two points are within the radius."""
    if len(full) < 2:
        return label
    px, py = (c[g.order] for c in g.at)
    box = [f.reduceat(c, g.start) for c in (px, py) for f in (np.minimum, np.maximum)]
    seen, b = g.near(full)
    a = full[seen]
    pairs = (a < b) & np.isin(b, full)
    a, b = a[pairs], b[pairs]
    low, high = gap([v[a] for v in box], [v[b] for v in box], g.world)
    sure = high <= below
    if sure.any():
        label = _also(label, first[a[sure]], first[b[sure]])
    ask = np.flatnonzero(~sure & (low <= above))
    up = {}

    def top(c):
        while (t := up.get(c, c)) != c:
            up[c] = c = up.get(t, t)
        return c

    joined = []
    root = label[first]
    for q in ask[np.argsort(low[ask], kind="stable")].tolist():  # the closest first, as they settle most others
        ca, cb = a[q], b[q]
        ra, rb = top(int(root[ca])), top(int(root[cb]))
        if ra != rb and _touch(g.order[g.start[ca] : g.start[ca] + g.count[ca]], g.order[g.start[cb] : g.start[cb] + g.count[cb]], x, y, g, below, above, within):
            up[max(ra, rb)] = min(ra, rb)
            joined.append((ra, rb))
    return _also(label, *np.array(joined).T) if joined else label


def _also(label, a, b):
    """Labels after more links."""
    return merged(len(label), label[a], label[b])[label]


def _touch(a, b, x, y, g, below, above, within):
    """Whether some two points of a and b are within the radius: parts are halved where their boxes don't tell, the closest first."""
    world, (px, py) = g.world, g.at
    box = lambda v: (px[v].min(), px[v].max(), py[v].min(), py[v].max())
    todo = [(a, box(a), b, box(b))]
    while todo:
        a, ba, b, bb = todo.pop()
        if len(a) * len(b) <= LEAF:
            dx, dy = ring(x[b][None] - x[a][:, None], world), ring(y[b][None] - y[a][:, None], world)
            if within(np.sqrt(dx * dx + dy * dy)).any():
                return True
            continue
        if len(a) < len(b):
            a, ba, b, bb = b, bb, a, ba
        c = px[a] if ba[1] - ba[0] >= ba[3] - ba[2] else py[a]
        order = np.argpartition(c, len(a) // 2)
        parts = []
        for half in (a[order[: len(a) // 2]], a[order[len(a) // 2 :]]):
            bh = box(half)
            low, high = gap(bh, bb, world)
            if high <= below:
                return True
            if low <= above:
                parts.append((low, half, bh))
        todo += [(half, bh, b, bb) for _, half, bh in sorted(parts, key=lambda p: -p[0])]
    return False


LAID = "at bent side cells reach span key who sx sy own px py cell begin end".split()


def laid(x, y, radius, world):
    """Points in the order of square cells much narrower than the radius (cell by cell of a row, row by row); in a periodic world those
    near an edge stand beyond the other one as well, moved by sx, sy. None for worlds of a few radii, very wide ones and points beyond."""
    n = len(x)
    at = [c if world is None else np.mod(c, world) for c in (x, y)]
    low = [0.0, 0.0] if world is not None else [c.min() for c in at]
    most = max((c - o).max() for c, o in zip(at, low)) / radius
    bent = any((c != v).any() for c, v in zip(at, (x, y)))  # a point on the world's far edge stands on the near one
    if most > 1 << 24 or (world is not None and (world < 3 * radius or min(x.min(), y.min()) < 0 or max(x.max(), y.max()) > world)):
        return None
    wide = np.unique(np.floor((at[0] - low[0]) / radius) * (most + 3) + np.floor((at[1] - low[1]) / radius), return_counts=True)[1].astype(float)
    side = radius / min(max(1.0, (13 * ((wide**2).sum() / n) ** 2 / RING) ** (1 / 3)), 200.0)
    cells = None
    if world is not None:
        cells = max(int(world // side), 1)
        side = world / cells
    reach = int(radius / side) + 2
    if world is not None and cells < 2 * reach + 3:
        return None
    cx, cy = (np.floor((c - o) / side).astype(np.int64) for c, o in zip(at, low))
    who, sx, sy = np.arange(n), np.zeros(n), np.zeros(n)
    if world is not None:
        cx, cy = np.minimum(cx, cells - 1), np.minimum(cy, cells - 1)
        rows, ax, ay = [(who, cx, cy, sx, sy)], cx, cy
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                gx, gy = ax + a * cells, ay + b * cells
                ghost = (gx >= -reach) & (gx < cells + reach) & (gy >= -reach) & (gy < cells + reach) if (a, b) != (0, 0) else np.zeros(n, bool)
                rows.append((who[ghost], gx[ghost], gy[ghost], np.full(ghost.sum(), a * world), np.full(ghost.sum(), b * world)))
        who, cx, cy, sx, sy = (np.concatenate(v) for v in zip(*rows))
        own = np.arange(len(who)) < n
    else:
        own = np.ones(n, bool)
    cx, cy = cx + reach, cy + reach
    span = int(cx.max()) + 2 * reach + 2
    key = cy * span + cx
    order = np.argsort(key, kind="stable")
    key, who, sx, sy, own = key[order], who[order], sx[order], sy[order], own[order]
    px, py = x[who], y[who]
    cell = np.unique(key[own])
    begin, end = np.searchsorted(key, cell), np.searchsorted(key, cell, "right")
    here = locals()
    return {k: here[k] for k in LAID}


def rows(radius, side, reach):
    """Rows of cells around a cell, and of each how far to either side cells may hold points within the radius, and how far they surely
    hold no others (-1: not even the middle one)."""
    b = np.arange(-reach, reach + 1)
    out = radius * (1 + 1e-9) / side
    away = np.maximum(np.abs(b) - 1, 0)
    outer = np.where(away <= out, np.floor(np.sqrt(np.maximum(out**2 - away**2, 0))) + 1, -1).astype(np.int64)
    far = radius * (1 - 1e-9) / side
    inner = np.where(np.abs(b) + 1 <= far, np.floor(np.sqrt(np.maximum(far**2 - (np.abs(b) + 1) ** 2, 0))) - 1, -1).astype(np.int64)
    return b[outer >= 0], outer[outer >= 0], inner[outer >= 0]


def around(x, y, radius, world, inclusive, coincident, seam):
    """Of each point the number of others within the radius, and the least of their distances (NaN without); as `space.neighbours`.

    Cells that lie within the radius as a whole add their numbers; pairs are looked at only in those that its edge may cut, and around
    a point for the nearest. In a periodic world, points near an edge stand beyond the other one as well."""
    n = len(x)
    count, nearest = np.zeros(n, np.int64), np.full(n, np.nan)
    sound = np.isfinite(x) & np.isfinite(y)
    if not sound.all():
        count[sound], nearest[sound] = around(x[sound], y[sound], radius, world, inclusive, coincident, seam)
        return count, nearest
    if n < 2:
        return count, nearest
    g = laid(x, y, radius, world)
    if g is None:
        return _all_around(x, y, radius, world, inclusive, coincident, seam)
    at, bent, side, cells, reach, span, key, who, sx, sy, own, px, py, cell, begin, end = (g[k] for k in LAID)
    b, outer, inner = rows(radius, side, reach)
    edge = np.zeros(len(cell), bool)
    if seam:  # where pairs may be missed, all are looked at
        ex, ey = cell % span - reach, cell // span - reach
        edge = (ex < reach) | (ex >= cells - reach) | (ey < reach) | (ey >= cells - reach)
        coarse = [np.floor(c / radius).astype(np.int64) for c in at]
        of, around_ = [c[who] for c in coarse], int(-(-world // radius))
    last = _limit(radius, inclusive)
    for part in np.split(np.arange(len(cell)), range(4096, len(cell), 4096)):
        mid = cell[part][:, None] + b * span
        inside = np.where(edge[part][:, None], -1, inner)
        at_ = [np.searchsorted(key, mid + v, s) for v, s in ((-outer, "left"), (-inside, "left"), (inside, "right"), (outer, "right"))]
        none = inside < 0
        at_[1] = np.where(none, at_[3], at_[1])  # all of the row is looked at
        at_[2] = np.where(none, at_[3], at_[2])
        sure = (at_[2] - at_[1]).sum(axis=1)
        close = np.abs(b) <= 1
        near0, near1 = np.searchsorted(key, mid[:, close] - 1), np.searchsorted(key, mid[:, close] + 1, "right")
        for q, c in enumerate(part.tolist()):
            mine = np.arange(begin[c], end[c])
            mine = mine[own[mine]]
            i = who[mine]

            def seen(js):
                dx, dy = px[js][None] - px[mine][:, None], py[js][None] - py[mine][:, None]  # noqa: B023
                if bent:
                    dx, dy = ring(dx, world), ring(dy, world)
                elif world is not None:
                    dx += sx[js]
                    dy += sy[js]
                d = dx * dx + dy * dy
                if edge[c]:  # noqa: B023
                    for v in of:
                        gap_ = (v[js][None] - v[mine][:, None]) % around_  # noqa: B023
                        d[(gap_ > 1) & (gap_ < around_ - 1)] = np.inf
                return d

            starts, ends = np.r_[at_[0][q], at_[2][q]], np.r_[at_[1][q], at_[3][q]]
            cut = runs(starts, ends - starts)
            total = np.full(len(i), sure[q])
            step = max(PAIRS // len(i), 1)
            for k in range(0, len(cut), step):
                total += np.count_nonzero(seen(cut[k : k + step]) <= last, axis=1)
            count[i] = total - 1  # itself
            todo, best = np.ones(len(i), bool), np.full(len(i), np.inf)
            for js, enough in ((runs(near0[q], near1[q] - near0[q]), side), (None, np.inf)):
                if js is None:
                    js = runs(at_[0][q], at_[3][q] - at_[0][q])
                for k in range(0, len(js), step):
                    d = seen(js[k : k + step])
                    d[(mine[:, None] == js[k : k + step]) | (d > last)] = np.inf
                    if not coincident:
                        d[d <= 0] = np.inf
                    best = np.minimum(best, d.min(axis=1, initial=np.inf))
                todo = (np.sqrt(best) > enough) & (count[i] > 0)
                if not todo.any():
                    break
            nearest[i] = np.where(np.isfinite(best), np.sqrt(best), np.nan)
    if not coincident:
        _, of_, same = np.unique(np.c_[at[0], at[1]], axis=0, return_inverse=True, return_counts=True)
        count -= same[of_.ravel()] - 1
    return count, nearest


def _limit(radius, inclusive):
    """The greatest square whose root is within the radius."""
    t = radius * radius
    ok = (lambda v: np.sqrt(v) <= radius) if inclusive else (lambda v: np.sqrt(v) < radius)
    while ok(t):
        t = np.nextafter(t, np.inf)
    while not ok(t):
        t = np.nextafter(t, 0.0)
    return t


def _all_around(x, y, radius, world, inclusive, coincident, seam):
    """`around` by all pairs, for worlds of a few radii, very wide ones and points beyond the world."""
    n = len(x)
    count, nearest = np.zeros(n, np.int64), np.full(n, np.nan)
    last = _limit(radius, inclusive)
    cells = int(-(-world // radius)) if seam else 0
    of = [np.floor(np.mod(c, world) / radius).astype(np.int64) for c in (x, y)] if seam else ()
    step = max(PAIRS // n, 1)
    for k in range(0, n, step):
        i = np.arange(k, min(k + step, n))
        dx, dy = ring(x[None] - x[i][:, None], world), ring(y[None] - y[i][:, None], world)
        d = dx * dx + dy * dy
        bad = (i[:, None] == np.arange(n)) | ~(d <= last)
        if not coincident:
            bad |= d <= 0
        for v in of:
            away = (v[None] - v[i][:, None]) % cells
            bad |= (away > 1) & (away < cells - 1)
        d[bad] = np.inf
        count[i] = np.isfinite(d).sum(axis=1)
        best = d.min(axis=1)
        nearest[i] = np.where(np.isfinite(best), np.sqrt(best), np.nan)
    return count, nearest


#: Points that look around, and pairs of points, in one go where sums run over pairs: arrays that stay near the processor.
TILE, TILED = 1 << 8, 1 << 15
#: Values above this are summed by pairs, as running sums would lose the small ones beside them.
LARGE = 1 << 10


def pulled(ids, x, y, values, radius, near, soft, world):
    """Sums over each point's neighbours within the radius (excluded, periodic world; those of other ids): how many they are, their
    displacements, and of each of `values` (masked arrays) the sum and how many aren't null; and over those nearer than `near`, but
    not in the same place, of -displacement / (squared distance + soft). Sums of an id's rows are added. -> (count, dx, dy, push x,
    push y, [(sum, count) of each value]); ids, x and y are masked arrays too.

    Cells that lie within the radius as a whole add their sums; pairs are looked at where its edge may cut, and up to `near`. Points that
    stand outside the world or on its far edge, share an id, or have null, very large or no finite values meet all others one by one."""
    n, k = len(x), len(values)
    known = ~(np.ma.getmaskarray(ids) | np.ma.getmaskarray(x) | np.ma.getmaskarray(y))
    ids, x, y = (np.ma.getdata(c) for c in (ids, x, y))
    known &= np.isfinite(x) & np.isfinite(y)
    some = np.array([np.where(np.ma.getmaskarray(v), 0.0, np.ma.getdata(v)) for v in values]).reshape(k, n)
    held = np.array([~np.ma.getmaskarray(v) for v in values]).reshape(k, n)
    _, of, same = np.unique(ids, return_inverse=True, return_counts=True)
    plain = known & (same[of] == 1) & (x >= 0) & (x < world) & (y >= 0) & (y < world) & held.all(axis=0) & (np.abs(some) < LARGE).all(axis=0)
    sums, counts = np.zeros((n, 5 + k)), np.zeros((n, k))
    a, b = np.flatnonzero(plain), np.flatnonzero(known & ~plain)
    g = laid(x[a], y[a], radius, world) if len(a) > 1 else None
    if g is not None:
        sums[a] = _pulled(g, x[a], y[a], some[:, a], radius, near, soft)
        counts[a] += sums[a, :1]
    else:
        b, a = np.flatnonzero(known), a[:0]
    limits = _limit(radius, False), _limit(near, False)
    for left, right in ((a, b), (b, a), (b, b)):
        _all_pulled(sums, counts, left, right, ids, x, y, some, held, limits, soft, world)
    if (same > 1).any():
        for s in (sums, counts):
            all_ = np.zeros((len(same), s.shape[1]))
            np.add.at(all_, of[known], s[known])
            s[known] = all_[of[known]]
    return *sums[:, :5].T, [(sums[:, 5 + i], counts[:, i]) for i in range(k)]


def _pulled(g, x, y, values, radius, near, soft):
    """`pulled` of points that are all inside the world, by cells: count, dx, dy, push x, push y and sums of values, a column each."""
    side, reach, span, key, who, sx, sy, own, cell, begin, end = (g[c] for c in "side reach span key who sx sy own cell begin end".split())
    px, py, n, k = g["px"], g["py"], len(x), len(values)
    out = np.zeros((n, 5 + k))
    columns = np.column_stack([np.ones(len(who)), px + sx, py + sy, values[:, who].T])
    upto = np.zeros((3 + k, len(who) + 1), np.longdouble)
    np.cumsum(columns.T, axis=1, dtype=np.longdouble, out=upto[:, 1:])
    b, outer, inner = rows(radius, side, reach)
    last, close = _limit(radius, False), _limit(near, False)
    bn, on, _ = rows(near, side, min(reach, int(near / side) + 2))
    space = np.empty((4, TILED + TILE))

    def tiles(mine, js):
        """(places in mine, in js, dx, dy, squared distance, room) of parts of mine x js; the arrays are used again."""
        sides = [(p[mine][:, None], p[js], s[js] if (s[js] != 0).any() else None) for p, s in ((px, sx), (py, sy))]
        for r in range(0, len(mine), TILE):
            step = max(TILED // min(len(mine) - r, TILE), 1)
            for c in range(0, len(js), step):
                i, j = slice(r, min(r + TILE, len(mine))), slice(c, min(c + step, len(js)))
                shape = i.stop - r, j.stop - c
                dx, dy, d, e = (s[: shape[0] * shape[1]].reshape(shape) for s in space)
                for to, (from_, other, shifted) in zip((dx, dy), sides):
                    np.subtract(other[j], from_[i], out=to)
                    if shifted is not None:
                        to += shifted[j]
                np.multiply(dx, dx, out=d)
                np.multiply(dy, dy, out=e)
                d += e
                yield i, j, dx, dy, d, e

    for part in np.split(np.arange(len(cell)), range(1024, len(cell), 1024)):
        mid = cell[part][:, None] + b * span
        at = [np.searchsorted(key, mid + v, s) for v, s in ((-outer, "left"), (-inner, "left"), (inner, "right"), (outer, "right"))]
        none = np.broadcast_to(inner < 0, mid.shape)
        at[1], at[2] = np.where(none, at[3], at[1]), np.where(none, at[3], at[2])  # all of the row is looked at
        sure = (upto[:, at[2]] - upto[:, at[1]]).sum(axis=2)
        mid = cell[part][:, None] + bn * span
        near0, near1 = np.searchsorted(key, mid - on), np.searchsorted(key, mid + on, "right")
        for q, c in enumerate(part.tolist()):
            mine = np.arange(begin[c], end[c])
            mine = mine[own[mine]]
            i = who[mine]
            starts, ends = np.r_[at[0][q], at[2][q]], np.r_[at[1][q], at[3][q]]
            cut = runs(starts, ends - starts)
            x0, y0 = px[mine[0]], py[mine[0]]
            of = columns[cut]
            of[:, 1:3] -= x0, y0
            sums, pushed = np.zeros((len(i), 3 + k)), np.zeros((len(i), 2))
            for r, j, _, _, d, e in tiles(mine, cut):
                np.less_equal(d, last, out=e)
                sums[r] += e @ of[j]
            for r, _, dx, dy, d, e in tiles(mine, runs(near0[q], near1[q] - near0[q])):
                far = d > close
                if soft:
                    np.add(d, soft, out=e)
                    np.copyto(e, np.inf, where=far)
                    np.divide(1.0, e, out=e)
                    pushed[r, 0] -= np.einsum("ij,ij->i", dx, e)
                    pushed[r, 1] -= np.einsum("ij,ij->i", dy, e)
                else:
                    far |= d <= 0
                    np.sqrt(d, out=e)
                    np.multiply(e, e, out=e)
                    np.copyto(e, np.inf, where=far)
                    pushed[r, 0] -= np.divide(dx, e, out=dx).sum(axis=1)
                    pushed[r, 1] -= np.divide(dy, e, out=dy).sum(axis=1)
            whole = sure[:, q]
            out[i, 0] = (whole[0] + sums[:, 0]) - 1  # itself
            out[i, 1] = (whole[1] - whole[0] * px[mine].astype(np.longdouble)) + (sums[:, 1] - sums[:, 0] * (px[mine] - x0))
            out[i, 2] = (whole[2] - whole[0] * py[mine].astype(np.longdouble)) + (sums[:, 2] - sums[:, 0] * (py[mine] - y0))
            out[i, 3:5] = pushed
            out[i, 5:] = (whole[3:] + sums[:, 3:]) - values[:, i].T
    return out


def _all_pulled(sums, counts, left, right, ids, x, y, values, held, limits, soft, world):
    """Adds to the rows `left` of `pulled`'s sums what the points `right` give, by all pairs."""
    step = max(PAIRS // max(len(right), 1), 1)
    for s in range(0, len(left) if len(right) else 0, step):
        i = left[s : s + step]
        for r in range(0, len(right), PAIRS):
            j = right[r : r + PAIRS]
            dx, dy = ring(x[j][None] - x[i][:, None], world), ring(y[j][None] - y[i][:, None], world)
            d = dx * dx + dy * dy
            ok = (d <= limits[0]) & (ids[i][:, None] != ids[j][None])
            sums[i, 0] += ok.sum(axis=1)
            q = np.where(ok & (d <= limits[1]) & (d > 0), np.sqrt(d) ** 2 + soft, np.inf)
            for c, of in ((1, dx), (2, dy)):
                sums[i, c] += np.where(ok, of, 0.0).sum(axis=1)
                sums[i, c + 2] -= np.where(np.isinf(q), 0.0, of / q).sum(axis=1)
            for c, (v, h) in enumerate(zip(values, held)):
                sums[i, 5 + c] += np.where(ok & h[j], v[j], 0.0).sum(axis=1)
                counts[i, c] += (ok & h[j]).sum(axis=1)
