"""Clusters by each form against brute force, on crowded cells, seams, ties and many groups."""

import tracemalloc

import numpy as np
import pytest

from flockwise.operators import density, local


def labelled(xy, eps, least, world=None, inclusive=True):
    n = len(xy)
    d = xy[None] - xy[:, None]
    if world:
        d = np.where(d > world / 2, d - world, np.where(d < -world / 2, d + world, d))
    dist = np.sqrt((d**2).sum(-1))
    near = dist <= eps if inclusive else dist < eps
    np.fill_diagonal(near, True)
    core = near.sum(axis=1) >= least
    label = np.full(n, -1)
    for i in range(n):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                a = todo.pop()
                if label[a] < 0:
                    label[a] = i
                    todo += [b for b in np.flatnonzero(near[a] & core) if label[b] < 0]
    return [int(label[i]) if core[i] else min((int(label[j]) for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(n)]


def crowd():
    """Half of all points in one cell, the rest spread, some on exact multiples of the radius, some in the same place."""
    rng = np.random.default_rng(7)
    return {
        0: np.vstack([rng.uniform(10.0, 10.5, (150, 2)), rng.uniform(0, 20, (90, 2)), [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [3.0, 0.0], [3.0, 0.0], [19.9, 19.9]]]),
        1: np.vstack([rng.normal((5, 5), 0.2, (60, 2)), rng.normal((7.0, 5), 0.2, (60, 2)), rng.normal((19.8, 0.1), 0.3, (50, 2)) % 20]),
        2: np.array([[4.0, 4.0]]),
    }


GRID = [(1.0, 3), (1.0, 5), (2.0, 3), (0.6, 1)]


@pytest.mark.parametrize("form", ["whole", "forest", "cells"])
@pytest.mark.parametrize("world,inclusive", [(None, True), (20.0, False)])
def test_forms_equal_brute_force(spark, monkeypatch, form, world, inclusive):
    monkeypatch.setattr(density, "FRAME", 1024 if form == "whole" else 1)
    monkeypatch.setattr(density, "DEGREE", 10**9 if form == "forest" else -1)
    monkeypatch.setattr(density, "BLOCK", 20)
    groups = crowd()
    rows = [(g, i, float(x), float(y)) for g, xy in groups.items() for i, (x, y) in enumerate(xy)]
    p = spark.createDataFrame(rows, "g int, id bigint, x double, y double")
    grid = GRID if form != "cells" else GRID[:2] if world is None else GRID[2:]
    got = {(r.g, r.eps, r.min_samples, r.id): r.label for r in density.dbscan_grid(p, grid, keys=("g",), world=world, inclusive=inclusive).collect()}
    want = {(g, e, m, i): v for g, xy in groups.items() for e, m in grid for i, v in enumerate(labelled(xy, e, m, world, inclusive))}
    assert got == want


def test_a_crowded_cell_makes_no_pairs(spark, monkeypatch):
    """6,000 points in one cell: all core, and the only pairs are those of the few points beside it."""
    monkeypatch.setattr(density, "FRAME", 1)
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, v)) for i, v in enumerate(np.vstack([rng.uniform(10.01, 10.6, (6000, 2)), [[11.2, 10.3], [13.0, 13.0]]]))]
    got = density.dbscan(spark.createDataFrame(rows, "id bigint, x double, y double"), 1.0, 5).collect()
    assert {(r.label, r.id >= 6000) for r in got} == {(0, False), (0, True), (-1, True)}


def test_odd_points(spark):
    p = spark.createDataFrame([(1, None, 2.0), (2, 3.0, 3.0), (3, 3.0, 3.0)], "id bigint, x double, y double")
    assert {(r.id, r.label) for r in density.dbscan(p, 1.0, 2).collect()} == {(1, -1), (2, 2), (3, 2)}
    assert density.dbscan(p.limit(0), 1.0, 2).count() == 0
    with pytest.raises(ValueError):
        density.dbscan(p.selectExpr("id", "x", "y", "1 as eps"), 1.0, 2, keys=("eps",))


def test_forest_is_minimal(spark):
    """Total weight and components as by Kruskal."""
    rng = np.random.default_rng(2)
    edges = {(int(a), int(b)): round(float(w), 2) for a, b, w in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.uniform(0, 1, 150)) if a < b}
    up = list(range(60))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    total = []
    for (a, b), w in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        if top(a) != top(b):
            up[top(a)] = top(b)
            total.append((a, b, w))
    got = density.spanning_forest(spark.createDataFrame([(1, a, b, w) for (a, b), w in edges.items()], "g int, i bigint, j bigint, w double"), ["g"]).collect()
    assert sorted((r.i, r.j, r.w) for r in got) == sorted(total)


@pytest.mark.parametrize("world,inclusive", [(None, True), (20.0, False)])
def test_cells_in_a_task_equal_brute_force(spark, monkeypatch, world, inclusive):
    """Frames above MATRIX points, cut into the smallest parts that are compared whole."""
    monkeypatch.setattr(density, "MATRIX", 0)
    rng = np.random.default_rng(4)
    groups = crowd() | {3: rng.integers(0, 20, (120, 2)).astype(float), 4: rng.normal((19.8, 0.1), 0.8, (80, 2)) % 20, 5: np.vstack([rng.normal((5, 5), 0.4, (200, 2)), rng.normal((7.4, 5), 0.4, (200, 2))])}
    rows = [(g, i, float(x), float(y)) for g, xy in groups.items() for i, (x, y) in enumerate(xy)]
    p = spark.createDataFrame(rows, "g int, id bigint, x double, y double")
    got = {(r.g, r.eps, r.min_samples, r.id): r.label for r in density.dbscan_grid(p, GRID, keys=("g",), world=world, inclusive=inclusive).collect()}
    assert got == {(g, e, m, i): v for g, xy in groups.items() for e, m in GRID for i, v in enumerate(labelled(xy, e, m, world, inclusive))}


def test_parts_of_crowded_cells(monkeypatch):
    """Crowds whose boxes overlap the radius but whose points don't, and parts of four pairs."""
    monkeypatch.setattr(local, "LEAF", 4)
    monkeypatch.setattr(local, "PAIRS", 50)
    rng = np.random.default_rng(6)
    for gap in (0.9, 1.2, 1.5, 3.0):
        turn = rng.uniform(0, 2 * np.pi, 300)
        xy = np.vstack([0.3 * np.c_[np.cos(turn), np.sin(turn)], [gap, gap] + 0.3 * np.c_[np.sin(turn), np.cos(turn)], rng.uniform(-3, 3, (40, 2))])
        xy = np.vstack([xy, [[np.nan, 1.0]]])
        for eps, least in ((0.7, 3), (1.0, 4), (1.0, 1)):
            got = next(local.clusters(xy[:, 0], xy[:, 1], [(eps, least)], None, True))
            assert [int(v) if v < len(xy) else -1 for v in got] == labelled(xy, eps, least)


def test_a_large_frame_takes_memory_by_its_points(monkeypatch):
    """20,000 points at once, half of them in one cell: a matrix of distances would take 3.2 GB."""
    rng = np.random.default_rng(8)
    xy = np.vstack([rng.uniform(10, 10.5, (10000, 2)), rng.uniform(0, 100, (10000, 2))])
    tracemalloc.start()
    next(local.clusters(xy[:, 0], xy[:, 1], [(1.0, 5)], None, True))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert density.FRAME > len(xy) and most < 400e6


@pytest.mark.parametrize("degree", [-1, 10**9])
def test_nothing_is_broadcast_by_its_files_size(spark, monkeypatch, degree):
    """Tables of points look small by their compressed files; both forms for large frames join them by shuffles."""
    monkeypatch.setattr(density, "FRAME", 100)
    monkeypatch.setattr(density, "DEGREE", degree)
    plans, saved = [], density.saved

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return saved(df)

    monkeypatch.setattr(density, "saved", seen)
    rng = np.random.default_rng(9)
    rows = [(i, *map(float, v)) for i, v in enumerate(rng.uniform(0, 12, (300, 2)))]
    p = spark.createDataFrame(rows, "id bigint, x double, y double")
    density.dbscan_grid(p, [(1.0, 3), (1.5, 3)]).collect()
    # one is meant: the list of the large groups
    assert len(plans) > 5 and sum("BroadcastHashJoin" in x for x in plans) <= 1
