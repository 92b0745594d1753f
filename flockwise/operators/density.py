"""Density clusters of many groups of points under many choices of radius and least number: exact, in three forms with equal results.

Frames of at most FRAME points are clustered whole by a task, all choices at once: the smallest from their matrix of distances, others
by cells (`local`), in memory linear in the points. Larger groups:

- Under several choices, by a minimum spanning forest over mutual reachability (the greatest of two points' core distances and
  their distance): one forest for each least number, by rounds in which every component takes its least edge and components are
  joined; each radius is a cut of it, since the forest connects at every radius what all edges do.
- Under one choice, or where points crowd so that pairs are too many, by a graph of cells. A cell's diagonal is no longer than the
  radius. One with `min_samples` points is core as a whole, without a pair. Only points of sparser cells look around, at most
  24 * (min_samples - 1) of them into any cell, whose points are dealt out in blocks. Two full cells are joined if some pair of theirs is
  within the radius, which the boxes around their points tell, halved again and again where they don't.

Labels are the smallest core id of a cluster (for a border point, of its core neighbours' clusters), -1 for noise.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved
from .local import clusters
from .space import neighbours, shift

#: Points of a group that a task clusters whole; mean neighbours of a point up to which pairs are listed; points of a block of a cell.
FRAME, DEGREE, BLOCK = 1 << 17, 32, 4096
#: Points of a group that is clustered from its matrix of distances.
MATRIX = 256
#: Halvings of a cell that one pass over its points prepares.
HALVINGS = 3


def kept(df: DataFrame) -> DataFrame:
    """`saved`, and never broadcast: by its compressed files a table of millions of rows looks small, and the driver would build it."""
    return saved(df).hint("merge")


def dbscan(points: DataFrame, eps: float, min_samples: int, *, keys: tuple[str, ...] = (), world: float | None = None, inclusive: bool = True) -> DataFrame:
    """points(*keys, id, x, y) -> *keys, id, x, y, label; as `dbscan_grid` with one choice."""
    return dbscan_grid(points, [(eps, min_samples)], keys=keys, world=world, inclusive=inclusive).drop("eps", "min_samples")


def dbscan_grid(points: DataFrame, grid: list[tuple[float, int]], *, keys: tuple[str, ...] = (), world: float | None = None, inclusive: bool = True) -> DataFrame:
    """points(*keys, id, x, y) -> *keys, eps, min_samples, id, x, y, label for each choice of the grid.

    Ids are unique in a group and keys not null; a point without a coordinate is alone. Keys may have any names but those of the result."""
    if clash := {k.lower() for k in keys} & {"eps", "min_samples", "id", "x", "y", "label"}:
        raise ValueError(f"rename the keys {sorted(clash)}")
    k = list(keys) or ["_all"]
    p = points.select(*[F.col(c) for c in keys], *([] if keys else [F.lit(0).alias("_all")]), F.col("id").cast("bigint").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    grid = sorted({(float(e), int(m)) for e, m in grid})
    large = p.groupBy(*k).agg(F.count("*").alias("_n")).where(F.col("_n") > FRAME)
    if large.isEmpty():
        out = _whole(p, grid, k, world, inclusive)
    else:
        large = F.broadcast(saved(large.drop("_n")))  # a row for more than FRAME points
        of = kept(p.join(large, k, "left_semi"))
        if len(grid) > 1 and not _crowded(of, max(e for e, _ in grid), k):
            far = [_forest(of, grid, k, world, inclusive)]
        else:
            far = [_cells(of, e, m, k, world, inclusive) for e, m in grid]
        out = reduce(DataFrame.unionByName, far, _whole(p.join(large, k, "left_anti"), grid, k, world, inclusive))
    return out.select(*keys, "eps", "min_samples", "id", "x", "y", "label")


def _within(dist, eps, inclusive: bool):
    return dist <= eps if inclusive else dist < eps


def _whole(points: DataFrame, grid, k, world, inclusive) -> DataFrame:
    """Each group in a task of its own."""
    small = MATRIX
    fields = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    kinds = ", ".join(f"`{c}` {fields[c]}" for c in k) + ", eps double, min_samples int, id bigint, x double, y double, label bigint"

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        ids, x, y = (t[c].to_numpy() for c in ("id", "x", "y"))
        n, out = len(ids), []
        for (eps, least), label in zip(grid, (_by_matrix if n <= small else clusters)(x, y, grid, world, inclusive)):
            out.append(t.select([*k, "id", "x", "y"]).append_column("eps", pa.array(np.full(n, eps))).append_column("min_samples", pa.array(np.full(n, least, np.int32))).append_column("label", pa.array(np.r_[ids, -1][label])))
        return pa.concat_tables(out).select([*k, "eps", "min_samples", "id", "x", "y", "label"])

    return points.groupBy(*k).applyInArrow(run, kinds)


def _by_matrix(x, y, grid, world, inclusive):
    """For each choice, in order of eps, the place of each point's label; the number of points for noise."""
    dx, dy = x[None] - x[:, None], y[None] - y[:, None]
    if world is not None:
        dx, dy = (np.where(d > world / 2, d - world, np.where(d < -world / 2, d + world, d)) for d in (dx, dy))
    dist = np.sqrt(dx * dx + dy * dy)
    n, near, at = len(x), None, None
    for eps, least in grid:
        if eps != at:
            near, at = _within(dist, eps, inclusive), eps
            np.fill_diagonal(near, True)
            count = np.count_nonzero(near, axis=1)
        core = np.flatnonzero(count >= least)
        bare = np.flatnonzero(count < least)
        none = np.int16(len(core)) if n < 1 << 15 else np.int32(len(core))
        linked = near[np.ix_(core, core)] if len(bare) else near
        first = np.arange(len(core), dtype=none.dtype)  # of each core the least one reached, by place among the cores
        while len(core):
            new = np.where(linked, first[None], none).min(axis=1)
            while ((jump := new[new]) != new).any():
                new = jump
            if (new == first).all():
                break
            first = new
        label = np.full(n, n)
        label[core] = core[first]
        if len(core) and len(bare):
            least_of = np.where(near[np.ix_(bare, core)], first[None], none).min(axis=1)
            label[bare] = np.append(core, n)[least_of]
        yield label


def _crowded(points: DataFrame, eps: float, k) -> bool:
    """Whether cells of the widest radius hold so many points that listing pairs isn't linear."""
    n = points.groupBy(*k, F.floor(F.col("x") / eps).alias("_cx"), F.floor(F.col("y") / eps).alias("_cy")).agg(F.count("*").cast("double").alias("_n"))
    got = n.agg(F.sum(F.col("_n") * F.col("_n")).alias("pairs"), F.sum("_n").alias("all")).first()
    return (got["pairs"] or 0) > DEGREE * (got["all"] or 0)


def least_labels(nodes: DataFrame, links: DataFrame, k: list[str]) -> DataFrame:
    """nodes(*k, id), links(*k, i, j) both ways -> *k, id, label: the smallest id reachable. Labels spread along links and jump to the
    label of their label, until none changes; each round is written."""
    links = kept(links.select(*k, "i", "j"))
    labels = kept(nodes.select(*k, "id", F.col("id").alias("label")))
    if links.isEmpty():
        return labels
    while True:
        least = links.join(labels.withColumnRenamed("id", "j"), [*k, "j"]).groupBy(*k, F.col("i").alias("id")).agg(F.min("label").alias("_least"))
        new = labels.join(least, [*k, "id"], "left").select(*k, "id", F.col("label").alias("was"), F.least("label", F.coalesce("_least", "label")).alias("label"))
        far = labels.select(*k, F.col("id").alias("label"), F.col("label").alias("further"))
        new = kept(new.join(far, [*k, "label"], "left").select(*k, "id", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = new.select(*k, "id", "label")
        if new.where("was <> label").isEmpty():
            return labels


def spanning_forest(edges: DataFrame, k: list[str]) -> DataFrame:
    """edges(*k, i, j, w), i < j -> those of a minimum spanning forest of each group. A round joins every component to another by
    its least edge (by w, i, j, so that no circle closes but between two that choose each other); at most log2 of the points are needed."""
    edges = kept(edges.select(*k, "i", "j", "w", F.col("i").alias("ci"), F.col("j").alias("cj")))
    found = []
    while not edges.isEmpty():
        way = lambda a, b: edges.select(*k, F.col(a).alias("c"), F.struct("w", "i", "j", F.col(b).alias("o")).alias("e"))
        best = kept(way("ci", "cj").unionAll(way("cj", "ci")).groupBy(*k, "c").agg(F.min("e").alias("e")).select(*k, "c", "e.o", "e.i", "e.j", "e.w"))
        found.append(best.select(*k, "i", "j", "w").distinct())
        back = best.select(*k, F.col("c").alias("o"), F.col("o").alias("back"))
        root = kept(best.join(back, [*k, "o"]).select(*k, "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("r")))
        while True:
            on = root.select(*k, F.col("c").alias("r"), F.col("r").alias("further"))
            new = kept(root.join(on, [*k, "r"]).select(*k, "c", F.col("further").alias("r"), (F.col("further") != F.col("r")).alias("moved")))
            root = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        for c in ("ci", "cj"):
            edges = edges.join(root.select(*k, F.col("c").alias(c), F.col("r").alias("_r")), [*k, c]).drop(c).withColumnRenamed("_r", c)
        edges = kept(edges.where("ci <> cj"))
    return reduce(DataFrame.unionAll, found) if found else edges.select(*k, "i", "j", "w")


def _forest(points: DataFrame, grid, k, world, inclusive) -> DataFrame:
    """Clusters under all choices from one forest for each least number."""
    ms = sorted({m for _, m in grid})
    near = kept(neighbours(points, max(e for e, _ in grid), k, world=world, inclusive=inclusive).select(*k, "i", "j", "dist"))
    # the distances that reach the least numbers, the point itself among them
    nearest = near.groupBy(*k, F.col("i").alias("id")).agg(F.sort_array(F.collect_list("dist")).alias("d"))  # of a bounded mean degree
    every = points.join(nearest, [*k, "id"], "left")
    reach = F.array(*[F.struct(F.lit(m).alias("m"), (F.lit(0.0) if m < 2 else F.get("d", F.lit(m - 2))).alias("r")) for m in ms])
    core = kept(every.select(*k, "id", F.explode(reach).alias("x")).select(*k, "id", "x.m", "x.r").where("r is not null"))
    km = [*k, "m"]
    met = near.where("i < j").join(core.select(*k, F.col("id").alias("i"), "m", F.col("r").alias("ri")), [*k, "i"]).join(core.select(*km, F.col("id").alias("j"), F.col("r").alias("rj")), [*km, "j"])
    forest = spanning_forest(met.select(*km, "i", "j", F.greatest("dist", "ri", "rj").alias("w")), km)
    choices = F.array(*[F.struct(F.lit(e).alias("eps"), F.lit(m).alias("m")) for e, m in grid])
    of = lambda df: df.withColumn("_c", F.explode(F.filter(choices, lambda c: c.m == F.col("m")))).withColumn("eps", F.col("_c.eps")).drop("_c")
    ke = [*km, "eps"]
    cut = of(forest).where(_within(F.col("w"), F.col("eps"), inclusive))
    nodes = of(core).where(_within(F.col("r"), F.col("eps"), inclusive)).select(*ke, "id")
    labels = kept(least_labels(nodes, cut.select(*ke, "i", "j").unionAll(cut.select(*ke, F.col("j").alias("i"), F.col("i").alias("j"))), ke))
    all_ = points.select(*k, "id", "x", "y", F.explode(choices).alias("_c")).select(*k, F.col("_c.m").alias("m"), F.col("_c.eps").alias("eps"), "id", "x", "y")
    got = all_.join(labels, [*ke, "id"], "left")
    bare = got.where("label is null").select(*ke, F.col("id").alias("i"))
    around = bare.join(near, [*k, "i"]).where(_within(F.col("dist"), F.col("eps"), inclusive)).join(labels.withColumnRenamed("id", "j"), [*ke, "j"]).groupBy(*ke, F.col("i").alias("id")).agg(F.min("label").alias("border"))
    return got.join(around, [*ke, "id"], "left").select(*k, "eps", F.col("m").alias("min_samples"), "id", "x", "y", F.coalesce("label", "border", F.lit(-1)).alias("label"))


def _cells(points: DataFrame, eps: float, least: int, k, world, inclusive) -> DataFrame:
    """Clusters by the graph of cells."""
    side, n = eps / math.sqrt(2) * (1 - 1e-9), None
    if world is not None:
        n = math.ceil(world / side)
        side = world / n
    whole = lambda c: F.col(c) if world is None else F.pmod(F.col(c), F.lit(world))
    place = [F.floor(whole(c) / side).alias(f"c{c}") for c in "xy"]
    if n is not None:
        place = [F.least(F.floor(whole(c) / side), F.lit(n - 1)).alias(f"c{c}") for c in "xy"]
    p = points.select(*k, "id", "x", "y", *place)
    cell = [*k, "cx", "cy"]
    held = kept(p.groupBy(*cell).agg(F.count("*").alias("n"), F.min("id").alias("first")))
    p = kept(p.join(held, cell, "left").withColumn("full", F.coalesce(F.col("n") >= least, F.lit(False))))
    offsets = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]
    if n is not None and n < 5:  # each cell once
        offsets = sorted({(a % n, b % n) for a, b in offsets})
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    to = lambda c, o: F.col(c) + o if n is None else F.pmod(F.col(c) + o, F.lit(n))
    loose = p.where("not full").select(*k, F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), "cx", "cy", F.explode(around).alias("o"))
    loose = loose.select(*k, "i", "xi", "yi", to("cx", F.col("o.a")).alias("cx"), to("cy", F.col("o.b")).alias("cy"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    loose = loose.join(held, cell).select(*cell, "i", "xi", "yi", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"))
    right = p.select(*cell, F.pmod(F.xxhash64("id"), blocks).cast("int").alias("part"), F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), "full", "first")
    dx, dy = F.col("xj") - F.col("xi"), F.col("yj") - F.col("yi")
    if world is not None:
        dx, dy = shift(dx, world), shift(dy, world)
    met = loose.join(right, [*cell, "part"]).where("i <> j").where(_within(F.sqrt(dx**2 + dy**2), eps, inclusive))
    near = kept(met.groupBy(*k, "i", F.when(F.col("full"), F.col("first")).otherwise(F.col("j")).alias("j"), "full").agg(F.count("*").alias("n")))
    ids = [*k, "id"]
    some = kept(near.groupBy(*k, F.col("i").alias("id")).agg((F.sum("n") + 1).alias("n")).where(F.col("n") >= least).select(*ids))
    if least <= 1:
        some = kept(p.where("not full").select(*ids))
    full = kept(held.where(F.col("n") >= least).select(*cell, "first"))
    nodes = full.select(*k, F.col("first").alias("id")).unionAll(some)
    mine = near.join(some.withColumnRenamed("id", "i"), [*k, "i"], "left_semi")
    links = mine.where("full").select(*k, "i", "j").unionAll(mine.where("not full").join(some.withColumnRenamed("id", "j"), [*k, "j"], "left_semi").select(*k, "i", "j"))
    links = links.unionAll(_joined_cells(p.where("full"), full, eps, k, side, n, world, inclusive))
    labels = kept(least_labels(nodes, links.unionAll(links.select(*k, F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), k))
    border = near.join(labels.withColumnRenamed("id", "j"), [*k, "j"]).groupBy(*k, F.col("i").alias("id")).agg(F.min("label").alias("border"))
    of_cell = p.where("full").join(labels.select(*k, F.col("id").alias("first"), "label"), [*k, "first"]).select(*k, "id", "x", "y", "label")
    rest = p.where("not full").join(labels, ids, "left").join(border, ids, "left").select(*k, "id", "x", "y", F.coalesce("label", "border", F.lit(-1)).alias("label"))
    return of_cell.unionAll(rest).withColumn("eps", F.lit(eps)).withColumn("min_samples", F.lit(least))


def _joined_cells(points: DataFrame, cells: DataFrame, eps: float, k, side, n, world, inclusive) -> DataFrame:
    """Of full cells the pairs (by their first ids) of which some two points are within the radius. Boxes around the points of two
    cells tell if all or none are; where they don't, both are cut in four, and the parts' boxes are asked."""
    half = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a, b) > (0, 0)]
    pair = cells.select(*k, F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("first").alias("i"), F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in half])).alias("o"))
    over = lambda c, o: F.lit(0) if n is None else F.floor((F.col(c) + F.col(o)) / n)  # noqa: E731  how often the world is left
    pair = pair.select(*k, "ax", "ay", "i", (F.col("ax") + F.col("o.a") - over("ax", "o.a") * (n or 0)).alias("bx"), (F.col("ay") + F.col("o.b") - over("ay", "o.b") * (n or 0)).alias("by"), over("ax", "o.a").cast("double").alias("wx"), over("ay", "o.b").cast("double").alias("wy"))
    pair = pair.join(cells.select(*k, F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("first").alias("j")), [*k, "bx", "by"]).where("i <> j")
    open_ = kept(pair.select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("sax", "say", "sbx", "sby")]))
    done, level = [], 0
    while not open_.isEmpty():
        if level % HALVINGS == 0:  # boxes of the smallest parts first; larger parts' boxes follow from them
            cut = 2 ** (level + HALVINGS)
            at = lambda c: F.greatest(F.least(F.floor((_place(c, world) - F.col(f"c{c}") * side) / side * cut), F.lit(cut - 1)), F.lit(0)).cast("bigint")  # noqa: B023, E731
            used = open_.select(*k, F.col("i").alias("first")).unionAll(open_.select(*k, F.col("j").alias("first"))).distinct()
            parts = points.join(used, [*k, "first"], "left_semi").select(*k, "first", at("x").alias("sx"), at("y").alias("sy"), _place("x", world).alias("x"), _place("y", world).alias("y"))
            parts = kept(parts.groupBy(*k, "first", "sx", "sy").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
        up = 2 ** (HALVINGS - level % HALVINGS)
        box = parts.groupBy(*k, "first", F.floor(F.col("sx") / up).alias("sx"), F.floor(F.col("sy") / up).alias("sy")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
        box = kept(box)
        for c, s in (("i", "a"), ("j", "b")):
            open_ = open_.join(box.select(*k, F.col("first").alias(c), F.col("sx").alias(f"s{s}x"), F.col("sy").alias(f"s{s}y"), *[F.col(e).alias(f"{s}{e}") for e in ("x0", "x1", "y0", "y1")]), [*k, c, f"s{s}x", f"s{s}y"])
        low, high = [], []
        for c in "xy":
            lo, hi = ((F.col(f"b{c}{e}") - F.col(f"a{c}{1 - e}")) + F.col(f"w{c}") * (world or 0.0) for e in (0, 1))
            low.append(F.greatest(F.lit(0.0), lo, -hi))
            high.append(F.greatest(F.abs(lo), F.abs(hi)))
        size = lambda d: F.sqrt(d[0] ** 2 + d[1] ** 2)
        told = kept(open_.withColumn("all", _within(size(high), eps, inclusive)).withColumn("some", _within(size(low), eps, inclusive)).where("all or some"))
        done.append(told.where("all").select(*k, "i", "j").distinct())
        rest = told.where("not all").join(done[-1], [*k, "i", "j"], "left_anti")
        quarter = lambda s: F.array(*[F.struct((2 * F.col(f"s{s}x") + a).alias("x"), (2 * F.col(f"s{s}y") + b).alias("y")) for a in (0, 1) for b in (0, 1)])
        rest = rest.select(*k, "ax", "ay", "i", "bx", "by", "wx", "wy", "j", F.explode(quarter("a")).alias("qa"), "sbx", "sby")
        rest = rest.select(*k, "ax", "ay", "i", "bx", "by", "wx", "wy", "j", F.col("qa.x").alias("sax"), F.col("qa.y").alias("say"), F.explode(quarter("b")).alias("qb"))
        open_ = kept(rest.select(*k, "bx", "by", "ax", "ay", "i", "wx", "wy", "j", "sax", "say", F.col("qb.x").alias("sbx"), F.col("qb.y").alias("sby")))
        level += 1
    return reduce(DataFrame.unionAll, done) if done else pair.select(*k, "i", "j").limit(0)


def _place(c: str, world: float | None):
    return F.col(c) if world is None else F.pmod(F.col(c), F.lit(world))
