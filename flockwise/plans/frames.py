"""Queries over trajectory frames: macro-states, classes, predictability, neighbours, forces, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import density, info, space
from ..sources import adapters as A

R6 = lambda c: F.round(c, 6)
FR = A.SQL["frames"]
UNIT = "CASE WHEN vx*vx+vy*vy=0 THEN 1e-10 ELSE sqrt(vx*vx+vy*vy) END"
POL = f"sqrt(pow(avg(vx/({UNIT})),2)+pow(avg(vy/({UNIT})),2))"


def polarization_frames(spark, sf) -> DataFrame:
    return A.frames(spark, sf).groupBy("run", "step").agg(F.count("*").alias("n"), S.polarization(F.col("vx"), F.col("vy")).alias("polarization"))


def frame_polarization(spark: SparkSession, sf: str) -> DataFrame:
    return polarization_frames(spark, sf).select("run", "step", "n", R6("polarization").alias("polarization"))


KEY = ["run", "step"]


def macro(spark, sf) -> DataFrame:
    """Polarization, centroid, dispersion (population deviation of the distance to the centroid) and mean speed of each frame."""
    f = A.frames(spark, sf)
    c = f.groupBy(*KEY).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    speed = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)
    return f.join(c, KEY).groupBy(*KEY).agg(
        F.count("*").alias("n"), S.polarization(F.col("vx"), F.col("vy")).alias("polarization"), F.first("cx").alias("cx"), F.first("cy").alias("cy"),
        F.stddev_pop(F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)).alias("dispersion"), F.avg(F.when(speed == 0, 1e-10).otherwise(speed)).alias("mean_speed"),
    )


MACRO = f"""{FR}, c AS (SELECT *, avg(x) OVER (PARTITION BY run, step) AS cx, avg(y) OVER (PARTITION BY run, step) AS cy FROM frames),
 macro AS (SELECT run, step, count(*) AS n, {POL} AS polarization, avg(x) AS cx, avg(y) AS cy, stddev_pop(sqrt(pow(x-cx,2)+pow(y-cy,2))) AS dispersion, avg({UNIT}) AS mean_speed FROM c GROUP BY run, step)"""


def frame_dispersion_wrapped(spark, sf):
    """Mean distance to the centroid in a world that wraps at 100."""
    f = A.frames(spark, sf)
    c = f.groupBy(*KEY).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    dx, dy = (space.shift(F.col(a) - F.col(f"c{a}"), 100.0) for a in "xy")
    return f.join(c, KEY).groupBy(*KEY).agg(R6(F.avg(F.sqrt(dx * dx + dy * dy))).alias("dispersion"))


def trend_proxy(spark, sf):
    """A rough predictability: the polarization's level, and the last five frames against the five before; 0 with fewer than ten."""
    w = Window.partitionBy("run").orderBy("step")
    p = polarization_frames(spark, sf).select("run", "step", "polarization", F.avg("polarization").over(w.rowsBetween(-9, -5)).alias("old"), F.avg("polarization").over(w.rowsBetween(-4, 0)).alias("new"), F.row_number().over(w).alias("i"))
    return p.select("run", "step", R6(F.when(F.col("i") >= 10, (F.col("polarization") - 0.5) * 0.5 + (F.col("new") - F.col("old")) * 2).otherwise(0.0)).alias("trend"))


def frame_macro_state(spark, sf):
    return macro(spark, sf).select("run", "step", "n", *[R6(c).alias(c) for c in ("polarization", "cx", "cy", "dispersion", "mean_speed")])


def polarization_class(spark, sf):
    p = polarization_frames(spark, sf).select("run", "step", S.three_way(F.col("polarization"), 0.4, 0.7).alias("class"))
    return p.groupBy("run", "class").agg(F.count("*").alias("frames"))


def coherence_class(spark, sf):
    p = polarization_frames(spark, sf).select("run", "step", S.three_way(F.col("polarization"), 0.3, 0.6).alias("class"))
    return p.groupBy("run", "class").agg(F.count("*").alias("frames"))


POLS = f"{FR}, p AS (SELECT run, step, {POL} AS polarization FROM frames GROUP BY run, step)"


def class_sql(a, b):
    return f"WITH {POLS} SELECT run, CASE WHEN polarization<{a} THEN 'low' WHEN polarization<{b} THEN 'medium' ELSE 'high' END AS class, count(*) AS frames FROM p GROUP BY 1, 2"


def frame_mutual_information(spark, sf):
    """Of a frame's polarization class (ten bins) and the next frame's, by run."""
    edges = F.array(*[F.lit(k / 10) for k in range(1, 10)])
    p = polarization_frames(spark, sf).select("run", "step", S.digitize(F.col("polarization"), edges).alias("class"))
    return info.mutual_information(info.pairs(p, ["run"], "step", "class"), ["run"]).select("run", R6("mi").alias("mi"))


def mi_sql(rows: str, key: str) -> str:
    """MI of s and t, of rows(key, s, t)."""
    return f"""j AS (SELECT {key}, s, t, count(*) AS c FROM {rows} WHERE t IS NOT NULL GROUP BY ALL),
 m AS (SELECT *, sum(c) OVER (PARTITION BY {key}) AS n, sum(c) OVER (PARTITION BY {key}, s) AS cs, sum(c) OVER (PARTITION BY {key}, t) AS ct FROM j)
 SELECT {key}, round(greatest(0, sum(c/n*log2(c*n/(cs*ct)))), 6) AS mi FROM m GROUP BY {key}"""


MI_FRAMES = f"""WITH {POLS}, b AS (SELECT run, step, {"+".join(f"(polarization>={k / 10})::INT" for k in range(1, 10))} AS class FROM p),
 q AS (SELECT run, class AS s, lead(class) OVER (PARTITION BY run ORDER BY step) AS t FROM b), {mi_sql("q", "run")}"""


def te_series(spark, sf):
    return info.te_delta(macro(spark, sf), ["run"], "step", ["polarization", "cx", "cy", "dispersion", "mean_speed"], F.col("n"))


def te_delta_series(spark, sf):
    return te_series(spark, sf).select("run", "step", R6("te_delta").alias("te_delta"))


def te_delta_mean(spark, sf):
    p = polarization_frames(spark, sf).groupBy("run").agg(R6(F.avg("polarization")).alias("polarization"))
    return te_series(spark, sf).groupBy("run").agg(R6(F.avg("te_delta")).alias("te_delta"), F.count("*").alias("n")).join(p, "run")


def substrate_robustness(spark, sf):
    """clip(1 - deviation / |mean|) of a step's TE delta over the runs as variants."""
    g = te_series(spark, sf).groupBy("step").agg(F.avg("te_delta").alias("m"), F.stddev_pop("te_delta").alias("s"))
    return g.select("step", R6(F.when(F.abs("m") < 1e-10, 0.0).otherwise(S.clip(1 - F.col("s") / F.abs("m"), 0.0, 1.0))).alias("robustness"))


_M = ("polarization", "cx", "cy", "dispersion", "mean_speed")
_W = "OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
TE = f"""{MACRO}, w AS (SELECT *, {", ".join(f"avg({c}) {_W} AS m{i}, sum({c}) {_W} AS s{i}, sum({c}*{c}) {_W} AS q{i}" for i, c in enumerate(_M))}, count(*) {_W} AS k, max(step) OVER (PARTITION BY run) AS last FROM macro),
 v AS (SELECT run, step, n, sqrt({"+".join(f"pow({c}-m{i},2)" for i, c in enumerate(_M))}) AS err, sqrt(greatest(({"+".join(f"q{i}" for i in range(5))})/15-pow(({"+".join(f"s{i}" for i in range(5))})/15,2),0)) AS sd FROM w WHERE k=3 AND step<last),
 te AS (SELECT run, step, CASE WHEN sd<1e-10 THEN 0.0 ELSE greatest(0,least(1,1-err/(sd*sqrt(5.0))))*(1-1/(1+ln(1+12*n/16.0))) END AS te_delta FROM v)"""


def points(spark, sf) -> DataFrame:
    return A.frames(spark, sf).select("run", "step", F.col("boid_id").alias("id"), "x", "y", "vx", "vy")


def counted(spark, sf, **how) -> DataFrame:
    n = space.counted(points(spark, sf), 7.0, KEY, **how).where("n > 0")
    return n.select(*KEY, F.col("id").alias("i"), F.col("n").alias("neighbours"), R6("nearest").alias("nearest"))


def neighbors_plain(spark, sf):
    """In an open world, the radius included."""
    return counted(spark, sf, inclusive=True)


def neighbors_periodic(spark, sf):
    """In a periodic world, the radius excluded, and points in the same place left out."""
    return counted(spark, sf, world=100.0, coincident=False)


def neighbors_grid(spark, sf):
    """By cells of the radius, the last one narrower: neighbours across it may be missed."""
    return counted(spark, sf, world=100.0, seam=True)


def neighbor_stats(spark, sf):
    """Mean number of neighbours of each frame, points without any counted: of all points, and of the first ten."""
    n = space.counted(points(spark, sf), 7.0, KEY, world=100.0).withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy("id")))
    return n.groupBy(*KEY).agg(F.count("*").alias("points"), R6(F.avg("n")).alias("mean_neighbours"), R6(F.avg(F.when(F.col("k") <= 10, F.col("n")))).alias("mean_of_ten"))


PTS = f"{FR}, p AS (SELECT run, step, boid_id AS id, x, y, vx, vy FROM frames)"
_D = lambda d: f"CASE WHEN {d}>50 THEN {d}-100 WHEN {d}<-50 THEN {d}+100 ELSE {d} END"
PAIRS = f"""{PTS}, d AS (SELECT a.run, a.step, a.id AS i, b.id AS j, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj, {_D("(b.x-a.x)")} AS dx, {_D("(b.y-a.y)")} AS dy, b.vx AS vxj, b.vy AS vyj FROM p a JOIN p b ON a.run=b.run AND a.step=b.step AND a.id<>b.id)"""
EDGES = f"{PAIRS}, e AS (SELECT *, sqrt(dx*dx+dy*dy) AS dist FROM d WHERE sqrt(dx*dx+dy*dy)<7)"


def forces(spark, sf, *, soft: float = 0.01, raw: bool = False) -> DataFrame:
    """Alignment, cohesion and separation on each point. `soft` is added to squared distances; with `raw` the centre of the neighbours
    is that of their positions, wrapped once, instead of the mean of the wrapped offsets."""
    g = space.pulled(points(spark, sf), 7.0, KEY, near=3.0, soft=soft, world=100.0, mean=("vx", "vy", "x", "y") if raw else ("vx", "vy"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    co = lambda c: space.shift(F.col(f"avg_{c}") - F.col(c), 100.0) if raw else F.col(f"avg_d{c}")
    return g.select(*KEY, "id", "x", "y", "vx", "vy", zero(F.col("avg_vx") - F.col("vx")).alias("ax"), zero(F.col("avg_vy") - F.col("vy")).alias("ay"), zero(0.1 * co("x")).alias("cox"), zero(0.1 * co("y")).alias("coy"), zero(F.col("push_x")).alias("sx"), zero(F.col("push_y")).alias("sy"))


def forces_sql(soft: float = 0.01, raw: bool = False) -> str:
    push = lambda d: f"coalesce(sum(CASE WHEN dist<3 AND dist>0 THEN -{d}/(dist*dist+{soft}) END),0)"
    co = lambda c: f"coalesce(0.1*({_D(f'(co{c}-{c})')}),0)" if raw else f"coalesce(0.1*co{c},0)"
    centre = "avg(xj) AS cox, avg(yj) AS coy" if raw else "avg(dx) AS cox, avg(dy) AS coy"
    return f"""{EDGES}, g AS (SELECT run, step, i AS id, avg(vxj) AS avx, avg(vyj) AS avy, {centre}, {push("dx")} AS sx, {push("dy")} AS sy FROM e GROUP BY run, step, i),
 f AS (SELECT p.run, p.step, p.id, x, y, vx, vy, coalesce(avx-vx,0) AS ax, coalesce(avy-vy,0) AS ay, {co("x")} AS cox, {co("y")} AS coy, coalesce(sx,0) AS sx, coalesce(sy,0) AS sy FROM p LEFT JOIN g USING (run, step, id))"""


def shown(f: DataFrame) -> DataFrame:
    return f.select(*KEY, "id", *[R6(c).alias(c) for c in ("ax", "ay", "cox", "coy", "sx", "sy")])


SHOWN = "SELECT run, step, id, round(ax,6) AS ax, round(ay,6) AS ay, round(cox,6) AS cox, round(coy,6) AS coy, round(sx,6) AS sx, round(sy,6) AS sy FROM f"


def step_forces(spark, sf):
    return shown(forces(spark, sf))


def step_forces_raw(spark, sf):
    """The other definitions: cohesion to the wrapped mean of positions, separation by the bare squared distance."""
    return shown(forces(spark, sf, soft=0.0, raw=True))


def _step(spark, sf, uniform: bool) -> DataFrame:
    f = forces(spark, sf)
    u1, u2 = (S.uniform(F.lit("7"), "run", "step", "id", F.lit(k)) for k in ("a", "b"))
    known = F.col("run").isNotNull() & F.col("id").isNotNull()
    f = f.withColumn("g", F.when(known, 2 * u1 - 1 if uniform else S.gaussian(u1, u2)))
    f = f.withColumn("wx", F.col("vx") + 0.1 * (F.col("ax") + F.col("cox") + F.col("sx") + 0.1 * F.col("g"))).withColumn("wy", F.col("vy") + 0.1 * (F.col("ay") + F.col("coy") + F.col("sy") + 0.1 * F.col("g")))
    speed = F.sqrt(F.col("wx") ** 2 + F.col("wy") ** 2)
    cap = F.when(speed > 2, 2 / speed).otherwise(1.0)
    f = f.withColumn("wx2", F.col("wx") * cap).withColumn("wy2", F.col("wy") * cap)
    r4 = lambda c: F.round(c, 4)
    return f.select(*KEY, "id", r4(F.pmod(F.col("x") + 0.1 * F.col("wx2"), F.lit(100.0))).alias("x"), r4(F.pmod(F.col("y") + 0.1 * F.col("wy2"), F.lit(100.0))).alias("y"), r4("wx2").alias("vx"), r4("wy2").alias("vy"))


def step_update(spark, sf):
    """One step from every frame: Gaussian noise keyed by run, step and point, speed cap 2, time step .1, periodic world of 100."""
    return _step(spark, sf, False)


def step_update_uniform(spark, sf):
    """With uniform noise."""
    return _step(spark, sf, True)


_U = lambda k: f"(('0x'||substr(md5('7|'||run||'|'||step||'|'||id||'|{k}'),1,8))::BIGINT/4294967296.0)"
_NOISE = {False: f"sqrt(-2*ln(greatest({_U('a')}, pow(2.0,-33))))*cos(2*3.141592653589793*{_U('b')})", True: f"2*{_U('a')}-1"}


def step_sql(uniform: bool) -> str:
    return f"""WITH {forces_sql()}, n AS (SELECT *, {_NOISE[uniform]} AS g FROM f),
 v AS (SELECT run, step, id, x, y, vx+0.1*(ax+cox+sx+0.1*g) AS wx, vy+0.1*(ay+coy+sy+0.1*g) AS wy FROM n),
 c AS (SELECT *, CASE WHEN sqrt(wx*wx+wy*wy)>2 THEN 2/sqrt(wx*wx+wy*wy) ELSE 1.0 END AS cap FROM v),
 q AS (SELECT run, step, id, x+0.1*wx*cap AS x, y+0.1*wy*cap AS y, wx*cap AS vx, wy*cap AS vy FROM c)
 SELECT run, step, id, round(x-100*floor(x/100),4) AS x, round(y-100*floor(y/100),4) AS y, round(vx,4) AS vx, round(vy,4) AS vy FROM q"""


def boundary_reflect(spark, sf):
    """Positions pushed out of a world of 60 by ten velocities are reflected, velocities flipped, along both axes."""
    p = points(spark, sf)
    new = lambda c: F.col(c) + 10 * F.col(f"v{c}")
    out = lambda c: R6(F.when(new(c) < 0, -new(c)).when(new(c) > 60, 120 - new(c)).otherwise(new(c))).alias(c)
    flip = lambda c: R6(F.when((new(c) < 0) | (new(c) > 60), -F.col(f"v{c}")).otherwise(F.col(f"v{c}"))).alias(f"v{c}")
    return p.select(*KEY, "id", out("x"), out("y"), flip("x"), flip("y"))


_OUT = lambda c: f"round(CASE WHEN n{c}<0 THEN -n{c} WHEN n{c}>60 THEN 120-n{c} ELSE n{c} END,6) AS {c}, round(CASE WHEN n{c}<0 OR n{c}>60 THEN -v{c} ELSE v{c} END,6) AS v{c}"


def dbscan_labels(spark, sf):
    """Clusters of every frame."""
    return density.dbscan(points(spark, sf), 3.0, 5, keys=("run", "step")).select(*KEY, "id", "label")


def dbscan_periodic(spark, sf):
    """In a periodic world of 50, the radius excluded."""
    p = points(spark, sf).select(*KEY, "id", F.pmod("x", F.lit(50.0)).alias("x"), F.pmod("y", F.lit(50.0)).alias("y"))
    return density.dbscan(p, 3.0, 4, keys=("run", "step"), world=50.0, inclusive=False).select(*KEY, "id", "label")


def flocks(spark, sf) -> DataFrame:
    """run, step, id, label, vx, vy; noise left out."""
    p = points(spark, sf)
    return density.dbscan(p, 3.0, 5, keys=("run", "step")).where("label >= 0").select(*KEY, "id", "label").join(p.select(*KEY, "id", "vx", "vy").hint("merge"), [*KEY, "id"])


def largest_flock(spark, sf):
    """The largest cluster of each frame, the smallest label of equals."""
    d = flocks(spark, sf).groupBy(*KEY, "label").agg(F.count("*").alias("n"))
    return d.groupBy(*KEY).agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), F.col("label"))).alias("b")).select(*KEY, "b.label", "b.n")


def flock_polarization(spark, sf):
    """Polarization of each cluster's members, noise left out."""
    return flocks(spark, sf).groupBy(*KEY, "label").agg(F.count("*").alias("n"), R6(S.polarization(F.col("vx"), F.col("vy"))).alias("polarization"))


def dbscan_sql(points_: str, dist: str, op: str, least: int, tail: str) -> str:
    """Labels by reachability; ids hold the step, so that they are unique."""
    return f"""WITH RECURSIVE {FR}, p AS (SELECT step::BIGINT*1000000000+boid_id AS id, run, step, boid_id, {points_}, vx, vy FROM frames), e AS (SELECT a.id AS i, b.id AS j FROM p a JOIN p b ON a.run=b.run AND a.step=b.step AND a.id<>b.id AND {dist} {op} 3.0),
 core AS (SELECT i AS id FROM e GROUP BY i HAVING count(*)+1>={least}), l AS (SELECT i, j FROM e WHERE i IN (FROM core) AND j IN (FROM core)),
 r(id, root) AS (SELECT id, id FROM core UNION SELECT l.i, r.root FROM r JOIN l ON l.j=r.id),
 lab AS (SELECT id, min(root) AS label FROM r GROUP BY id), bor AS (SELECT e.i AS id, min(lab.label) AS b FROM e JOIN lab ON lab.id=e.j GROUP BY e.i),
 d AS (SELECT p.run, p.step, boid_id AS id, vx, vy, coalesce(coalesce(lab.label, bor.b)%1000000000, -1) AS label FROM p LEFT JOIN lab USING (id) LEFT JOIN bor USING (id)) {tail}"""


_EUC = "sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))"
_MOD = "x-50*floor(x/50) AS x, y-50*floor(y/50) AS y"
_PER = "sqrt(pow(least(abs(a.x-b.x),50-abs(a.x-b.x)),2)+pow(least(abs(a.y-b.y),50-abs(a.y-b.y)),2))"


def warmup_filter(spark, sf):
    """Mean polarization of every second step after a warm-up of four, by three conventions: from step 4 on, from the fifth record on,
    and from step 4 on if there are at least eight records, else 0."""
    p = polarization_frames(spark, sf).where("step % 2 = 0").withColumn("i", F.row_number().over(Window.partitionBy("run").orderBy("step")) - 1)
    late = F.avg(F.when(F.col("step") >= 4, F.col("polarization")))
    return p.groupBy("run").agg(R6(late).alias("by_step"), R6(F.avg(F.when(F.col("i") >= 4, F.col("polarization")))).alias("by_record"), R6(F.when(F.count("*") < 8, 0.0).otherwise(late)).alias("guarded"))


def thin_records(spark, sf):
    return A.frames(spark, sf).where("step % 5 = 0").groupBy("run", "step").agg(F.count("*").alias("n"), R6(F.sum("x")).alias("x"))


QUERIES = {f.__name__: f for f in (frame_polarization, frame_macro_state, polarization_class, coherence_class, frame_mutual_information, te_delta_series, te_delta_mean, substrate_robustness, frame_dispersion_wrapped, trend_proxy, neighbors_plain, neighbors_periodic, neighbors_grid, neighbor_stats, step_forces, step_forces_raw, step_update, step_update_uniform, boundary_reflect, dbscan_labels, dbscan_periodic, largest_flock, flock_polarization, warmup_filter, thin_records)}
ORACLE = {
    "frame_polarization": f"WITH {FR} SELECT run, step, count(*) AS n, round({POL},6) AS polarization FROM frames GROUP BY run, step",
    "frame_macro_state": f"WITH {MACRO} SELECT run, step, n, round(polarization,6) AS polarization, round(cx,6) AS cx, round(cy,6) AS cy, round(dispersion,6) AS dispersion, round(mean_speed,6) AS mean_speed FROM macro",
    "polarization_class": class_sql(0.4, 0.7),
    "coherence_class": class_sql(0.3, 0.6),
    "frame_mutual_information": MI_FRAMES,
    "te_delta_series": f"WITH {TE} SELECT run, step, round(te_delta,6) AS te_delta FROM te",
    "te_delta_mean": f"WITH {TE}, t AS (SELECT run, round(avg(te_delta),6) AS te_delta, count(*) AS n FROM te GROUP BY run) SELECT t.*, (SELECT round(avg(polarization),6) FROM macro m WHERE m.run=t.run) AS polarization FROM t",
    "frame_dispersion_wrapped": f"WITH {FR}, c AS (SELECT *, x-avg(x) OVER (PARTITION BY run, step) AS ox, y-avg(y) OVER (PARTITION BY run, step) AS oy FROM frames), s AS (SELECT run, step, {_D('ox')} AS dx, {_D('oy')} AS dy FROM c) SELECT run, step, round(avg(sqrt(dx*dx+dy*dy)),6) AS dispersion FROM s GROUP BY run, step",
    "trend_proxy": f"WITH {POLS}, w AS (SELECT *, avg(polarization) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS old, avg(polarization) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS new, row_number() OVER (PARTITION BY run ORDER BY step) AS i FROM p) SELECT run, step, round(CASE WHEN i>=10 THEN (polarization-0.5)*0.5+(new-old)*2 ELSE 0.0 END,6) AS trend FROM w",
    "substrate_robustness": f"WITH {TE} SELECT step, round(CASE WHEN abs(avg(te_delta))<1e-10 THEN 0.0 ELSE greatest(0,least(1,1-stddev_pop(te_delta)/abs(avg(te_delta)))) END,6) AS robustness FROM te GROUP BY step",
    "neighbors_plain": f"WITH {PTS} SELECT a.run, a.step, a.id AS i, count(*) AS neighbours, round(min({_EUC}),6) AS nearest FROM p a JOIN p b ON a.run=b.run AND a.step=b.step AND a.id<>b.id AND {_EUC}<=7 GROUP BY a.run, a.step, a.id",
    "neighbors_periodic": f"WITH {EDGES} SELECT run, step, i, count(*) AS neighbours, round(min(dist),6) AS nearest FROM e WHERE dist>0 GROUP BY run, step, i",
    "neighbors_grid": f"WITH {EDGES}, c AS (SELECT *, (floor((xj-100*floor(xj/100))/7)-floor((xi-100*floor(xi/100))/7)+16)::INT%15 AS cx, (floor((yj-100*floor(yj/100))/7)-floor((yi-100*floor(yi/100))/7)+16)::INT%15 AS cy FROM e) SELECT run, step, i, count(*) AS neighbours, round(min(dist),6) AS nearest FROM c WHERE cx<3 AND cy<3 GROUP BY run, step, i",
    "neighbor_stats": f"WITH {EDGES}, n AS (SELECT run, step, i AS id, count(*) AS n FROM e GROUP BY run, step, i), k AS (SELECT run, step, id, row_number() OVER (PARTITION BY run, step ORDER BY id) AS k FROM p) SELECT k.run, k.step, count(*) AS points, round(avg(coalesce(n,0)),6) AS mean_neighbours, round(avg(coalesce(n,0)) FILTER (k<=10),6) AS mean_of_ten FROM k LEFT JOIN n USING (run, step, id) GROUP BY k.run, k.step",
    "step_forces": f"WITH {forces_sql()} {SHOWN}",
    "step_forces_raw": f"WITH {forces_sql(0.0, True)} {SHOWN}",
    "step_update": step_sql(False),
    "step_update_uniform": step_sql(True),
    "boundary_reflect": f"WITH {PTS}, q AS (SELECT *, x+10*vx AS nx, y+10*vy AS ny FROM p) SELECT run, step, id, {_OUT('x')}, {_OUT('y')} FROM q",
    "dbscan_labels": dbscan_sql("x, y", _EUC, "<=", 5, "SELECT run, step, id, label FROM d"),
    "dbscan_periodic": dbscan_sql(_MOD, _PER, "<", 4, "SELECT run, step, id, label FROM d"),
    "largest_flock": dbscan_sql("x, y", _EUC, "<=", 5, ", c AS (SELECT run, step, label, count(*) AS n FROM d WHERE label>=0 GROUP BY run, step, label), k AS (SELECT *, row_number() OVER (PARTITION BY run, step ORDER BY n DESC, label) AS k FROM c) SELECT run, step, label, n FROM k WHERE k=1"),
    "flock_polarization": dbscan_sql("x, y", _EUC, "<=", 5, f"SELECT run, step, label, count(*) AS n, round({POL},6) AS polarization FROM d WHERE label>=0 GROUP BY run, step, label"),
    "warmup_filter": f"WITH {POLS}, i AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step)-1 AS i FROM p WHERE step%2=0) SELECT run, round(avg(polarization) FILTER (step>=4),6) AS by_step, round(avg(polarization) FILTER (i>=4),6) AS by_record, round(CASE WHEN count(*)<8 THEN 0.0 ELSE avg(polarization) FILTER (step>=4) END,6) AS guarded FROM i GROUP BY run",
    "thin_records": f"WITH {FR} SELECT run, step, count(*) AS n, round(sum(x),6) AS x FROM frames WHERE step%5=0 GROUP BY run, step",
}
