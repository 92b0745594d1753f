"""The four-condition experiment: clusters of each frame, macro-states, their mutual information along a parameter, change points,
effect sizes, resampling tests, verdict.

The parameter's levels are the frames' runs and its replicates three parts of each run's points. Everything is keyed by level,
replicate and clustering choice, so that all choices are one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import density, info, series
from ..sources import adapters as A
from ..sources.shared import saved
from .frames import UNIT
from .sweeps import MEANS, change_points_of

R6 = lambda c: F.round(c, 6)
#: Choices of eps and of min_samples; the one that conditions C and D use.
EPS, LEAST, MAIN = (3.0, 4.5, 6.0), (2, 3, 5), (4.5, 3)
REPS = 50
GROUP = ["alpha", "rep", "step", "eps", "min_samples"]


def points(spark, sf) -> DataFrame:
    """alpha, rep, step, id, x, y, vx, vy"""
    return A.frames(spark, sf).select(F.col("run").cast("int").alias("alpha"), F.pmod("boid_id", F.lit(3)).cast("int").alias("rep"), "step", F.col("boid_id").alias("id"), "x", "y", "vx", "vy")


def frame_classes(spark, sf, grid=tuple((e, m) for e in EPS for m in LEAST)) -> DataFrame:
    """Of each frame under each choice of the grid: polarization, clusters, the share of points in them, the largest one's polarization (smallest
    label of equals), that of all clustered points, mode by the largest cluster and by all points, coherence."""
    p = points(spark, sf)
    lab = density.dbscan_grid(p, list(grid), keys=("alpha", "rep", "step"))
    d = lab.select(*GROUP, "id", "label").join(p.select("alpha", "rep", "step", "id", "vx", "vy").hint("merge"), ["alpha", "rep", "step", "id"])
    speed = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)
    unit = lambda c: F.sum(F.col(c) / F.when(speed == 0, 1e-10).otherwise(speed))
    one = d.groupBy(*GROUP, "label").agg(F.count("*").alias("n"), unit("vx").alias("ux"), unit("vy").alias("uy"))
    pol = lambda n, x, y: F.sqrt((x / n) ** 2 + (y / n) ** 2)
    of = F.col("label") >= 0
    total = lambda c, w=None: F.sum(F.col(c) if w is None else F.when(w, F.col(c)))
    best = F.min_by(F.struct("n", "ux", "uy"), F.when(of, F.struct(-F.col("n"), F.col("label"))))
    g = one.groupBy(*GROUP).agg(pol(total("n"), total("ux"), total("uy")).alias("polarization"), F.count(F.when(of, 1)).alias("n_flocks"), (F.coalesce(total("n", of), F.lit(0)) / total("n")).alias("clustered"), best.alias("b"), pol(total("n", of), total("ux", of), total("uy", of)).alias("clustered_polarization"))
    g = g.withColumn("flock_polarization", F.when(F.col("n_flocks") > 0, pol(F.col("b.n"), F.col("b.ux"), F.col("b.uy")))).drop("b")
    mode = S.mode(F.col("clustered"), F.col("flock_polarization"))
    forming = S.mode(F.col("clustered"), F.col("polarization"), "forming")
    coherence = F.when(F.col("n_flocks") == 0, "low").otherwise(S.three_way(F.col("clustered_polarization"), 0.4, 0.7))
    return g.select("*", mode.alias("mode"), forming.alias("mode_forming"), coherence.alias("coherence"))


def mode_class(spark, sf):
    """Modes and coherence of the frames under the main choice."""
    g = frame_classes(spark, sf, [MAIN])
    return g.select("alpha", "rep", "step", "n_flocks", R6("clustered").alias("clustered"), R6("flock_polarization").alias("flock_polarization"), R6("clustered_polarization").alias("clustered_polarization"), "mode", "mode_forming", "coherence")


def dbscan_grid(spark, sf):
    """Every choice of eps and min_samples, clustered: frames, mean number of clusters, mean share of clustered points."""
    return frame_classes(spark, sf).groupBy("eps", "min_samples").agg(F.count("*").alias("frames"), R6(F.avg("n_flocks")).alias("n_flocks"), R6(F.avg("clustered")).alias("clustered"))


def experiment(spark, sf, **choices) -> DataFrame:
    """-> g, alpha, rep, value: mutual information of successive macro-states. g: A (ten bins of polarization), B (three), and for
    each choice C (clusters and mode) and D (and coherence) with its numbers."""
    f = frame_classes(spark, sf, **choices)
    name = lambda c: F.format_string(f"{c}|%.1f|%d", "eps", "min_samples")
    tenth = S.digitize(R6("polarization"), F.array(*[F.lit(k / 10) for k in range(1, 10)])).cast("string")
    main = (F.col("eps") == MAIN[0]) & (F.col("min_samples") == MAIN[1])
    states = F.array(
        F.when(main, F.struct(F.lit("A").alias("g"), tenth.alias("state"))), F.when(main, F.struct(F.lit("B").alias("g"), S.three_way(R6("polarization"), 0.4, 0.7).alias("state"))),
        F.struct(name("C").alias("g"), F.concat_ws("|", "n_flocks", "mode").alias("state")), F.struct(name("D").alias("g"), F.concat_ws("|", "n_flocks", "mode", "coherence").alias("state")),
    )
    s = f.select("alpha", "rep", "step", F.explode(F.filter(states, lambda x: x.isNotNull())).alias("s")).select("s.g", "alpha", "rep", "step", "s.state")
    mi = info.mutual_information(info.pairs(s, ["g", "alpha", "rep"], "step", "state"), ["g", "alpha", "rep"])
    return mi.select("g", "alpha", "rep", F.round("mi", 9).alias("value"))


def condition_mi(spark, sf):
    """Mean and deviation of each condition's mutual information by level."""
    return experiment(spark, sf).groupBy("g", "alpha").agg(R6(F.avg("value")).alias("mean"), R6(F.stddev_samp("value")).alias("std"))


def analyse(rows: DataFrame) -> DataFrame:
    """rows(g, alpha, rep, value) -> g, critical_alpha, jump, cohens_d, ci_low, ci_high, p_value; not rounded, as tables round by their format.

    The critical level is the change point of the largest jump between its neighbours; without one, where the smoothed means bend
    most, two from the ends (jump 0). Effect and interval (population variances) need more than two rows a side, else they are 0;
    the permutation test needs two, else p is 1."""
    rows, w = saved(rows), series.by(["g"], "alpha")
    m = rows.groupBy("g", "alpha").agg(F.round(F.avg("value"), 9).alias("y"))
    m = m.withColumn("sm", series.rolling_mean("y", w)).withColumn("d1", series.gradient("sm", "alpha", w))
    m = m.withColumn("d2", F.round(F.abs(series.gradient("d1", "alpha", w)), 9)).withColumn("jump", F.round(F.abs(F.lead("y").over(w) - F.lag("y").over(w)), 9))
    m = m.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("g")))
    m = saved(m)
    found = change_points_of(m.select("g", "alpha", "y"), "g string, alpha int")
    pick = m.join(found, ["g", "alpha"]).where("jump > 0").groupBy("g").agg(F.min_by(F.struct("alpha", "jump"), F.struct(-F.col("jump"), F.col("i"))).alias("a"))
    bend = m.where("n > 4 and i > 2 and i <= n - 2").groupBy("g").agg(F.min_by("alpha", F.struct(-F.col("d2"), F.col("i"))).alias("b"))
    at = rows.select("g").distinct().join(pick, "g", "left").join(bend, "g", "left").select("g", F.coalesce("a.alpha", "b").alias("critical_alpha"), F.coalesce("a.jump", F.lit(0.0)).alias("jump"))
    at = saved(at)
    s = rows.join(at, "g").withColumn("before", F.coalesce(F.col("alpha") < F.col("critical_alpha"), F.lit(False)))
    d = lambda before: S.cohens_d(F.col("value"), before, population=True)
    nb, na = F.count(F.when(F.col("before"), 1)), F.count(F.when(~F.col("before"), 1))
    diff = lambda side: F.round(F.abs(F.avg(F.when(side, F.col("value"))) - F.avg(F.when(~side, F.col("value")))), 9)
    seen = s.groupBy("g").agg(F.first("critical_alpha").alias("critical_alpha"), F.first("jump").alias("jump"), d(F.col("before")).alias("d"), nb.alias("nb"), na.alias("na"), diff(F.col("before")).alias("observed"))
    boot = series.resampled(s.select("g", F.when(F.col("before"), "b").otherwise("a").alias("side"), "value"), ["g", "side"], REPS, 11)
    boot = boot.groupBy("g", "rep").agg(d(F.col("side") == "b").alias("d")).groupBy("g").agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))
    key = F.md5(F.concat_ws("|", F.lit("p"), "k", "g", "alpha", "rep"))
    perm = s.withColumn("nb", F.count(F.when(F.col("before"), 1)).over(Window.partitionBy("g"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1))))
    perm = perm.withColumn("side", F.row_number().over(Window.partitionBy("g", "k").orderBy(key)) <= F.col("nb")).groupBy("g", "k").agg(diff(F.col("side")).alias("null"))
    p = perm.join(seen.select("g", "observed"), "g").groupBy("g").agg(F.greatest(F.avg((F.col("null") >= F.col("observed")).cast("double")), F.lit(1 / REPS)).alias("p"))
    out = seen.join(boot, "g").join(p, "g")
    enough = (F.col("nb") > 2) & (F.col("na") > 2)
    r = lambda c: F.when(enough, F.col(c)).otherwise(0.0)
    return out.select("g", "critical_alpha", "jump", r("d").alias("cohens_d"), r("low").alias("ci_low"), r("high").alias("ci_high"), F.when((F.col("nb") >= 2) & (F.col("na") >= 2), F.col("p")).otherwise(1.0).alias("p_value"))


_MAIN = f"{MAIN[0]}|{MAIN[1]}"


def main_conditions(spark, sf) -> DataFrame:
    """B, C and D under the main choice; A is measured and not analysed."""
    e = experiment(spark, sf, grid=[MAIN]).where(F.col("g").isin("B", f"C|{_MAIN}", f"D|{_MAIN}"))
    return e.withColumn("g", F.substring("g", 1, 1))


def condition_analysis(spark, sf):
    a = analyse(main_conditions(spark, sf))
    return a.select("g", "critical_alpha", R6("jump").alias("jump"), *[F.round(c, 4).alias(c) for c in ("cohens_d", "ci_low", "ci_high")], "p_value")


def verdict_conditions(spark, sf):
    """A jump (d over .5 and p under .05) under C and not under B validates the classification, one under B is an artifact of binning."""
    jump = (F.col("cohens_d") > 0.5) & (F.col("p_value") < 0.05)
    v = analyse(main_conditions(spark, sf)).agg(F.max(F.when(F.col("g") == "B", jump)).alias("b"), F.max(F.when(F.col("g") == "C", jump)).alias("c"))  # three rows
    return v.select(F.when(F.col("c") & ~F.col("b"), "STRUCTURAL_CLASSIFICATION_VALIDATED").when(F.col("b"), "DISCRETIZATION_ARTIFACT").otherwise("NO_EFFECT").alias("verdict"))


def summary_table(spark, sf):
    """The analysis as text."""
    a = analyse(main_conditions(spark, sf))
    alpha = F.when(F.coalesce("critical_alpha", F.lit(0)) == 0, "N/A").otherwise(F.format_string("%.3f", F.col("critical_alpha").cast("double")))
    return a.select(F.col("g").alias("condition"), alpha.alias("changepoint"), F.format_string("%.4f", "jump").alias("jump"), F.format_string("%.3f", "cohens_d").alias("cohens_d"), F.format_string("[%.3f, %.3f]", "ci_low", "ci_high").alias("ci"), F.format_string("%.4f", "p_value").alias("p"))


def robustness_table(spark, sf):
    """The analysis of condition C under each choice of eps and min_samples, as text."""
    e = experiment(spark, sf).where(F.col("g").startswith("C"))
    alpha = F.when(F.coalesce("critical_alpha", F.lit(0)) == 0, "N/A").otherwise(F.format_string("%.3f", F.col("critical_alpha").cast("double")))
    part = F.split("g", r"\|")
    return analyse(e).select(part[1].cast("double").alias("eps"), part[2].cast("int").alias("min_samples"), alpha.alias("critical_alpha"), F.format_string("%.3f", "cohens_d").alias("cohens_d"))


FR = A.SQL["frames"]
_GRID = " UNION ALL ".join(f"SELECT {e}::DOUBLE AS eps, {m} AS min_samples, {i} AS c" for i, (e, m) in enumerate((e, m) for e in EPS for m in LEAST))
CLASSES = f"""{FR}, grid AS ({_GRID}),
 q AS (SELECT (c::BIGINT*16+step)*1000000000+boid_id AS id, label0 AS alpha, CAST(boid_id%3 AS INT) AS rep, step, boid_id, eps, min_samples, c, x, y, vx, vy FROM (SELECT CAST(run AS INT) AS label0, * FROM frames), grid),
 e AS (SELECT a.id AS i, b.id AS j FROM q a JOIN q b ON a.c=b.c AND a.alpha=b.alpha AND a.rep=b.rep AND a.step=b.step AND a.id<>b.id AND sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))<=a.eps),
 core AS (SELECT q.id FROM q LEFT JOIN (SELECT i, count(*) AS n FROM e GROUP BY i) ON i=q.id WHERE coalesce(n,0)+1>=min_samples), l AS (SELECT i, j FROM e WHERE i IN (FROM core) AND j IN (FROM core)),
 r(id, root) AS (SELECT id, id FROM core UNION SELECT l.i, r.root FROM r JOIN l ON l.j=r.id),
 lab AS (SELECT id, min(root) AS label FROM r GROUP BY id), bor AS (SELECT e.i AS id, min(lab.label) AS b FROM e JOIN lab ON lab.id=e.j GROUP BY e.i),
 d AS (SELECT q.*, coalesce(lab.label, bor.b, -1) AS label FROM q LEFT JOIN lab USING (id) LEFT JOIN bor USING (id)),
 o AS (SELECT alpha, rep, step, eps, min_samples, label, count(*) AS n, sum(vx/({UNIT})) AS ux, sum(vy/({UNIT})) AS uy FROM d GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY alpha, rep, step, eps, min_samples ORDER BY label<0, n DESC, label) AS k FROM o),
 z AS (SELECT alpha, rep, step, eps, min_samples, sqrt(pow(sum(ux)/sum(n),2)+pow(sum(uy)/sum(n),2)) AS polarization, count(*) FILTER (label>=0) AS n_flocks, coalesce(sum(n) FILTER (label>=0),0)/sum(n) AS clustered,
  sqrt(pow(sum(ux) FILTER (label>=0)/sum(n) FILTER (label>=0),2)+pow(sum(uy) FILTER (label>=0)/sum(n) FILTER (label>=0),2)) AS clustered_polarization, max(sqrt(pow(ux/n,2)+pow(uy/n,2))) FILTER (k=1 AND label>=0) AS flock_polarization FROM k GROUP BY ALL),
 f AS (SELECT *, CASE WHEN clustered<0.5 THEN 'dispersed' WHEN flock_polarization>0.6 THEN 'migrating' ELSE 'milling' END AS mode, CASE WHEN clustered<0.5 THEN 'dispersed' WHEN polarization>0.6 THEN 'migrating' ELSE 'forming' END AS mode_forming,
  CASE WHEN n_flocks=0 OR clustered_polarization<0.4 THEN 'low' WHEN clustered_polarization<0.7 THEN 'medium' ELSE 'high' END AS coherence FROM z)"""
_ON = f"eps={MAIN[0]} AND min_samples={MAIN[1]}"
EXPERIMENT = f"""{CLASSES}, st AS (SELECT 'A' AS g, alpha, rep, step, CAST({"+".join(f"(round(polarization,6)>={k / 10})::INT" for k in range(1, 10))} AS VARCHAR) AS state FROM f WHERE {_ON}
  UNION ALL SELECT 'B', alpha, rep, step, CASE WHEN round(polarization,6)<0.4 THEN 'low' WHEN round(polarization,6)<0.7 THEN 'medium' ELSE 'high' END FROM f WHERE {_ON}
  UNION ALL SELECT printf('C|%.1f|%d',eps,min_samples), alpha, rep, step, n_flocks||'|'||mode FROM f UNION ALL SELECT printf('D|%.1f|%d',eps,min_samples), alpha, rep, step, n_flocks||'|'||mode||'|'||coherence FROM f),
 nx AS (SELECT g, alpha, rep, state AS s, lead(state) OVER (PARTITION BY g, alpha, rep ORDER BY step) AS t FROM st),
 jc AS (SELECT g, alpha, rep, s, t, count(*) AS c FROM nx WHERE t IS NOT NULL GROUP BY ALL),
 mc AS (SELECT *, sum(c) OVER (PARTITION BY g, alpha, rep) AS n, sum(c) OVER (PARTITION BY g, alpha, rep, s) AS cs, sum(c) OVER (PARTITION BY g, alpha, rep, t) AS ct FROM jc),
 ex AS (SELECT g, alpha, rep, round(greatest(0, sum(c/n*log2(c*n/(cs*ct)))),9) AS value FROM mc GROUP BY g, alpha, rep)"""


def change_sql(rows: str) -> str:
    """rows(g, alpha, y) -> cps(g, i): the exact penalised programme, a position at a time."""
    return f"""sn AS (SELECT g, alpha, y, CAST(row_number() OVER (PARTITION BY g ORDER BY alpha) AS INT) AS i, CAST(count(*) OVER (PARTITION BY g) AS INT) AS n FROM {rows}),
 pd AS (SELECT a.g, a.i, b.i AS j, pow(a.y-b.y,2) AS d FROM sn a JOIN sn b ON a.g=b.g), md AS (SELECT g, coalesce(median(d) FILTER (d>0),1.0) AS med FROM pd GROUP BY g),
 kk AS (SELECT pd.g, i, j, exp(-greatest(0.01,least(100.0,d/med))) AS k FROM pd JOIN md USING (g)),
 sg AS (SELECT a.g, CAST(x.a AS INT) AS a, a.i AS b FROM sn a, range((SELECT max(n) FROM sn)) x(a) WHERE x.a<=a.i-2),
 sc AS (SELECT sg.g, sg.a, sg.b, (sg.b-sg.a)-sum(k)/(sg.b-sg.a) AS c FROM sg JOIN kk ON kk.g=sg.g AND kk.i>sg.a AND kk.i<=sg.b AND kk.j>sg.a AND kk.j<=sg.b GROUP BY sg.g, sg.a, sg.b),
 cl AS (SELECT g, b, list(c ORDER BY a) AS cs FROM sc GROUP BY g, b),
 dp(g, b, n, best, back) AS (SELECT g, 1, any_value(n), [-1.0::DOUBLE, 'inf'::DOUBLE], [0, 0] FROM sn GROUP BY g
  UNION ALL SELECT dp.g, dp.b+1, n, list_append(best, list_min(list_transform(cs, lambda c, i: best[i]+c+1.0))), list_append(back, CAST(list_position(list_transform(cs, lambda c, i: best[i]+c+1.0), list_min(list_transform(cs, lambda c, i: best[i]+c+1.0)))-1 AS INT)) FROM dp JOIN cl ON cl.g=dp.g AND cl.b=dp.b+1 WHERE dp.b<n),
 bt(g, p, back) AS (SELECT g, back[n+1], back FROM dp WHERE b=n UNION ALL SELECT g, back[p+1], back FROM bt WHERE p>0),
 cps AS (SELECT g, p+1 AS i FROM bt WHERE p>0)"""


_GRAD = lambda y: f"""coalesce((pow(alpha-lag(alpha) OVER w,2)*lead({y}) OVER w+(pow(lead(alpha) OVER w-alpha,2)-pow(alpha-lag(alpha) OVER w,2))*{y}-pow(lead(alpha) OVER w-alpha,2)*lag({y}) OVER w)/((alpha-lag(alpha) OVER w)*(lead(alpha) OVER w-alpha)*(lead(alpha) OVER w-lag(alpha) OVER w)),
 (lead({y}) OVER w-{y})/(lead(alpha) OVER w-alpha), ({y}-lag({y}) OVER w)/(alpha-lag(alpha) OVER w))"""  # noqa: E731
_W = "WINDOW w AS (PARTITION BY g ORDER BY alpha)"


def _d(v: str, before: str) -> str:
    b, a = f"FILTER ({before})", f"FILTER (NOT ({before}))"
    pooled = f"sqrt(((count(*) {b}-1)*var_pop({v}) {b}+(count(*) {a}-1)*var_pop({v}) {a})/(count(*)-2))"
    return f"CASE WHEN count(*) {b}<2 OR count(*) {a}<2 THEN 0.0 WHEN {pooled}<1e-10 THEN 0.0 ELSE (avg({v}) {a}-avg({v}) {b})/{pooled} END"


def analysis_sql(rows: str) -> str:
    """rows(g, alpha, rep, value) -> an(g, critical_alpha, jump, cohens_d, ci_low, ci_high, p_value)."""
    return f"""rw AS ({rows}), my AS (SELECT g, alpha, round(avg(value),9) AS y FROM rw GROUP BY g, alpha), {change_sql("my")},
 m1 AS (SELECT *, avg(y) OVER (PARTITION BY g ORDER BY alpha ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm FROM sn), m2 AS (SELECT *, {_GRAD("sm")} AS d1 FROM m1 {_W}),
 m3 AS (SELECT *, round(abs({_GRAD("d1")}),9) AS d2, round(abs(lead(y) OVER w-lag(y) OVER w),9) AS jump FROM m2 {_W}),
 pk AS (SELECT g, alpha, jump, row_number() OVER (PARTITION BY g ORDER BY jump DESC, i) AS k FROM m3 JOIN cps USING (g, i) WHERE jump>0),
 bd AS (SELECT g, alpha, row_number() OVER (PARTITION BY g ORDER BY d2 DESC, i) AS k FROM m3 WHERE n>4 AND i>2 AND i<=n-2),
 cr AS (SELECT x.g, coalesce(pk.alpha, bd.alpha) AS critical_alpha, coalesce(pk.jump, 0.0) AS jump FROM (SELECT DISTINCT g FROM rw) x LEFT JOIN pk ON pk.g=x.g AND pk.k=1 LEFT JOIN bd ON bd.g=x.g AND bd.k=1),
 sd AS (SELECT rw.*, critical_alpha, jump, coalesce(alpha<critical_alpha, false) AS before FROM rw JOIN cr USING (g)),
 ob AS (SELECT g, any_value(critical_alpha) AS critical_alpha, any_value(jump) AS jump, {_d("value", "before")} AS d, count(*) FILTER (before) AS nb, count(*) FILTER (NOT before) AS na, round(abs(avg(value) FILTER (before)-avg(value) FILTER (NOT before)),9) AS observed FROM sd GROUP BY g),
 bi AS (SELECT g, CASE WHEN before THEN 'b' ELSE 'a' END AS side, value AS v, row_number() OVER (PARTITION BY g, before ORDER BY value)-1 AS i, count(*) OVER (PARTITION BY g, before) AS n FROM sd),
 bd2 AS (SELECT g, side, rep, CAST(floor((('0x'||substr(md5('11|'||g||'|'||side||'|'||rep||'|'||i),1,8))::BIGINT/4294967296.0)*n) AS BIGINT) AS i FROM bi, range({REPS}) x(rep)),
 bs AS (SELECT bd2.g, bd2.rep, {_d("v", "bd2.side='b'")} AS d FROM bd2 JOIN bi ON bi.g=bd2.g AND bi.side=bd2.side AND bi.i=bd2.i GROUP BY bd2.g, bd2.rep),
 ci AS (SELECT g, quantile_cont(d,0.025) AS low, quantile_cont(d,0.975) AS high FROM bs GROUP BY g),
 pm AS (SELECT g, k, value, row_number() OVER (PARTITION BY g, k ORDER BY md5('p|'||k||'|'||g||'|'||alpha||'|'||rep))<=count(*) FILTER (before) OVER (PARTITION BY g, k) AS side FROM sd, range({REPS}) x(k)),
 pn AS (SELECT g, k, round(abs(avg(value) FILTER (side)-avg(value) FILTER (NOT side)),9) AS d FROM pm GROUP BY g, k),
 pv AS (SELECT g, greatest(avg(CASE WHEN pn.d>=observed THEN 1.0::DOUBLE ELSE 0 END), {1 / REPS}) AS p FROM pn JOIN ob USING (g) GROUP BY g),
 an AS (SELECT g, critical_alpha, jump, CASE WHEN nb>2 AND na>2 THEN d ELSE 0.0 END AS cohens_d, CASE WHEN nb>2 AND na>2 THEN low ELSE 0.0 END AS ci_low, CASE WHEN nb>2 AND na>2 THEN high ELSE 0.0 END AS ci_high, CASE WHEN nb>=2 AND na>=2 THEN p ELSE 1.0 END AS p_value FROM ob JOIN ci USING (g) JOIN pv USING (g))"""


_THREE = f"WITH RECURSIVE {EXPERIMENT}, " + analysis_sql(f"SELECT substr(g,1,1) AS g, alpha, rep, value FROM ex WHERE g IN ('B','C|{_MAIN}','D|{_MAIN}')")
_ALPHA = "CASE WHEN coalesce(critical_alpha,0)=0 THEN 'N/A' ELSE printf('%.3f',critical_alpha::DOUBLE) END"
QUERIES = {f.__name__: f for f in (mode_class, dbscan_grid, condition_mi, condition_analysis, verdict_conditions, summary_table, robustness_table)}
ORACLE = {
    "pelt_changepoints": f"WITH RECURSIVE {MEANS}, mm AS (SELECT run AS g, alpha, round(y,6) AS y FROM m), {change_sql('mm')} SELECT g AS run, alpha FROM cps JOIN sn USING (g, i)",
    "mode_class": f"WITH RECURSIVE {CLASSES} SELECT alpha, rep, step, n_flocks, round(clustered,6) AS clustered, round(flock_polarization,6) AS flock_polarization, round(clustered_polarization,6) AS clustered_polarization, mode, mode_forming, coherence FROM f WHERE {_ON}",
    "dbscan_grid": f"WITH RECURSIVE {CLASSES} SELECT eps, min_samples, count(*) AS frames, round(avg(n_flocks),6) AS n_flocks, round(avg(clustered),6) AS clustered FROM f GROUP BY eps, min_samples",
    "condition_mi": f"WITH RECURSIVE {EXPERIMENT} SELECT g, alpha, round(avg(value),6) AS mean, round(stddev_samp(value),6) AS std FROM ex GROUP BY g, alpha",
    "condition_analysis": f"{_THREE} SELECT g, critical_alpha, round(jump,6) AS jump, round(cohens_d,4) AS cohens_d, round(ci_low,4) AS ci_low, round(ci_high,4) AS ci_high, p_value FROM an",
    "verdict_conditions": f"{_THREE}, j AS (SELECT g, cohens_d>0.5 AND p_value<0.05 AS jump FROM an) SELECT CASE WHEN bool_or(jump) FILTER (g='C') AND NOT bool_or(jump) FILTER (g='B') THEN 'STRUCTURAL_CLASSIFICATION_VALIDATED' WHEN bool_or(jump) FILTER (g='B') THEN 'DISCRETIZATION_ARTIFACT' ELSE 'NO_EFFECT' END AS verdict FROM j",
    "summary_table": f"{_THREE} SELECT g AS condition, {_ALPHA} AS changepoint, printf('%.4f',jump) AS jump, printf('%.3f',cohens_d) AS cohens_d, printf('[%.3f, %.3f]',ci_low,ci_high) AS ci, printf('%.4f',p_value) AS p FROM an",
    "robustness_table": f"WITH RECURSIVE {EXPERIMENT}, " + analysis_sql("SELECT * FROM ex WHERE g LIKE 'C%'") + f" SELECT CAST(split_part(g,'|',2) AS DOUBLE) AS eps, CAST(split_part(g,'|',3) AS INT) AS min_samples, {_ALPHA} AS critical_alpha, printf('%.3f',cohens_d) AS cohens_d FROM an",
}
