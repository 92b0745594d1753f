"""Queries over parameter sweeps: summaries, derivatives, effect sizes, resampling tests, verdicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import series
from ..operators.breaks import change_points
from ..sources import adapters as A

R4 = lambda c: F.round(c, 4)
SW = A.SQL["sweep"]
CUT = 0.05
MEANS = f"{SW}, m AS (SELECT run, alpha, avg(metric) AS y FROM sweep GROUP BY run, alpha)"


def means(spark, sf) -> DataFrame:
    return A.sweep(spark, sf).groupBy("run", "alpha").agg(F.avg("metric").alias("y"))


def sweep_summary_samp(spark, sf):
    return A.sweep(spark, sf).groupBy("alpha").agg(F.count("*").alias("n"), R4(F.avg("metric")).alias("mean"), R4(F.stddev_samp("metric")).alias("std"))


def sweep_summary_pop(spark, sf):
    return A.sweep(spark, sf).groupBy("alpha").agg(F.count("*").alias("n"), R4(F.avg("metric")).alias("mean"), R4(F.stddev_pop("metric")).alias("std"))


def along():
    return series.by(["run"], "alpha")


def rolling_mean_centered(spark, sf):
    return means(spark, sf).select("run", "alpha", R4(series.rolling_mean("y", along())).alias("rolling"))


def gradient(spark, sf):
    return means(spark, sf).select("run", "alpha", R4(series.gradient("y", "alpha", along())).alias("d1"))


def second_derivative(spark, sf):
    d = means(spark, sf).withColumn("d1", series.gradient("y", "alpha", along()))
    return d.select("run", "alpha", F.round(series.gradient("d1", "alpha", along()), 2).alias("d2"))


def adjacent_diff(spark, sf):
    d = means(spark, sf).withColumn("d", F.abs(F.col("y") - F.lag("y").over(along())))
    return d.groupBy("run").agg(R4(F.max("d")).alias("largest"))


def neighbor_jump(spark, sf):
    d = means(spark, sf).withColumn("jump", F.abs(F.lead("y").over(along()) - F.lag("y").over(along())))
    return d.where(F.col("jump").isNotNull()).select("run", "alpha", R4("jump").alias("jump"))


def discontinuity_point(spark, sf):
    d = series.discontinuity(means(spark, sf), ["run"], "alpha", "y")
    return d.select("run", "critical_alpha", R4("before").alias("before"), R4("after").alias("after"), R4("magnitude").alias("magnitude"))


G = lambda y, a="alpha": f"""coalesce((pow({a}-lag({a}) OVER w,2)*lead({y}) OVER w+(pow(lead({a}) OVER w-{a},2)-pow({a}-lag({a}) OVER w,2))*{y}-pow(lead({a}) OVER w-{a},2)*lag({y}) OVER w)/(({a}-lag({a}) OVER w)*(lead({a}) OVER w-{a})*(lead({a}) OVER w-lag({a}) OVER w)),
 (lead({y}) OVER w-{y})/(lead({a}) OVER w-{a}), ({y}-lag({y}) OVER w)/({a}-lag({a}) OVER w))"""  # noqa: E731
WIN = "WINDOW w AS (PARTITION BY run ORDER BY alpha)"
DISC = f"""WITH {MEANS}, s AS (SELECT *, avg(y) OVER (PARTITION BY run ORDER BY alpha ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm, avg(y) OVER (PARTITION BY run ORDER BY alpha ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before,
 avg(y) OVER (PARTITION BY run ORDER BY alpha ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS after, row_number() OVER (PARTITION BY run ORDER BY alpha) AS i, count(*) OVER (PARTITION BY run) AS n FROM m),
 d AS (SELECT *, {G("sm")} AS d1 FROM s {WIN}), e AS (SELECT *, round(abs({G("d1")}),9) AS d2 FROM d {WIN}),
 f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY d2 DESC, i) AS k FROM e WHERE n>=7 AND i>3 AND i<=n-3)
 SELECT run, alpha AS critical_alpha, round(before,4) AS before, round(after,4) AS after, round(after-before,4) AS magnitude FROM f WHERE k=1"""


def before_after_means(spark, sf):
    """Means of the three points before and from each point on."""
    w = along()
    d = means(spark, sf).select("run", "alpha", F.avg("y").over(w.rowsBetween(-3, -1)).alias("before"), F.avg("y").over(w.rowsBetween(0, 2)).alias("after"))
    return d.select("run", "alpha", R4("before").alias("before"), R4("after").alias("after"))


def cohens_d_samp(spark, sf):
    return A.sweep(spark, sf).groupBy("run").agg(R4(S.cohens_d(F.col("metric"), F.col("alpha") < CUT)).alias("d"))


def cohens_d_pop(spark, sf):
    return A.sweep(spark, sf).groupBy("run").agg(R4(S.cohens_d(F.col("metric"), F.col("alpha") < CUT, population=True)).alias("d"))


def _d(var: str) -> str:
    v = lambda c: f"{var}(metric) FILTER (alpha{c}{CUT})"
    n = lambda c: f"count(metric) FILTER (alpha{c}{CUT})"
    return f"(avg(metric) FILTER (alpha>={CUT})-avg(metric) FILTER (alpha<{CUT}))/sqrt((({n('<')}-1)*{v('<')}+({n('>=')}-1)*{v('>=')})/({n('<')}+{n('>=')}-2))"


def linear_fit(spark, sf):
    return A.sweep(spark, sf).groupBy("run").agg(F.round(F.regr_slope("metric", "alpha"), 3).alias("slope"), F.round(F.regr_intercept("metric", "alpha"), 3).alias("intercept"))


def threshold_split(spark, sf):
    before = F.col("alpha") < CUT
    return A.sweep(spark, sf).groupBy("run").agg(F.count(F.when(before, 1)).alias("n_before"), F.count(F.when(~before, 1)).alias("n_after"), R4(F.avg(F.when(before, F.col("metric")))).alias("before"), R4(F.avg(F.when(~before, F.col("metric")))).alias("after"))


REPS = 50


def permutation_rows(spark, sf) -> DataFrame:
    """Means by (run, alpha) as the samples; side: before or after the cut."""
    return means(spark, sf).select("run", F.round("y", 6).alias("y"), F.col("alpha"), (F.col("alpha") < CUT).alias("before"))


def permutation_pvalue(spark, sf):
    """Share of REPS relabellings whose difference of means is no smaller; 1 / REPS at least. A relabelling ranks rows by a hash of (rep, run, alpha)."""
    rows = permutation_rows(spark, sf)
    nb = F.count(F.when(F.col("before"), 1)).over(Window.partitionBy("run"))
    reps = rows.withColumn("nb", nb).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1))))
    key = F.md5(F.concat_ws("|", F.lit("p"), "rep", "run", F.round(F.col("alpha") * 100).cast("int")))
    reps = reps.withColumn("side", F.row_number().over(Window.partitionBy("run", "rep").orderBy(key)) <= F.col("nb"))
    diff = lambda side: F.round(F.abs(F.avg(F.when(side, F.col("y"))) - F.avg(F.when(~side, F.col("y")))), 6)
    null = reps.groupBy("run", "rep").agg(diff(F.col("side")).alias("d"))
    seen = rows.groupBy("run").agg(diff(F.col("before")).alias("observed"))
    out = null.join(seen, "run").groupBy("run").agg(F.first("observed").alias("observed"), F.avg((F.col("d") >= F.col("observed")).cast("double")).alias("p"))
    return out.select("run", R4("observed").alias("observed"), F.greatest("p", F.lit(1 / REPS)).alias("p_value"))


PERM = f"""WITH {MEANS}, r AS (SELECT run, alpha, round(y,6) AS y, alpha<{CUT} AS before FROM m), q AS (SELECT r.*, rep, count(*) FILTER (before) OVER (PARTITION BY run, rep) AS nb FROM r, range({REPS}) x(rep)),
 k AS (SELECT *, row_number() OVER (PARTITION BY run, rep ORDER BY md5('p|'||rep||'|'||run||'|'||CAST(round(alpha*100) AS INT)))<=nb AS side FROM q),
 n AS (SELECT run, rep, round(abs(avg(y) FILTER (side)-avg(y) FILTER (NOT side)),6) AS d FROM k GROUP BY run, rep), o AS (SELECT run, round(abs(avg(y) FILTER (before)-avg(y) FILTER (NOT before)),6) AS observed FROM r GROUP BY run)
 SELECT run, round(any_value(observed),4) AS observed, greatest(avg(CASE WHEN d>=observed THEN 1.0::DOUBLE ELSE 0 END), {1 / REPS}) AS p_value FROM n JOIN o USING (run) GROUP BY run"""


def bootstrap_d_ci(spark, sf):
    """95 % interval of Cohen's d over REPS resamplings of each side."""
    rows = permutation_rows(spark, sf).select("run", F.when(F.col("before"), "b").otherwise("a").alias("side"), F.col("y").alias("value"))
    s = series.resampled(rows, ["run", "side"], REPS, 11)
    d = s.groupBy("run", "rep").agg(S.cohens_d(F.col("value"), F.col("side") == "b").alias("d"))
    return d.groupBy("run").agg(F.round(F.percentile("d", F.lit(0.025)), 3).alias("low"), F.round(F.percentile("d", F.lit(0.975)), 3).alias("high"))


_BD = "(avg(v) FILTER (side='a')-avg(v) FILTER (side='b'))/nullif(sqrt(((count(*) FILTER (side='b')-1)*var_samp(v) FILTER (side='b')+(count(*) FILTER (side='a')-1)*var_samp(v) FILTER (side='a'))/(count(*)-2)),0)"
BOOT = f"""WITH {MEANS}, r AS (SELECT run, CASE WHEN alpha<{CUT} THEN 'b' ELSE 'a' END AS side, round(y,6) AS v FROM m),
 i AS (SELECT *, row_number() OVER (PARTITION BY run, side ORDER BY v)-1 AS i, count(*) OVER (PARTITION BY run, side) AS n FROM r),
 d AS (SELECT run, side, rep, CAST(floor((('0x'||substr(md5('11|'||run||'|'||side||'|'||rep||'|'||i),1,8))::BIGINT/4294967296.0)*n) AS BIGINT) AS i FROM i, range({REPS}) x(rep)),
 s AS (SELECT d.run, d.side, d.rep, i.v FROM d JOIN i USING (run, side, i)), c AS (SELECT run, rep, {_BD} AS d FROM s GROUP BY run, rep)
 SELECT run, round(quantile_cont(d,0.025),3) AS low, round(quantile_cont(d,0.975),3) AS high FROM c GROUP BY run"""


def jump_tested(spark, sf) -> DataFrame:
    """run, critical_alpha, magnitude, p_value: the discontinuity against a straight line. The line's residuals are resampled REPS
    times; p is the share of resamplings whose smoothed steps reach the magnitude, 1 / REPS at least."""
    m = means(spark, sf).withColumn("y", F.round("y", 6))
    of = Window.partitionBy("run")
    m = m.withColumn("fit", F.regr_slope("y", "alpha").over(of) * F.col("alpha") + F.regr_intercept("y", "alpha").over(of)).withColumn("i", F.row_number().over(along()) - 1).withColumn("n", F.count("*").over(of))
    draws = m.select("run", "fit", F.col("i").alias("slot"), "n", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1))).alias("rep"))
    draws = draws.withColumn("i", F.floor(S.uniform(F.lit("6"), "run", "rep", "slot") * F.col("n")).cast("int"))
    b = draws.join(m.select("run", "i", (F.col("y") - F.col("fit")).alias("residual")), ["run", "i"]).withColumn("v", F.col("fit") + F.col("residual"))
    w = Window.partitionBy("run", "rep").orderBy("slot")
    b = b.withColumn("sm", series.rolling_mean("v", w)).withColumn("d", F.abs(F.col("sm") - F.lag("sm").over(w))).groupBy("run", "rep").agg(F.round(F.max("d"), 6).alias("d"))
    at = series.discontinuity(m.select("run", "alpha", "y"), ["run"], "alpha", "y").select("run", "critical_alpha", F.round("magnitude", 6).alias("magnitude"))
    p = F.greatest(F.avg((F.col("d") >= F.abs("magnitude")).cast("double")), F.lit(1 / REPS))
    return b.join(at, "run").groupBy("run").agg(F.first("critical_alpha").alias("critical_alpha"), F.first("magnitude").alias("magnitude"), p.alias("p_value"))


def bootstrap_jump_pvalue(spark, sf):
    """The discontinuity of each run; without significance there is no critical alpha."""
    t = jump_tested(spark, sf)
    return t.select("run", F.when(F.col("p_value") < 0.05, F.col("critical_alpha")).alias("critical_alpha"), R4("magnitude").alias("magnitude"), "p_value")


def verdict_standard(spark, sf):
    """p of the discontinuity under .05, and d over .5 at its alpha: SUPPORTED; p alone: WEAK; else FALSIFIED."""
    t = jump_tested(spark, sf)
    d = A.sweep(spark, sf).join(t, "run").groupBy("run").agg(F.first("p_value").alias("p"), S.cohens_d(F.col("metric"), F.col("alpha") < F.col("critical_alpha")).alias("d"))
    word = F.when((F.col("p") < 0.05) & (F.col("d") > 0.5), "SUPPORTED").when(F.col("p") < 0.05, "WEAK").otherwise("FALSIFIED")
    return d.select("run", word.alias("verdict"))


JUMP = f"""{DISC.removeprefix("WITH ").rsplit(" SELECT run, alpha AS critical_alpha", 1)[0].replace("avg(metric) AS y FROM sweep", "round(avg(metric),6) AS y FROM sweep")},
 pt AS (SELECT run, alpha AS critical_alpha, round(after-before,6) AS magnitude FROM f WHERE k=1),
 z AS (SELECT *, regr_slope(y,alpha) OVER (PARTITION BY run)*alpha+regr_intercept(y,alpha) OVER (PARTITION BY run) AS fit FROM s),
 w AS (SELECT run, fit, i-1 AS slot, rep, CAST(floor((('0x'||substr(md5('6|'||run||'|'||rep||'|'||(i-1)),1,8))::BIGINT/4294967296.0)*n) AS BIGINT)+1 AS i FROM z, range({REPS}) x(rep)),
 v AS (SELECT w.run, w.rep, w.slot, w.fit+z.y-z.fit AS v FROM w JOIN z ON z.run=w.run AND z.i=w.i), u AS (SELECT *, avg(v) OVER (PARTITION BY run, rep ORDER BY slot ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm FROM v),
 g AS (SELECT run, rep, abs(sm-lag(sm) OVER (PARTITION BY run, rep ORDER BY slot)) AS d FROM u), b AS (SELECT run, rep, round(max(d),6) AS d FROM g GROUP BY run, rep),
 t AS (SELECT run, any_value(critical_alpha) AS critical_alpha, any_value(magnitude) AS magnitude, greatest(avg(CASE WHEN d>=abs(magnitude) THEN 1.0::DOUBLE ELSE 0 END), {1 / REPS}) AS p_value FROM b JOIN pt USING (run) GROUP BY run)"""


def plot_data(spark, sf):
    """Means and deviations of all runs as arrays along alpha, of two measures, the mean of a third, and the first's discontinuity."""
    li = A.table(spark, sf, "lineitem").withColumn("alpha", F.col("l_discount"))
    g = li.groupBy("alpha").agg(R4(F.avg("l_extendedprice")).alias("mean"), R4(F.stddev_samp("l_extendedprice")).alias("std"), R4(F.avg("l_quantity")).alias("mean2"), R4(F.stddev_samp("l_quantity")).alias("std2"), R4(F.avg("l_tax")).alias("mean3"))
    at = series.discontinuity(g.select(F.lit(1).alias("k"), "alpha", F.col("mean").alias("y")), ["k"], "alpha", "y")  # a row per alpha
    names = ("alpha", "mean", "std", "mean2", "std2", "mean3")
    g = g.agg(F.sort_array(F.collect_list(F.struct(*names))).alias("r"))  # a row per alpha
    join = lambda c: F.array_join(F.transform("r", lambda s: F.format_string("%.4f", s[c])), ",")
    return g.crossJoin(F.broadcast(at)).select(*[join(c).alias(f"{c}s") for c in names], "critical_alpha", R4("magnitude").alias("magnitude"))  # one row each


def sweep_tasks(spark, sf):
    """31 even levels between the sweep's least and greatest alpha, each with every run of it."""
    runs = A.sweep(spark, sf).select("run").distinct()
    return A.alpha_grid(runs, A.sweep(spark, sf), 31).select("alpha_idx", R4("alpha").alias("alpha"), "run")


def union_phases(spark, sf):
    """Main and robustness rows of one parameter stay apart by phase."""
    s = A.sweep(spark, sf).select("alpha", "metric", F.lit("main").alias("phase"))
    t = A.table(spark, sf, "lineitem").select(F.col("l_tax").alias("alpha"), F.col("l_extendedprice").alias("metric"), F.lit("robustness").alias("phase"))
    return s.unionByName(t).groupBy("phase", "alpha").agg(F.count("*").alias("n"), F.round(F.sum("metric"), 2).alias("total"))


def sorted_sweep(spark, sf):
    """Means in order of (alpha, run)."""
    return means(spark, sf).select("alpha", "run", R4("y").alias("y")).orderBy("alpha", "run")


def zoom(spark, sf):
    """The part of the sweep up to an alpha of .05, by level."""
    return A.sweep(spark, sf).where("alpha <= 0.05").groupBy("alpha").agg(F.count("*").alias("n"), R4(F.avg("metric")).alias("mean"))


def sweep_tasks_clustering(spark, sf):
    """Every clustering choice with 31 levels and every run; and every size and noise with ten levels and the runs up to five."""
    runs = A.sweep(spark, sf).select("run").distinct()
    choice = lambda a, b: F.explode(F.array(*[F.struct(F.lit(float(x)).alias("p"), F.lit(float(y)).alias("q")) for x in a for y in b]))
    tasks = lambda name, n, c, r: A.alpha_grid(r, A.sweep(spark, sf), n).select(F.lit(name).alias("grid"), c.alias("c"), "alpha_idx", "alpha", "run")
    one = tasks("clustering", 31, choice((10, 15, 20), (3, 5, 10)), runs)
    two = tasks("robustness", 10, choice((100, 300), (0.1, 0.2)), runs.where("run <= 5"))
    return one.unionByName(two).select("grid", "c.p", "c.q", "alpha_idx", R4("alpha").alias("alpha"), "run")


def task_configs(spark, sf):
    """Each task's settings: defaults with the task's own alpha and noise put over them, as records."""
    base = {"n_boids": 500.0, "world_size": 200.0, "alignment_weight": 1.0, "noise_std": 0.1}
    t = sweep_tasks(spark, sf).select("alpha_idx", "run", F.explode(F.array(F.lit(None).cast("double"), F.lit(0.05), F.lit(0.2))).alias("noise"), "alpha")
    c = t.select("alpha_idx", "run", *[F.lit(v).alias(k) for k, v in base.items() if k not in ("alignment_weight", "noise_std")], F.col("alpha").alias("alignment_weight"), F.coalesce("noise", F.lit(base["noise_std"])).alias("noise_std"))
    return c.select("alpha_idx", "run", "noise_std", F.format_string('{"n_boids":%.0f,"world_size":%.0f,"alignment_weight":%.4f,"noise_std":%.2f}', "n_boids", "world_size", "alignment_weight", "noise_std").alias("config"))


def filter_with_fallback(spark, sf):
    """Rows of quantity 15 and line 5 of each supplier; of suppliers without any, all rows."""
    li = A.table(spark, sf, "lineitem")
    hit = (F.col("l_quantity") == 15) & (F.col("l_linenumber") == 5)
    has = li.groupBy("l_suppkey").agg(F.max(hit).alias("has"))
    kept = li.join(has, "l_suppkey").where(hit | ~F.col("has"))
    return kept.groupBy("l_suppkey").agg(F.first("has").alias("matched"), F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


def concatenated(spark, sf):
    """Each run's values before and after the cut, as one sample each, put together again."""
    s = A.sweep(spark, sf)
    both = s.where(F.col("alpha") < CUT).select("run", "metric", F.lit("before").alias("side")).unionAll(s.where(F.col("alpha") >= CUT).select("run", "metric", F.lit("after").alias("side")))
    return both.groupBy("run").agg(F.count("*").alias("n"), F.count(F.when(F.col("side") == "before", 1)).alias("n_before"), R4(F.avg("metric")).alias("mean"))


def change_points_of(rows: DataFrame, kind: str) -> DataFrame:
    """rows(group, alpha, y) -> group, alpha of the change points; a group's series is a row per alpha, and takes memory in proportion."""
    key = rows.columns[0]

    def find(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("alpha")
        return pd.DataFrame({key: g[key].iloc[0], "alpha": g["alpha"].to_numpy()[change_points(g["y"].to_numpy())]})

    return rows.groupBy(key).applyInPandas(find, kind)


def pelt_changepoints(spark, sf):
    """Change points of each run's means."""
    return change_points_of(means(spark, sf).select("run", "alpha", F.round("y", 6).alias("y")), "run int, alpha double")


QUERIES = {f.__name__: f for f in (sweep_summary_samp, sweep_summary_pop, rolling_mean_centered, gradient, second_derivative, adjacent_diff, neighbor_jump, discontinuity_point, before_after_means, cohens_d_samp, cohens_d_pop, linear_fit, threshold_split, permutation_pvalue, bootstrap_d_ci, bootstrap_jump_pvalue, verdict_standard, plot_data, sorted_sweep, zoom, sweep_tasks, sweep_tasks_clustering, task_configs, filter_with_fallback, concatenated, union_phases, pelt_changepoints)}
_BOUNDS = "lo AS (SELECT min(l_discount) AS low, max(l_discount) AS high FROM lineitem), rn AS (SELECT DISTINCT l_linenumber AS run FROM lineitem)"
_LIST = lambda c, t: f"string_agg(printf('%.4f',{c}),',' ORDER BY alpha) AS {t}"
_PLOT = DISC.replace(MEANS, "g AS (SELECT l_discount AS alpha, round(avg(l_extendedprice),4) AS mean, round(stddev_samp(l_extendedprice),4) AS std, round(avg(l_quantity),4) AS mean2, round(stddev_samp(l_quantity),4) AS std2, round(avg(l_tax),4) AS mean3 FROM lineitem GROUP BY 1), m AS (SELECT 1 AS run, alpha, mean AS y FROM g)").rsplit(" SELECT run, alpha AS critical_alpha", 1)[0] + f", pt AS (SELECT alpha AS critical_alpha, round(after-before,4) AS magnitude FROM f WHERE k=1) SELECT {', '.join(_LIST(c, c + 's') for c in ('alpha', 'mean', 'std', 'mean2', 'std2', 'mean3'))}, any_value(critical_alpha) AS critical_alpha, any_value(magnitude) AS magnitude FROM g, pt"
_GR = "SELECT alpha, count(*) AS n, round(avg(metric),4) AS mean, round({}(metric),4) AS std FROM sweep GROUP BY alpha"
ORACLE = {
    "sweep_summary_samp": f"WITH {SW} {_GR.format('stddev_samp')}",
    "sweep_summary_pop": f"WITH {SW} {_GR.format('stddev_pop')}",
    "rolling_mean_centered": f"WITH {MEANS} SELECT run, alpha, round(avg(y) OVER (PARTITION BY run ORDER BY alpha ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING),4) AS rolling FROM m",
    "gradient": f"WITH {MEANS} SELECT run, alpha, round({G('y')},4) AS d1 FROM m {WIN}",
    "second_derivative": f"WITH {MEANS}, d AS (SELECT *, {G('y')} AS d1 FROM m {WIN}) SELECT run, alpha, round({G('d1')},2) AS d2 FROM d {WIN}",
    "adjacent_diff": f"WITH {MEANS}, d AS (SELECT run, abs(y-lag(y) OVER w) AS d FROM m {WIN}) SELECT run, round(max(d),4) AS largest FROM d GROUP BY run",
    "neighbor_jump": f"WITH {MEANS}, d AS (SELECT run, alpha, abs(lead(y) OVER w-lag(y) OVER w) AS j FROM m {WIN}) SELECT run, alpha, round(j,4) AS jump FROM d WHERE j IS NOT NULL",
    "discontinuity_point": DISC,
    "before_after_means": f"WITH {MEANS} SELECT run, alpha, round(avg(y) OVER (PARTITION BY run ORDER BY alpha ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),4) AS before, round(avg(y) OVER (PARTITION BY run ORDER BY alpha ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING),4) AS after FROM m",
    "cohens_d_samp": f"WITH {SW} SELECT run, round({_d('var_samp')},4) AS d FROM sweep GROUP BY run",
    "cohens_d_pop": f"WITH {SW} SELECT run, round(CASE WHEN count(*) FILTER (alpha<{CUT})<2 OR count(*) FILTER (alpha>={CUT})<2 THEN 0.0 ELSE {_d('var_pop')} END,4) AS d FROM sweep GROUP BY run",
    "linear_fit": f"WITH {SW} SELECT run, round(regr_slope(metric,alpha),3) AS slope, round(regr_intercept(metric,alpha),3) AS intercept FROM sweep GROUP BY run",
    "threshold_split": f"WITH {SW} SELECT run, count(*) FILTER (alpha<{CUT}) AS n_before, count(*) FILTER (alpha>={CUT}) AS n_after, round(avg(metric) FILTER (alpha<{CUT}),4) AS before, round(avg(metric) FILTER (alpha>={CUT}),4) AS after FROM sweep GROUP BY run",
    "permutation_pvalue": PERM,
    "bootstrap_d_ci": BOOT,
    "bootstrap_jump_pvalue": f"WITH {JUMP} SELECT run, CASE WHEN p_value<0.05 THEN critical_alpha END AS critical_alpha, round(magnitude,4) AS magnitude, p_value FROM t",
    "verdict_standard": f"WITH {JUMP}, c AS (SELECT sweep.*, critical_alpha, p_value, alpha<critical_alpha AS before FROM sweep JOIN t USING (run)), ef AS (SELECT run, any_value(p_value) AS p, (avg(metric) FILTER (NOT before)-avg(metric) FILTER (before))/sqrt(((count(*) FILTER (before)-1)*var_samp(metric) FILTER (before)+(count(*) FILTER (NOT before)-1)*var_samp(metric) FILTER (NOT before))/(count(*)-2)) AS d FROM c GROUP BY run) SELECT run, CASE WHEN p<0.05 AND d>0.5 THEN 'SUPPORTED' WHEN p<0.05 THEN 'WEAK' ELSE 'FALSIFIED' END AS verdict FROM ef",
    "plot_data": _PLOT,
    "sorted_sweep": f"WITH {MEANS} SELECT alpha, run, round(y,4) AS y FROM m ORDER BY alpha, run",
    "zoom": f"WITH {SW} SELECT alpha, count(*) AS n, round(avg(metric),4) AS mean FROM sweep WHERE alpha<=0.05 GROUP BY alpha",
    "sweep_tasks_clustering": f"WITH {_BOUNDS} SELECT 'clustering' AS grid, p::DOUBLE AS p, q::DOUBLE AS q, CAST(a AS INT) AS alpha_idx, round(low+a*(high-low)/30,4) AS alpha, run FROM (VALUES (10),(15),(20)) x(p), (VALUES (3),(5),(10)) y(q), range(31) z(a), rn, lo UNION ALL SELECT 'robustness', p::DOUBLE, q::DOUBLE, CAST(a AS INT), round(low+a*(high-low)/9,4), run FROM (VALUES (100),(300)) x(p), (VALUES (0.1),(0.2)) y(q), range(10) z(a), rn, lo WHERE run<=5",
    "task_configs": f"""WITH {_BOUNDS} SELECT CAST(a AS INT) AS alpha_idx, run, n::DOUBLE AS noise_std, printf('{{"n_boids":500,"world_size":200,"alignment_weight":%.4f,"noise_std":%.2f}}', round(low+a*(high-low)/30,4), n::DOUBLE) AS config FROM range(31) x(a), rn, lo, (VALUES (0.1),(0.05),(0.2)) z(n)""",
    "filter_with_fallback": "WITH h AS (SELECT *, l_quantity=15 AND l_linenumber=5 AS hit, bool_or(l_quantity=15 AND l_linenumber=5) OVER (PARTITION BY l_suppkey) AS has FROM lineitem) SELECT l_suppkey, any_value(has) AS matched, count(*) AS n, round(sum(l_extendedprice),2) AS total FROM h WHERE hit OR NOT has GROUP BY l_suppkey",
    "concatenated": f"WITH {SW} SELECT run, count(*) AS n, count(*) FILTER (alpha<{CUT}) AS n_before, round(avg(metric),4) AS mean FROM sweep GROUP BY run",
    "sweep_tasks": f"WITH {_BOUNDS} SELECT CAST(a AS INT) AS alpha_idx, round(low+a*(high-low)/30,4) AS alpha, run FROM range(31) x(a), rn, lo",
    "union_phases": "WITH u AS (SELECT 'main' AS phase, l_discount AS alpha, l_extendedprice AS metric FROM lineitem UNION ALL SELECT 'robustness', l_tax, l_extendedprice FROM lineitem) SELECT phase, alpha, count(*) AS n, round(sum(metric),2) AS total FROM u GROUP BY phase, alpha",
}
