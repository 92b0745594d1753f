"""Regime changes along an ordered parameter: rolling means, derivatives, jumps, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform


def by(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def rolling_mean(col, w, reach: int = 1):
    """Centred, with fewer rows at the ends."""
    return F.avg(col).over(w.rowsBetween(-reach, reach))


def over(a, b):
    """a / b of doubles, b not below zero, by IEEE rules: infinite, or NaN of zero by zero, where b is zero."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def gradient(y: str, x: str, w):
    """First derivative on a grid that needn't be even; one-sided at the ends. Rows at the same x have no finite slope, as in SQL."""
    hs, hd = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    before, after = F.lag(y).over(w), F.lead(y).over(w)
    inner = over(hs * hs * after + (hd * hd - hs * hs) * F.col(y) - hd * hd * before, hs * hd * (hd + hs))
    return F.coalesce(inner, over(after - F.col(y), hd), over(F.col(y) - before, hs))


def discontinuity(means: DataFrame, keys: list[str], x: str, y: str, margin: int = 3) -> DataFrame:
    """Where the second derivative of the smoothed series is largest, `margin` rows from the ends (first wins ties), and the means of
    three rows before and from there on."""
    w = by(keys, x)
    d = means.withColumn("_s", rolling_mean(y, w))
    d = d.withColumn("_d1", gradient("_s", x, w))
    d = d.withColumn("_d2", F.round(F.abs(gradient("_d1", x, w)), 9)).withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    d = d.withColumn("before", F.avg(y).over(w.rowsBetween(-3, -1))).withColumn("after", F.avg(y).over(w.rowsBetween(0, 2)))
    inside = d.where((F.col("_n") >= 2 * margin + 1) & (F.col("_i") > margin) & (F.col("_i") <= F.col("_n") - margin))
    best = F.min_by(F.struct(x, "before", "after"), F.struct(-F.col("_d2"), F.col("_i")))
    return inside.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col(f"b.{x}").alias("critical_alpha"), "b.before", "b.after", (F.col("b.after") - F.col("b.before")).alias("magnitude"))


def resampled(rows: DataFrame, keys: list[str], reps: int, seed: int) -> DataFrame:
    """rows(*keys, value) -> `reps` samples with replacement of each group, as rep and value. Which row is drawn depends on seed, group, rep
    and place only; a group meets its draws by place, an equi-join."""
    spark = rows.sparkSession
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("value")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    draws = numbered.select(*keys, F.col("_i").alias("_slot"), "_n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    draws = draws.withColumn("_i", F.floor(uniform(F.lit(str(seed)), *keys, "rep", "_slot") * F.col("_n")).cast("int"))
    return draws.select(*keys, "rep", "_i").join(numbered.select(*keys, "_i", "value"), [*keys, "_i"]).select(*keys, "rep", "value")
