"""Exact quantiles of large groups by distributed selection: histograms are refined around the wanted ranks until few rows are left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved

#: Bars of a histogram; rows around a rank that are few enough to be sorted.
BARS, FEW = 256, 1 << 15


def quantiles(rows: DataFrame, keys: list[str], value: str, at: list[float], name: str = "quantiles", *, bars: int = BARS, few: int = FEW) -> DataFrame:
    """-> *keys, name: array of the quantiles of each group, interpolated between the two nearest ranks; bit for bit `percentile`.

    No task or buffer holds a group: a round counts, for each group and wanted rank, the rows of `bars` equal parts of the range that
    still holds it, with each part's own least and greatest value, and goes on with the part that has the rank. It ends when that part
    is a single value or has at most `few` rows, which are then sorted. Parts are monotone in the value, so rounding moves no rank.

    Null values are left out, a group without others has null; NaN is greater than all numbers; null keys are a group of their own."""
    k = [f"_k{i}" for i in range(len(keys))]
    of = rows.select(*[F.col(c).alias(n) for c, n in zip(keys, k, strict=True)], F.col(value).cast("double").alias("_v"))
    number = F.when(~F.isnan("_v"), F.col("_v"))
    groups = saved(of.groupBy(*k).agg(F.count("_v").alias("_n"), F.count(number).alias("_m"), F.min(number).alias("_lo"), F.max(number).alias("_hi")))
    place = lambda q: (F.col("_n") - 1) * F.lit(q)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in at])))
    ranks = groups.where("_n > 0").select(*k, "_m", "_lo", "_hi", F.explode(wanted).alias("_r"))
    done = ranks.where("_r >= _m").select(*k, "_r", F.lit(float("nan")).alias("_q"))
    # a range that holds a rank: how many rows are below it and within it
    open_ = saved(ranks.where("_r < _m").select(*k, "_r", "_lo", "_hi", F.lit(0).cast("bigint").alias("_below"), F.col("_m").alias("_c")))
    left, few_left = of.where("_v is not null and not isnan(_v)"), []
    while True:
        done = done.unionAll(open_.where("_lo = _hi").select(*k, "_r", F.col("_lo").alias("_q")))
        wide = open_.where(F.col("_lo") < F.col("_hi"))
        open_ = wide.where(F.col("_c") > few)
        few_left.append(wide.where(F.col("_c") <= few))
        if open_.isEmpty():
            break
        # ranks in one range are looked for once
        ranges = open_.select(*[F.col(c).alias(f"b{c}") for c in k], "_lo", "_hi").distinct()
        near = left.join(ranges, _all(F.col(c).eqNullSafe(F.col(f"b{c}")) for c in k) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        bar = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bars), F.lit(bars - 1))
        seen = near.groupBy(*k, "_lo", "_hi", bar.alias("_bar")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        w = Window.partitionBy(*k, "_lo", "_hi").orderBy("_bar")
        seen = seen.withColumn("_before", F.sum("_c").over(w) - F.col("_c"))
        o = open_.select(*[F.col(c).alias(f"b{c}") for c in k], "_r", F.col("_lo").alias("_l"), F.col("_hi").alias("_h"), "_below")
        hit = seen.join(o, _all(F.col(c).eqNullSafe(F.col(f"b{c}")) for c in k) & (F.col("_lo") == F.col("_l")) & (F.col("_hi") == F.col("_h")))
        hit = hit.where((F.col("_r") >= F.col("_below") + F.col("_before")) & (F.col("_r") < F.col("_below") + F.col("_before") + F.col("_c")))
        open_ = saved(hit.select(*k, "_r", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), (F.col("_below") + F.col("_before")).alias("_below"), "_c"))
    done = done.unionAll(_sorted(left, reduce(DataFrame.unionAll, few_left), k))
    found = done.groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_q"))).alias("_q"))  # a few ranks a group
    f = found.select(*[F.col(c).alias(f"b{c}") for c in k], "_q")
    out = groups.join(f, _all(F.col(c).eqNullSafe(F.col(f"b{c}")) for c in k), "left")
    out = out.select(*k, "_n", "_q")

    def between(q: float):
        low, high = F.floor(place(q)), F.ceil(place(q))
        a, b = F.element_at("_q", low), F.element_at("_q", high)
        return F.when(low == high, a).when(a == b, a).otherwise((high - place(q)) * a + (place(q) - low) * b)

    answer = F.when(F.col("_n") > 0, F.array(*[between(q) for q in at])).alias(name)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keys, k, strict=True)], answer)


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _sorted(rows: DataFrame, ranges: DataFrame, k: list[str]) -> DataFrame:
    """The wanted ranks of ranges with few rows: each range is sorted once, for all its ranks."""
    same = lambda names: _all(F.col(c).eqNullSafe(F.col(f"b{c}")) for c in names)
    r = ranges.select(*[F.col(c).alias(f"b{c}") for c in (*k, "_lo", "_hi")], "_r", "_below")
    spans = r.select(*[f"b{c}" for c in k], F.col("b_lo").alias("_lo"), F.col("b_hi").alias("_hi")).distinct()
    near = rows.join(spans, same(k) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
    got = near.groupBy(*k, "_lo", "_hi").agg(F.sort_array(F.collect_list("_v")).alias("_s"))  # at most `few`
    return got.join(r, same([*k, "_lo", "_hi"])).select(*k, "_r", F.get("_s", (F.col("_r") - F.col("_below")).cast("int")).alias("_q"))
