"""Information measures over counts: entropy, mutual information, transfer entropy, macro-state predictability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip


def entropy(rows: DataFrame, keys: list[str], states: list[str], name: str = "entropy") -> DataFrame:
    """Shannon entropy in bits of the states in each group, by the form -sum p log2(p + 1e-10)."""
    counts = rows.groupBy(*keys, *states).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    return counts.select(*keys, p.alias("p")).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2(F.col("p") + 1e-10))).alias(name))


def pairs(rows: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Each row's state s and the next one t."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.select(*keys, order, F.col(state).alias("s"), F.lead(state).over(w).alias("t")).where(F.col("t").isNotNull())


def mutual_information(joint: DataFrame, keys: list[str], name: str = "mi") -> DataFrame:
    """Plug-in MI in bits between s and t of each group; marginals are window sums of the joint counts, so nothing is joined."""
    c = joint.groupBy(*keys, "s", "t").agg(F.count("*").alias("c"))
    total = lambda *k: F.sum("c").over(Window.partitionBy(*keys, *k))
    c = c.select(*keys, "c", total().alias("n"), total("s").alias("cs"), total("t").alias("ct"))
    return c.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("n") / (F.col("cs") * F.col("ct"))))).alias(name))


def hopping_windows(rows: DataFrame, keys: list[str], order: str, size: int, hop: int) -> DataFrame:
    """Row-count windows w of `size` rows from row w * hop on; a start counts while a row is left behind its window."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / hop)).cast("int")
    last = F.floor(F.col("_i") / hop).cast("int")
    r = r.where(last >= first).withColumn("w", F.explode(F.sequence(first, last)))
    return r.where(F.col("w") * hop < F.col("_n") - size - 1).drop("_i", "_n")


def te_delta(macro: DataFrame, keys: list[str], order: str, columns: list[str], boids, k: int = 3) -> DataFrame:
    """Predictability of the macro-state from the mean of the last k, less the micro share: P * (1 - penalty). `boids`: a column."""
    w = Window.partitionBy(*keys).orderBy(order)
    past = w.rowsBetween(-k, -1)
    m = macro.select("*", *[F.avg(c).over(past).alias(f"_m{i}") for i, c in enumerate(columns)], *[F.sum(c).over(past).alias(f"_s{i}") for i, c in enumerate(columns)], *[F.sum(F.col(c) ** 2).over(past).alias(f"_q{i}") for i, c in enumerate(columns)], F.count("*").over(past).alias("_k"), F.max(order).over(Window.partitionBy(*keys)).alias("_last"))
    n = len(columns) * k
    add = lambda p: sum((F.col(f"{p}{i}") for i in range(1, len(columns))), F.col(f"{p}0"))
    error = F.sqrt(sum(((F.col(c) - F.col(f"_m{i}")) ** 2 for i, c in enumerate(columns)), F.lit(0.0)))
    std = F.sqrt(F.greatest(add("_q") / n - (add("_s") / n) ** 2, F.lit(0.0)))
    p = clip(1 - error / (std * F.sqrt(F.lit(float(len(columns))))), 0.0, 1.0)
    penalty = 1 / (1 + F.log(1 + 12 * boids / (len(columns) * k + 1)))
    return m.where((F.col("_k") == k) & (F.col(order) < F.col("_last"))).select(*keys, order, F.when(std < 1e-10, 0.0).otherwise(clip(p * (1 - penalty), -1.0, 1.0)).alias("te_delta"))
