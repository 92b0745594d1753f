"""Window functions along long series: a key's rows are cut into stretches that tasks share, and what a stretch needs of others is
carried over, so that no key sits in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import saved
from .select import _all

#: Rows of a stretch.
STRETCH = 1 << 16


def chunked(rows: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """rows with _chunk: ranges of (keys, order) of about equal numbers of rows, whatever the keys' sizes. Written once."""
    n = chunks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(rows.repartitionByRange(n, *keys, *order).withColumn("_chunk", F.spark_partition_id()))


def _joined(rows: DataFrame, small: DataFrame, on: list[str], take: str) -> DataFrame:
    """rows with `take` of the row of small with the same values, nulls among them; small has a row a chunk and key."""
    right = small.select(*[F.col(c).alias(f"_r_{c}") for c in on], take)
    return rows.join(right, _all(F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on)).drop(*[f"_r_{c}" for c in on])


def numbered(rows: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """rows with _i: each row's place among its key's, from 0. Chunks number their own rows; the rows before a chunk are added.
    `order` is total within a key."""
    p = chunked(rows, keys, order, chunks)
    on = [*keys, "_chunk"]
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    first = p.groupBy(*on).agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(before, F.lit(0).cast("bigint")))
    local = F.row_number().over(Window.partitionBy(*on).orderBy(*order)) - 1
    return _joined(p.withColumn("_local", local), first, on, "_first").withColumn("_i", F.col("_first") + F.col("_local")).drop("_chunk", "_local", "_first")


def windowed(rows: DataFrame, keys: list[str], order: list[str], reach: int, columns: Callable[[WindowSpec], dict[str, Column]], *, stretch: int = STRETCH, chunks: int | None = None) -> DataFrame:
    """rows with columns that look at most `reach` rows back and ahead, equal to those over partitionBy(keys).orderBy(order). A
    stretch of rows gets a copy of the `reach` rows on either side, which are left out of the result."""
    i = numbered(rows, keys, order, chunks)
    block = lambda x: F.floor(x / stretch)
    near = F.sequence(block(F.greatest(F.col("_i") - reach, F.lit(0))), block(F.col("_i") + reach))
    both = i.withColumn("_block", F.explode(near))
    w = Window.partitionBy(*keys, "_block").orderBy("_i")
    out = both.select("*", *[c.alias(n) for n, c in columns(w).items()])
    return out.where(F.col("_block") == block(F.col("_i"))).drop("_block", "_i")


def carried_last(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, chunks: int | None = None) -> DataFrame:
    """rows with the last value that isn't null of the rows before, as last(ignorenulls) over all rows up to the one before. A chunk that
    has none before a row takes what the chunks before it ended with."""
    p = chunked(rows, keys, order, chunks)
    on = [*keys, "_chunk"]
    end = p.groupBy(*on).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    end = end.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return _joined(p.withColumn("_own", F.last(value, ignorenulls=True).over(w)), end, on, "_carry").withColumn(name, F.coalesce("_own", "_carry")).drop("_own", "_carry", "_chunk")
