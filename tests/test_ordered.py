"""Windows by stretches against windows by key, with one key of nine tenths of the rows."""

import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flockwise.functions import scalars as S
from flockwise.operators import ordered, series
from flockwise.plans import events


@pytest.fixture(scope="module")
def skewed(spark):
    r = random.Random(8)
    rows = [("hot" if r.random() < 0.9 else r.choice(["a", "b", None]), k // 3, k, float(r.randrange(100)) if r.random() < 0.3 else None, k * 0.5 + r.random()) for k in range(900)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t bigint, id bigint, v double, x double").selectExpr("*", "coalesce(v, 1.0) as y")


def both(got, want):
    cols = sorted(want.columns)
    a, b = ([tuple(r[c] for c in cols) for r in d.collect()] for d in (got, want))
    assert sorted(got.columns) == cols and sorted(map(repr, a)) == sorted(map(repr, b)) and len(a) > 0


@pytest.mark.parametrize("stretch,chunks", [(1 << 16, 8), (7, 5), (1, 3)])
def test_windowed(skewed, stretch, chunks):
    def columns(w):
        return {"next": F.lead("v").over(w), "was": F.lag("v").over(w), "mean": F.round(series.rolling_mean("y", w), 9), "grad": F.round(series.gradient("y", "x", w), 9), "trail": F.sum("y").over(w.rowsBetween(-3, -1))}

    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.select("*", *[c.alias(n) for n, c in columns(w).items()])
    both(ordered.windowed(skewed, ["k"], ["t", "id"], 3, columns, stretch=stretch, chunks=chunks), want)
    assert ordered.windowed(skewed.limit(0), ["k"], ["t", "id"], 3, columns).count() == 0


@pytest.mark.parametrize("chunks", [1, 4, 40])
def test_numbers_and_carried(skewed, chunks):
    w = Window.partitionBy("k").orderBy("t", "id")
    both(ordered.numbered(skewed, ["k"], ["t", "id"], chunks), skewed.withColumn("_i", F.row_number().over(w) - 1))
    both(ordered.carried_last(skewed, ["k"], ["t", "id"], "v", "last", chunks), skewed.withColumn("last", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))


def test_no_task_holds_the_hot_key(skewed):
    n = ordered.chunked(skewed, ["k"], ["t", "id"], 8).groupBy("_chunk").count().agg(F.max("count")).first()[0]
    assert n < 300  # of 900, 810 of them of one key


def test_events_at_one_time(spark, tmp_path):
    """Copies of events under shifted keys share their times: slopes are as in SQL, infinite or NaN, and stop no job."""
    duck = duckdb.connect()
    source = "/root/testdata/sf0.001/events.parquet"
    duck.execute(f"copy (select * replace (event_id + k * 100000 as event_id, value + (k + event_id) % 2 as value) from '{source}', range(3) r(k) where k = 0 or event_id % 3 > 0) to '{tmp_path}/events.parquet' (format parquet)")
    duck.execute(f"create view events as from '{tmp_path}/events.parquet'")
    want = duck.execute(f"select event_id, next_type, rolling, slope::varchar as slope from ({events.ORACLE['event_series']})").fetchall()
    got = events.event_series(spark, str(tmp_path)).collect()
    text = {float("inf"): "inf", float("-inf"): "-inf"}
    said = lambda v: None if v is None else "nan" if v != v else text.get(v, str(v))
    have = {r.event_id: (r.next_type, r.rolling, said(r.slope)) for r in got}
    assert len(got) == len(have) and have == {e: (t, r, said(None if s is None else float(s))) for e, t, r, s in want}
    assert {"inf", "-inf", "nan"} < {s for _, _, s in have.values()}


def test_steep_slopes_are_rounded_as_in_sql(spark, tmp_path):
    """Events a few microseconds apart, whose slopes times 10^4 end in a half as doubles but not as decimals."""
    duck = duckdb.connect()
    rows = [(1704643411082106, 372.76), (1704643411082114, 296.21), (1704643411082115, 32.54), (1705469238566061, 45.27), (1705469238566068, 547.5)]
    rows += [(1705469238566071, 188.02), (1705501340803341, 437.35), (1705501341928201, 148.08), (1705501341928204, 312.19)]
    duck.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double)")
    duck.executemany("insert into events select ?, make_timestamp(?::bigint), 1, 'view', ?", [(k, t, y) for k, (t, y) in enumerate(rows)])
    duck.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    want = duck.execute(f"select event_id, rolling, slope from ({events.ORACLE['event_series']}) order by 1").fetchall()
    got = events.event_series(spark, str(tmp_path)).orderBy("event_id").collect()
    assert [(r.event_id, r.rolling, r.slope) for r in got] == want and len(want) == len(rows)


def test_rounded(spark):
    values = [2.5, 3.5, -2.5, -0.5, 0.49999999999999994, 1e300, -0.00004, 26485508.39635, -247640356.12094998, float("inf"), float("-inf"), float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(S.rounded(F.col("v"), 0)).collect()]
    assert list(map(repr, got)) == ["3.0", "4.0", "-3.0", "-1.0", "0.0", "1e+300", "-0.0", "26485508.0", "-247640356.0", "inf", "-inf", "nan", "None"]
    duck = duckdb.connect()
    for v in values[:9]:
        assert spark.range(1).select(S.rounded(F.lit(v), 4)).first()[0] == duck.execute("select round(?::double, 4)", [v]).fetchone()[0]
