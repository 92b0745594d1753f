"""Distributed selection against `percentile`, bit for bit."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from flockwise.operators import select

AT = [0.0, 0.025, 0.125, 0.5, 0.875, 0.975, 1.0]


def bits(x):
    return None if x is None else [struct.pack("<d", v) for v in x]


@pytest.mark.parametrize("bars,few", [(256, 2048), (16, 3)])
def test_quantiles_equal_percentile(spark, bars, few):
    r = random.Random(6)
    rows = [("a", r.gauss(0, 1)) for _ in range(400)] + [("b", float(r.randint(0, 3))) for _ in range(300)] + [("c", 10 ** r.uniform(-8, 8) * r.choice([-1, 1])) for _ in range(60)]
    rows += [("d", 5.0)] * 50 + [("e", None)] * 3 + [("f", 1.5), ("f", None), (None, 2.0), (None, 4.0), (None, 9.0), ("g", 1e308), ("g", -1e308), ("g", 0.0), ("h", 0.1 + 0.2), ("h", 0.3)]
    d = spark.createDataFrame(rows, "s string, v double").selectExpr("s", "v", "'x' as _n", "1 as _k0")
    got = {x.s: bits(x.quantiles) for x in select.quantiles(d, ["s"], "v", AT, bars=bars, few=few).collect()}
    want = {x.s: bits(x.q) for x in d.groupBy("s").agg(F.percentile("v", F.array(*map(F.lit, AT))).alias("q")).collect()}
    assert got == want
    assert select.quantiles(d.limit(0), ["s"], "v", AT).count() == 0


def test_nan_is_greatest(spark):
    d = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 2.0), ("a", 7.0), ("b", float("nan"))], "s string, v double")
    got = {x.s: x.q for x in select.quantiles(d, ["s"], "v", [0.0, 0.5, 1.0], "q", few=0).collect()}
    assert got["a"][0] == 1.0 and got["a"][1] == 4.5 and math.isnan(got["a"][2]) and all(map(math.isnan, got["b"]))


def test_a_million_different_values(spark):
    d = spark.range(1_000_000).select(F.lit("x").alias("s"), (F.col("id") * F.lit(7919) % F.lit(1_000_003) / 7).alias("v"))
    at = [0.1, 0.5, 0.9]
    assert bits(select.quantiles(d, ["s"], "v", at).first().quantiles) == bits(d.agg(F.percentile("v", F.array(*map(F.lit, at))).alias("q")).first().q)
