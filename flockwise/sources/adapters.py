"""Readers and writers, and the views of the driver's tables that stand in for frames, sweeps, states, ticks, logs and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Steps that one 64-number vector holds: x, y, vx, vy each.
STEPS = 16
TELEMETRY = "t BIGINT, tick BIGINT, agent BIGINT, partner BIGINT, latency_ms DOUBLE, tokens BIGINT, output_len INT, cpu DOUBLE, mem_mb DOUBLE"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a schema the files are read once only."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_json_lines(spark: SparkSession, path: str, schema: str = TELEMETRY) -> DataFrame:
    """Malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header and quotes; without a schema types are inferred, by one more reading."""
    return spark.read.csv(path, schema=schema, header=True, inferSchema=schema is None, escape='"', multiLine=True)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """A version of the output; `latest_run` finds the last one."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    runs = spark.read.parquet(path)
    last = runs.agg(F.max("run_id").alias("last"))  # one row
    return runs.join(F.broadcast(last), F.col("run_id") == F.col("last")).drop("last")


def alpha_grid(rows: DataFrame, sweep: DataFrame, n: int) -> DataFrame:
    """Each row with n evenly spaced values from the sweep's least alpha to its greatest; alpha_idx is the key, as floats are poor ones."""
    ends = sweep.agg(F.min("alpha").alias("low"), F.max("alpha").alias("high")).where("low is not null")  # one row
    of = rows.crossJoin(F.broadcast(ends)).withColumn("alpha_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return of.withColumn("alpha", F.col("low") + F.col("alpha_idx") * (F.col("high") - F.col("low")) / (n - 1)).drop("low", "high")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, step, boid_id, x, y, vx, vy."""
    e = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull())
    steps = F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda t: F.struct(t.alias("step"), *[F.get("embedding", 4 * t + k).cast("double").alias(c) for k, c in enumerate("abcd")]))
    e = e.select(F.col("label").alias("run"), F.col("vec_id").alias("boid_id"), F.explode(steps).alias("f"))
    return e.select("run", F.col("f.step").alias("step"), "boid_id", (50 + 50 * F.col("f.a")).alias("x"), (50 + 50 * F.col("f.b")).alias("y"), F.col("f.c").alias("vx"), F.col("f.d").alias("vy"))


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alpha, run, metric."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("alpha"), F.col("l_linenumber").alias("run"), F.col("l_extendedprice").alias("metric"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, seq, state."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.row_number().over(order).cast("bigint").alias("seq"), F.col("event_type").alias("state"), "value")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, tick, agent, latency_ms, tokens."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "ts", F.row_number().over(order).cast("bigint").alias("tick"), F.col("user_id").alias("agent"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"))


def discussion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv, round, agent, content."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").alias("round"), F.coalesce("role", F.lit("")).alias("agent"), F.coalesce("text", F.lit("")).alias("content"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, provider, name, cost."""
    return table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("provider"), F.col("p_name").alias("name"), (F.col("p_retailprice") / 100000).alias("cost"))


#: The same views for the SQL of the catalogue.
SQL = {
    "frames": """frames AS (SELECT label AS run, CAST(t AS INTEGER) AS step, vec_id AS boid_id, 50+50*CAST(embedding[4*t+1] AS DOUBLE) AS x,
      50+50*CAST(embedding[4*t+2] AS DOUBLE) AS y, CAST(embedding[4*t+3] AS DOUBLE) AS vx, CAST(embedding[4*t+4] AS DOUBLE) AS vy
      FROM embeddings, range(16) r(t) WHERE embedding IS NOT NULL)""",
    "sweep": "sweep AS (SELECT l_discount AS alpha, l_linenumber AS run, l_extendedprice AS metric FROM lineitem)",
    "states": "states AS (SELECT user_id AS entity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS state, value FROM events)",
    "ticks": """ticks AS (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tick, user_id AS agent, value AS latency_ms,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events)""",
    "discussion": "discussion AS (SELECT conv_id AS conv, turn AS round, coalesce(role,'') AS agent, coalesce(text,'') AS content FROM conversations)",
    "models": "models AS (SELECT p_brand||'/'||CAST(p_partkey AS VARCHAR) AS id, p_brand AS provider, p_name AS name, p_retailprice/100000 AS cost FROM part)",
}
