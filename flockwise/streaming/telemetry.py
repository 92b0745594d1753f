"""Structured Streaming over agent telemetry: running counts by tick, and each agent's last outputs as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared

KEEP = 5


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; watermarks need a time with a zone."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream reads folders or patterns
    return spark.readStream.schema(schema).parquet(f"{path.rsplit('/', 1)[0]}/event[s].parquet").withColumn("time", F.col("ts").cast("timestamp"))


def counts_by_type(stream: DataFrame) -> DataFrame:
    return stream.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def last_outputs(stream: DataFrame, keep: int = KEEP) -> DataFrame:
    """Each agent's number of events so far and its `keep` latest, by (ts, event_id): bounded state a key."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, "")
        seen = [tuple(x.split(":")) for x in last.split(",") if x]
        seen = [(int(a), int(b)) for a, b in seen]
        for b in batches:
            n += len(b)
            seen += list(zip(b["ts"].astype("int64").tolist(), b["event_id"].tolist(), strict=True))
            seen = sorted(seen)[-keep:]
        state.update((n, ",".join(f"{a}:{b}" for a, b in seen)))
        yield pd.DataFrame({"agent": [key[0]], "n": [n], "last": [",".join(str(b) for _, b in seen)]})

    return stream.select(F.col("user_id").alias("agent"), "ts", "event_id").groupBy("agent").applyInPandasWithState(step, "agent bigint, n bigint, last string", "n bigint, last string", "update", GroupStateTimeout.NoTimeout)


def json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as they come in; malformed ones are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def drain(stream: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Runs over all that is there; each batch is written to a folder of its own. Of a complete result the last batch is read, of
    updates each key's row of the latest batch that has one, of an appended result all."""
    spark = stream.sparkSession
    out, done = shared(spark, name), []

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        done.append(batch)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", shared(spark, f"{name}-state")).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.parquet(f"{out}/batch={max(done)}")
    all_ = spark.read.option("basePath", out).parquet(out)
    if mode == "append":
        return all_.drop("batch")
    latest = all_.withColumn("_k", F.row_number().over(Window.partitionBy(*(keys or [])).orderBy(F.desc("batch"))))
    return latest.where("_k = 1").drop("_k", "batch")


def stream_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(counts_by_type(events_stream(spark, sf_dir)), "complete", "telemetry")


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(last_outputs(events_stream(spark, sf_dir)), "update", "state", ["agent"])


def stream_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as JSON lines in several files, a few lines malformed, read as a stream and counted."""
    path = shared(spark, "lines")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("user_id").alias("agent"), F.col("value").alias("latency_ms"))).alias("value"), "event_id")
    e.select(F.when(F.col("event_id") % 1000 == 999, F.lit('{"t": broken')).otherwise(F.col("value")).alias("value")).repartition(3).write.text(path)
    lines = json_stream(spark, path, "t BIGINT, agent BIGINT, latency_ms DOUBLE").where("t is not null")
    return drain(lines.groupBy("agent").agg(F.count("*").alias("n"), F.max("t").alias("last")), "complete", "json")


QUERIES = {"stream_telemetry": stream_telemetry, "stream_state": stream_state, "stream_json_lines": stream_json_lines}
ORACLE = {
    "stream_json_lines": "SELECT user_id AS agent, count(*) AS n, max(epoch_us(ts)//1000) AS last FROM events WHERE event_id%1000<>999 GROUP BY user_id",
    "stream_telemetry": "SELECT event_type, count(*) AS n, round(sum(value),2) AS total FROM events GROUP BY event_type",
    "stream_state": "WITH k AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id AS agent, any_value(n) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS last FROM k WHERE k<=5 GROUP BY user_id",
}
