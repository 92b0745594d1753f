"""Streams with state: histories with a time to live, settings that a control stream changes, windows in event time, a ring of the
latest records.

State lives in the state store under the query's checkpoint, so a query that is started again goes on where it stopped."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.shared import shared
from .telemetry import KEEP, drain, events_stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DELAY, RING, REPLAY = "1 hour", 500, 50


@contextmanager
def rocksdb(spark: SparkSession):
    """Processors with several state variables need the RocksDB store; the session's own setting comes back afterwards."""
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was)


# ---------------------------------------------------------------- histories


class History(StatefulProcessor):
    """An agent's number of events and its `keep` latest, as a list that is never longer; both are gone `ttl_ms` after its last batch."""

    def __init__(self, keep: int, ttl_ms: int | None):
        self.keep, self.ttl = keep, ttl_ms

    def init(self, handle) -> None:
        self.n = handle.getValueState("n", "n bigint", self.ttl)
        self.last = handle.getListState("last", "t bigint, id bigint", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.n.get()[0] if self.n.exists() else 0
        seen = [tuple(x) for x in self.last.get()] if self.last.exists() else []
        for b in rows:
            n += len(b)
            seen = sorted(seen + list(zip(b["t"].tolist(), b["event_id"].tolist(), strict=True)))[-self.keep :]
        self.n.update((n,))
        self.last.put(seen)
        yield pd.DataFrame({"agent": [key[0]], "n": [n], "last": [",".join(str(b) for _, b in seen)]})

    def close(self) -> None:
        pass


def histories(stream: DataFrame, keep: int = KEEP, ttl_ms: int | None = None) -> DataFrame:
    """stream(user_id, ts, event_id) -> agent, n, last, of the agents of each batch."""
    s = stream.select(F.col("user_id").alias("agent"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    return s.groupBy("agent").transformWithStateInPandas(History(keep, ttl_ms), "agent bigint, n bigint, last string", "Update", "ProcessingTime" if ttl_ms else "None")


def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    with rocksdb(spark):
        return drain(histories(events_stream(spark, sf_dir)), "update", "history", ["agent"])


# ---------------------------------------------------------------- control

SETTINGS = {"alpha": 0.5, "topology": 0, "n_agents": 10}
_MESSAGE = "t bigint, id bigint, tick boolean, alpha double, topology double, n_agents double"


class Controlled(StatefulProcessor):
    """Holds a session's messages and ticks until the watermark has passed them, then puts them in order: a tick is given the settings
    of all messages before it. A changed topology rebuilds the edges, a changed number of agents those and the agents."""

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "alpha double, topology double, n_agents double, topology_rebuilds bigint, agent_rebuilds bigint")
        self.held = handle.getListState("held", _MESSAGE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for b in rows:
            t, row, tick = (b[c].tolist() for c in ("t", "id", "tick"))
            settings = ([v if v == v else None for v in b[c].tolist()] for c in SETTINGS)  # NaN is none
            self.held.appendList(list(zip(t, row, tick, *settings, strict=True)))
            first = min(t) if first is None else min(first, min(t))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        ready = [x for x in held if x[0] // 1000 < passed]
        rest = [x for x in held if x[0] // 1000 >= passed]
        if rest:
            if ready:
                self.held.put(rest)
            self.handle.registerTimer(min(x[0] for x in rest) // 1000 + 1)
        else:
            self.held.clear()
        if not ready:
            return
        given = lambda v: v is not None and v == v
        alpha, topology, agents, edges_built, agents_built = self.now.get() if self.now.exists() else (*SETTINGS.values(), 0, 0)
        out = []
        for _, row, tick, a, k, n in sorted(ready, key=lambda x: x[:2]):
            new_agents = given(n) and n != agents
            edges_built += new_agents or (given(k) and k != topology)
            agents_built += new_agents
            alpha, topology, agents = a if given(a) else alpha, k if given(k) else topology, n if given(n) else agents
            if tick:
                out.append((key[0], row, float(alpha), int(topology), int(agents), edges_built, agents_built))
        self.now.update((float(alpha), float(topology), float(agents), int(edges_built), int(agents_built)))
        if out:
            yield pd.DataFrame(out, columns=["session", "event_id", *SETTINGS, "topology_rebuilds", "agent_rebuilds"])

    def close(self) -> None:
        pass


def controlled(ticks: DataFrame, control: DataFrame, delay: str = DELAY) -> DataFrame:
    """ticks(session, time, id), control(session, time, id, alpha, topology, n_agents), two streams -> session, event_id, settings and
    rebuilds of every tick that both streams have passed by `delay`. Either may lag: the slower one's watermark counts. Later rows are
    dropped."""
    none = [F.lit(None).cast("double").alias(c) for c in SETTINGS]
    both = ticks.withWatermark("time", delay).select("session", "time", "id", F.lit(True).alias("tick"), *none).unionAll(
        control.withWatermark("time", delay).select("session", "time", "id", F.lit(False).alias("tick"), *[F.col(c).cast("double").alias(c) for c in SETTINGS])
    )
    both = both.withColumn("t", F.unix_micros("time"))
    kind = "session bigint, event_id bigint, alpha double, topology bigint, n_agents bigint, topology_rebuilds bigint, agent_rebuilds bigint"
    return both.groupBy("session").transformWithStateInPandas(Controlled(), kind, "Append", "EventTime")


def messages(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events as ticks, and as control messages: clicks set alpha, views the topology, purchases the number of agents."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = events.select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("id"), "event_type", "value", k.alias("k"))
    control = e.where("event_type in ('click', 'view', 'purchase')")
    set_ = {"alpha": F.when(F.col("event_type") == "click", F.col("value")), "topology": F.when(F.col("event_type") == "view", F.col("k") % 4), "n_agents": F.when(F.col("event_type") == "purchase", F.col("k") % 50 + 2)}
    return e.where("event_type not in ('click', 'view', 'purchase')").select("session", "time", "id"), control.select("session", "time", "id", *[v.alias(c) for c, v in set_.items()])


def stream_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams over the events: the settings at each tick that both have passed by an hour."""
    ticks, _ = messages(events_stream(spark, sf_dir))
    _, control = messages(events_stream(spark, sf_dir))
    with rocksdb(spark):
        return drain(controlled(ticks, control), "append", "control")


# ---------------------------------------------------------------- windows in event time


def day_windows(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """stream(time, event_type, value): each type's count and sum by day, once the day is over by `delay`; later rows are dropped."""
    g = stream.withWatermark("time", delay).groupBy(F.window("time", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").alias("day"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "6 hours", delay: str = DELAY) -> DataFrame:
    """stream(user_id, time): each user's stretches of events no further than `gap` apart, once they are over."""
    g = stream.withWatermark("time", delay).groupBy(F.session_window("time", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drain(day_windows(events_stream(spark, sf_dir)), "append", "days")
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drain(sessions(events_stream(spark, sf_dir)), "append", "sessions")
    return d.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


# ---------------------------------------------------------------- a ring of the latest records


def ring_versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    of = jvm.org.apache.hadoop.fs.Path(path)
    fs = of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(of)] if fs.exists(of) else []
    whole = [n for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in whole)


def ring_sink(path: str, order: list[str], keep: int = RING):
    """For foreachBatch: the `keep` latest rows of all batches so far, a version a batch under `path`. A batch that comes again writes its
    version again from the one before, so nothing counts twice; versions before that are deleted."""

    def sink(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        old = [v for v in ring_versions(spark, path) if v < batch]
        both = df.unionByName(spark.read.schema(df.schema).parquet(f"{path}/batch={old[-1]}")) if old else df
        both.orderBy(*[F.desc(c) for c in order]).limit(keep).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        for v in old[:-1]:
            of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={v}")
            of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(of, True)

    return sink


def replayed(spark: SparkSession, path: str, order: list[str], schema, last: int = REPLAY) -> DataFrame:
    """What a new client is sent: the latest rows of the ring."""
    versions = ring_versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={versions[-1]}").orderBy(*[F.desc(c) for c in order]).limit(last)


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events_stream(spark, sf_dir).select("event_id", F.col("user_id").alias("agent"), "ts")
    path, order = shared(spark, "ring"), ["ts", "event_id"]
    q = s.writeStream.option("checkpointLocation", shared(spark, "ring-state")).trigger(availableNow=True).foreachBatch(ring_sink(path, order)).start()
    q.awaitTermination()
    return replayed(spark, path, order, s.schema).select("event_id", "agent", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


QUERIES = {f.__name__: f for f in (stream_history, stream_control, stream_day_windows, stream_sessions, stream_replay)}
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_MS = "(epoch_us(max(ts))//1000-3600000)"
_WAS = lambda c, d: f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {d})"
ORACLE = {
    "stream_history": "WITH k AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id AS agent, any_value(n) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS last FROM k WHERE k<=5 GROUP BY user_id",
    "stream_control": f"""WITH m AS (SELECT user_id, ts, event_id, event_type NOT IN ('click','view','purchase') AS tick, CASE WHEN event_type='click' THEN value END AS alpha, CASE WHEN event_type='view' THEN {_K}%4 END AS topology, CASE WHEN event_type='purchase' THEN {_K}%50+2 END AS n_agents FROM events),
 w AS (SELECT least((SELECT {_MS} FROM m WHERE tick), (SELECT {_MS} FROM m WHERE NOT tick)) AS w),
 c AS (SELECT *, {_WAS("alpha", "0.5::DOUBLE")} AS a, {_WAS("topology", 0)} AS t, {_WAS("n_agents", 10)} AS n FROM m), r AS (SELECT *, coalesce(n_agents<>n, false) AS ra, coalesce(n_agents<>n, false) OR coalesce(topology<>t, false) AS rt FROM c),
 s AS (SELECT *, sum(rt::INT) OVER o AS topology_rebuilds, sum(ra::INT) OVER o AS agent_rebuilds FROM r WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT user_id AS session, event_id, a AS alpha, t AS topology, n AS n_agents, CAST(topology_rebuilds AS BIGINT) AS topology_rebuilds, CAST(agent_rebuilds AS BIGINT) AS agent_rebuilds FROM s, w WHERE tick AND epoch_us(ts)//1000<w""",
    "stream_day_windows": f"WITH w AS (SELECT {_MS} AS w FROM events) SELECT strftime(ts,'%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value),2) AS total FROM events, w WHERE epoch_us(date_trunc('day',ts))//1000+86400000<=w GROUP BY 1, 2",
    "stream_sessions": f"""WITH w AS (SELECT {_MS} AS w FROM events), l AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events),
 i AS (SELECT user_id, t, sum(CASE WHEN was IS NULL OR t-was>21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM l)
 SELECT user_id, min(t) AS "start", max(t)+21600000000 AS "end", count(*) AS n FROM i, w GROUP BY user_id, s, w HAVING (max(t)+21600000000)//1000<=w""",
    "stream_replay": "SELECT event_id, user_id AS agent, epoch_us(ts) AS t FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
}
