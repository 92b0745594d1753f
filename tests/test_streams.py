"""Stateful streams over several batches and after a restart, late rows, state that expires, the ring of latest records."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from flockwise.streaming import stateful

T0 = datetime.datetime(2026, 1, 1)
KIND = "event_id bigint, user_id bigint, ts timestamp, event_type string, value double, props string"


def events(n, seed, users=4, first=0):
    r = random.Random(seed)
    out = []
    for k in range(first, first + n):
        kind = r.choice(["click", "view", "purchase", "search", "search"])
        out.append((k, r.randrange(users), T0 + datetime.timedelta(minutes=k, seconds=r.randrange(50)), kind, float(r.randrange(9)), '{"k": %d}' % r.randrange(40)))
    return out


def files(spark, path, parts):
    """One file after the other, so that each is a batch."""
    for p in parts:
        spark.createDataFrame(p, KIND).coalesce(1).write.mode("append").parquet(f"file://{path}")


def opened(spark, path):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"file://{path}").withColumn("time", F.col("ts"))


def run(stream, mode, checkpoint, out):
    """-> the query's progress; results are appended to out."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"file://{checkpoint}").trigger(availableNow=True).foreachBatch(lambda df, b: out.extend((b, *r) for r in df.collect())).start()
    q.awaitTermination()
    return q.recentProgress


def settings(rows, passed):
    """The settings at each tick before `passed`, message by message."""
    out, state = set(), {}
    for k, user, ts, kind, value, props in sorted(rows, key=lambda r: (r[2], r[0])):
        s = state.setdefault(user, {"alpha": 0.5, "topology": 0, "n_agents": 10, "t": 0, "a": 0})
        n = int(props[6:-1])
        if kind == "click":
            s["alpha"] = value
        elif kind == "view":
            s["t"] += s["topology"] != n % 4
            s["topology"] = n % 4
        elif kind == "purchase":
            s["t"] += s["n_agents"] != n % 50 + 2
            s["a"] += s["n_agents"] != n % 50 + 2
            s["n_agents"] = n % 50 + 2
        elif ts < passed:
            out.add((user, k, s["alpha"], s["topology"], s["n_agents"], s["t"], s["a"]))
    return out


def test_control_applies_to_later_ticks_over_batches_and_a_restart(spark, tmp_path):
    rows = events(400, 1)
    parts = [rows[i : i + 100] for i in range(0, 400, 100)]
    got, seen = [], []
    control = ("click", "view", "purchase")
    with stateful.rocksdb(spark):
        for k in (0, 2):
            for name, of in (("ticks", lambda e: e[3] not in control), ("control", lambda e: e[3] in control)):
                files(spark, tmp_path / name, [[e for e in p if of(e)] for p in parts[k : k + 2]])
            seen += parts[k] + parts[k + 1]
            ticks, _ = stateful.messages(opened(spark, tmp_path / "ticks"))
            _, messages = stateful.messages(opened(spark, tmp_path / "control"))
            run(stateful.controlled(ticks, messages, "30 minutes"), "append", tmp_path / "state", got)
            last = min(max(e[2] for e in seen if (e[3] in control) == c) for c in (True, False)) - datetime.timedelta(minutes=30)
            assert {g[1:] for g in got} == settings(seen, last) and len(got) == len({g[1:] for g in got})
    assert len({g[0] for g in got}) > 2


def test_history_is_bounded_and_expires(spark, tmp_path):
    rows = events(120, 2)
    # a time to live in processing time would ask for batches without data for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    with stateful.rocksdb(spark):
        for ttl, name in ((None, "kept"), (1, "gone")):
            got = []
            for half in (rows[:60], rows[60:]):
                files(spark, tmp_path / name, [half])
                run(stateful.histories(opened(spark, tmp_path / name), 3, ttl), "update", tmp_path / f"{name}-state", got)
            last = {g[1]: g for g in got}
            for user, (_, _, n, ids) in last.items():
                mine = sorted((r for r in (rows if ttl is None else rows[60:]) if r[1] == user), key=lambda r: (r[2], r[0]))
                assert n == len(mine) and ids == ",".join(str(r[0]) for r in mine[-3:])
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    day = lambda d, k: (k, 1, T0 + datetime.timedelta(days=d), "view", 1.0, "{}")
    files(spark, tmp_path / "in", [[day(0, 1), day(0.5, 2), day(3, 3)], [day(6, 7)], [day(0.2, 4), day(0.3, 5), day(2.99, 6)], [day(9, 8)]])
    got = []
    progress = run(stateful.day_windows(opened(spark, tmp_path / "in")), "append", tmp_path / "state", got)
    late = sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
    assert late == 1  # both late rows are of one window, which the batch adds up before it meets the state; a batch's rows are late by the watermark of the batch before: the third one's day isn't over there
    assert sorted((str(r[1])[:10], r[3]) for r in got) == [("2026-01-01", 2), ("2026-01-03", 1), ("2026-01-04", 1), ("2026-01-07", 1)]


def test_sessions_close_after_the_gap(spark, tmp_path):
    at = lambda h, u, k: (k, u, T0 + datetime.timedelta(hours=h), "view", 1.0, "{}")
    files(spark, tmp_path / "in", [[at(0, 1, 1), at(5, 1, 2), at(1, 2, 3)], [at(10, 1, 4), at(20, 1, 5), at(60, 3, 6)]])
    got = []
    run(stateful.sessions(opened(spark, tmp_path / "in")), "append", tmp_path / "state", got)
    assert sorted((r[1], (r[3] - r[2]).total_seconds() / 3600, r[4]) for r in got) == [(1, 6.0, 1), (1, 16.0, 3), (2, 6.0, 1)]


@pytest.mark.parametrize("keep", [50, 7])
def test_ring_after_every_batch(spark, tmp_path, keep):
    rows = events(90, 3)
    random.Random(4).shuffle(rows)
    order, path = ["ts", "event_id"], f"file://{tmp_path}/ring"
    sink = stateful.ring_sink(path, order, keep)
    for k in range(3):
        part = spark.createDataFrame(rows[30 * k : 30 * k + 30], KIND)
        sink(part, k)
        sink(part, k)  # a batch that comes again counts once
        want = sorted(((r[2], r[0]) for r in rows[: 30 * k + 30]), reverse=True)[: min(keep, 20)]
        assert [(r.ts, r.event_id) for r in stateful.replayed(spark, path, order, part.schema, 20).collect()] == want
    assert len(stateful.ring_versions(spark, path)) <= 2
    assert stateful.replayed(spark, f"file://{tmp_path}/none", order, part.schema).count() == 0
