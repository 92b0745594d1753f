"""Each query of the catalogue against its SQL, and planted cases."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions

from flockwise.operators import breaks, density, info, local, series, space
from flockwise.plans import catalog
from flockwise.functions import topology
from flockwise.sources import adapters, settings
from flockwise.streaming import telemetry

TABLES = "region nation customer supplier part orders lineitem events embeddings conversations".split()


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, small, duck, name):
    got, want = rows(catalog.queries()[name](spark, small).toPandas()), rows(duck.execute(catalog.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) and len(got) > 0
    for c in got.columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and catalog.FLAGSHIP in catalog.queries()


def test_seam_pair_are_neighbours(spark):
    p = spark.createDataFrame([(0, 9.0, 1.0), (1, 194.5, 1.0)], "id bigint, x double, y double")
    got = space.neighbours(p, 15.0, [], world=200.0).collect()
    assert {(r.i, r.j) for r in got} == {(0, 1), (1, 0)} and got[0].dist == pytest.approx(14.5)


def test_neighbours_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    xy = rng.uniform(0, 50, (150, 2))
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(xy)], "id bigint, x double, y double")
    for world, radius in ((50.0, 7.0), (50.0, 20.0), (None, 7.0)):
        d = np.abs(xy[:, None] - xy[None])
        d = np.minimum(d, 50 - d) if world else d
        near = {(i, j) for i, j in zip(*np.nonzero(np.sqrt((d**2).sum(-1)) < radius)) if i != j}
        assert {(r.i, r.j) for r in space.neighbours(p, radius, [], world=world).collect()} == near


def test_crowded_cells_are_dealt_out(spark, monkeypatch):
    """Four fifths of the points in one cell: pairs as by all pairs, and no key with more than a few blocks' rows."""
    monkeypatch.setattr(space, "CROWD", 16)
    rng = np.random.default_rng(5)
    xy = np.vstack([rng.uniform(10, 14, (160, 2)), rng.uniform(0, 50, (40, 2))])
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(xy)], "id bigint, x double, y double")
    seen, dealt = [], space.dealt
    monkeypatch.setattr(space, "dealt", lambda *a: seen.append(dealt(*a)) or seen[-1])
    for world in (50.0, None):
        d = np.abs(xy[:, None] - xy[None])
        d = np.minimum(d, 50 - d) if world else d
        near = {(i, j) for i, j in zip(*np.nonzero(np.sqrt((d**2).sum(-1)) < 7)) if i != j}
        got = space.neighbours(p, 7.0, [], world=world).collect()
        assert {(r.i, r.j) for r in got} == near and len(got) == len(near)
    for side in seen[-1]:
        assert side.groupBy("cx", "cy", "_l", "_r").count().agg(functions.max("count")).first()[0] <= 40


def test_alternating_states_tell_one_bit(spark):
    s = spark.createDataFrame([(1, k, "ab"[k % 2]) for k in range(2001)], "e int, seq int, state string")
    assert info.mutual_information(info.pairs(s, ["e"], "seq", "state"), ["e"]).first().mi == pytest.approx(1, abs=1e-3)


def test_step_is_found_and_line_is_not(spark):
    step = [(0, k / 10, 0.1 + 0.2 * (k >= 15) + 0.001 * (k % 3)) for k in range(31)]
    got = series.discontinuity(spark.createDataFrame(step, "run int, alpha double, y double"), ["run"], "alpha", "y").first()
    assert abs(got.critical_alpha - 1.5) <= 0.2 + 1e-9 and got.magnitude > 0.05  # the second derivative turns where the smoothing starts to see the step
    assert breaks.change_points(np.array([r[2] for r in step]) * 10) == [15]
    assert breaks.change_points(np.zeros(10)) == []


def test_hopping_windows_drop_the_tail(spark):
    f = spark.range(1500).selectExpr("1 as run", "cast(id as int) as step")
    assert info.hopping_windows(f, ["run"], "step", 50, 25).select("w").distinct().count() == 58


def test_state_keeps_keys_of_all_batches(spark, tmp_path):
    """Two files in two batches: every agent is there, with its latest events."""
    for k in range(2):
        rows_ = spark.range(100).selectExpr(f"cast(id % 75 + {75 * k} as bigint) as user_id", f"timestamp_seconds(id + 1000 * {k}) as ts", f"id + 100 * {k} as event_id")
        rows_.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows_.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = {r.agent: (r.n, r.last) for r in telemetry.drain(telemetry.last_outputs(stream), "update", "test", ["agent"]).collect()}
    assert len(got) == 150 and got[0] == (2, "0,75") and got[149] == (1, "174")


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    xy = rng.uniform(0, 20, (2, 60, 2))
    p = spark.createDataFrame([(g, i, *map(float, xy[g, i])) for g in range(2) for i in range(60)], "g int, id bigint, x double, y double")
    for r in density.dbscan_grid(p, [(2.0, 4), (1.5, 3)], keys=("g",)).groupBy("g", "eps", "min_samples").agg(functions.sort_array(functions.collect_list(functions.struct("id", "label"))).alias("l")).collect():
        near = np.sqrt(((xy[r.g][:, None] - xy[r.g][None]) ** 2).sum(-1)) <= r.eps
        core = near.sum(axis=1) >= r.min_samples
        label = np.where(core, np.arange(60), -1)
        while True:
            new = np.array([min(label[j] for j in range(60) if near[i, j] and core[j]) if core[i] else -1 for i in range(60)])
            if (new == label).all():
                break
            label = new
        for i in np.flatnonzero(~core):
            around = [label[j] for j in range(60) if near[i, j] and core[j]]
            label[i] = min(around) if around else -1
        assert [x.label for x in r.l] == label.tolist()


def test_csv_and_text(spark, tmp_path):
    adapters.write_csv(spark.createDataFrame([(1, 'a, "b"\nc'), (0, "")], "n int, s string"), f"file://{tmp_path}/c")
    assert {(r.n, r.s) for r in adapters.read_csv(spark, f"file://{tmp_path}/c").collect()} == {(1, 'a, "b"\nc'), (0, None)}
    (tmp_path / "t.md").write_text("# State\nx")
    assert adapters.read_text(spark, f"file://{tmp_path}/t.md").first().value == "# State\nx"


def test_json_lines_drop_malformed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"t": 1, "agent": 2}\n{bad\n{"t": 3, "agent": 4}\n')
    assert {r.t for r in adapters.read_json_lines(spark, f"file://{tmp_path}/a.json").collect()} == {1, 3}


def test_latest_run(spark, tmp_path):
    for k in ("a", "b"):
        adapters.write_run(spark.range(2 if k == "a" else 3), f"file://{tmp_path}/runs", k)
    assert adapters.latest_run(spark, f"file://{tmp_path}/runs").count() == 3


def test_settings_have_defaults_and_no_unknown_keys(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("boids:\n  n_boids: 7   # few\n  boundary: \"reflective\"\n\nsweep:\n  n_boids: 9\n  other: 1\n")
    (tmp_path / "b.yaml").write_text("# nothing\n")
    rows_ = settings.read_settings(spark, f"file://{tmp_path}/a.yaml")
    assert {(r.section, r.key, r.value) for r in rows_.collect()} == {("boids", "n_boids", "7"), ("boids", "boundary", "reflective"), ("sweep", "n_boids", "9"), ("sweep", "other", "1")}
    r = settings.resolved(rows_, "boids").first()
    assert (r.n_boids, r.boundary, r.noise_std, r.world_size) == (7, "reflective", 0.1, 100.0)
    with pytest.raises(TypeError, match="other"):
        settings.resolved(rows_, "sweep")


def test_models_are_in_the_order_of_people(spark):
    names = ["Zeta", "\u00e4pfel", "apple", "\u00c4rger", "zebra", "Apple", "b"]
    d = spark.createDataFrame([(n,) for n in names], "id string").orderBy(functions.collate("id", "UNICODE"), "id")
    assert [r.id for r in d.collect()] == ["\u00e4pfel", "apple", "Apple", "\u00c4rger", "b", "zebra", "Zeta"]


def test_neighbors_of_small_networks():
    eval_ = lambda *a: [x[0] for x in topology.Neighbors().eval(*a)]
    assert eval_("ring", 0, 0, 2) == [1, 1] and eval_("star", 0, 0, 1) == [] and eval_("mesh", 0, 1, 3) == [0, 2] and eval_("ring", 0, None, 3) == [] and eval_("tree", 0, 0, 3) == []
    for net in range(40):
        of = [set(eval_("random", net, i, 3)) for i in range(3)]
        assert all(of) and all(i in of[j] for i in range(3) for j in of[i])


@pytest.mark.parametrize("whole", [1 << 17, 50])
def test_counted_neighbours_equal_pairs(spark, monkeypatch, whole):
    """Numbers of neighbours and the nearest, whole and by pairs: crowds, edges of the world, points in one place and without one."""
    monkeypatch.setattr(space, "WHOLE", whole)
    monkeypatch.setattr(local, "RING", 500)
    rng = np.random.default_rng(11)
    xy = np.vstack([rng.uniform(40, 52, (150, 2)), rng.uniform(0, 100, (80, 2)), rng.normal((99.5, 0.5), 3, (40, 2)) % 100, [[100.0, 3.0], [0.0, 3.0], [0.0, 3.0], [20.0, 20.0], [27.0, 20.0]]])
    rows = [(i % 2, i, *map(float, v)) for i, v in enumerate(xy)] + [(0, 900, None, 1.0)]
    p = spark.createDataFrame(rows, "g int, id bigint, x double, y double")
    for how in ({"inclusive": True}, {"world": 100.0, "coincident": False}, {"world": 100.0, "seam": True}, {"world": 100.0}):
        want = {}
        for r in space.neighbours(p, 7.0, ["g"], **how).collect():
            n, d = want.get((r.g, r.i), (0, 9.0))
            want[r.g, r.i] = (n + 1, min(d, r.dist))
        got = space.counted(p, 7.0, ["g"], **how).collect()
        assert len(got) == len(rows) and {(r.g, r.id): (r.n, r.nearest) for r in got if r.n} == want
        assert all(r.nearest is None for r in got if not r.n)


def test_counts_of_a_crowd_list_no_pairs(monkeypatch):
    """16,000 points within a few radii have 68 million pairs within it: a cell looks at a part of the points, and none of all."""
    looked = []
    runs = local.runs
    monkeypatch.setattr(local, "runs", lambda s, c: looked.append(int(np.sum(c))) or runs(s, c))
    x, y = 50 + 6.25 * np.random.default_rng(12).normal(size=(2, 16000))
    n, nearest = local.around(x, y, 7.0, None, True, True, False)
    assert n.sum() > 60e6 and max(looked) < 8000 and not np.isnan(nearest[n > 0]).any()


@pytest.mark.parametrize("name", ["largest_flock", "mode_class"])
def test_points_of_clusters_are_never_broadcast(spark, sf_dir, name):
    """F8 to F11: their compressed files look small, so the driver would build the table for a broadcast."""
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("whole", [1 << 17, 4])
@pytest.mark.parametrize("name", ["step_forces", "step_forces_raw", "step_update", "step_update_uniform"])
def test_steps_of_odd_points(spark, tmp_path, monkeypatch, name, whole):
    """Points beyond the world and on its edges, in one place, under one id, without id, run, place or velocity, and not finite."""
    monkeypatch.setattr(space, "WHOLE", whole)
    monkeypatch.setattr(local, "RING", 500)
    rng = np.random.default_rng(21)
    e = [[float(np.float32(v)) for v in row] for row in np.vstack([rng.normal(0, 0.1, (60, 64)), rng.uniform(-1, 1, (40, 64)), rng.normal(0.98, 0.05, (20, 64))])]
    e += [[1.0, 0.0] * 32, [-1.0, 0.0] * 32, [1.0, -1.0] * 32, [0.99, 0.01] * 32, e[0], e[0], e[1][:10], [], None, [None] * 64, [0.0, 0.0, float("nan"), None] * 16]
    e += [[0.01, 0.0, None, 5.0] * 16, [0.0, 0.02, float("inf"), -3e5] * 16, [float("nan"), 0.0, 0.1, 0.1] * 16, [0.0, float("inf"), 0.1, 0.1] * 16, [2.5, -3.0, 0.1, 0.1] * 16]
    rows = [(i, v, i % 2) for i, v in enumerate(e)] + [(5, e[6], 1), (5, e[7], 1), (None, e[8], 0), (900, e[9], None), (901, e[9], None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as from '{tmp_path}/embeddings.parquet/*.parquet'")
    key = lambda r: [(v is None, v or 0) for v in r[:3]] + [[(v is None, v or 0) for v in r[3:]]]
    got = sorted((tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()), key=key)
    want = sorted(duck.execute(catalog.oracle_sql()[name]).fetchall(), key=key)
    assert len(got) == len(want) == 16 * (len(rows) - 1)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and all(p == q or (p is not None and q is not None and (abs(p - q) < 2e-6 * max(1, abs(q)) or (p != p and q != q))) for p, q in zip(a[3:], b[3:])), (a, b)


def test_steps_list_no_pairs(spark, sf_dir, monkeypatch):
    """A crowd's sums come from its cells: no join of points by cells, and no cell looks at all points."""
    for name in ("step_forces", "step_forces_raw", "step_update", "step_update_uniform"):
        assert "Join" not in catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    looked = []
    runs = local.runs
    monkeypatch.setattr(local, "runs", lambda s, c: looked.append(int(np.sum(c))) or runs(s, c))
    x, y, v = 50 + 6.25 * np.random.default_rng(12).normal(size=(3, 8000))
    n, dx, *_, sums = local.pulled(*map(np.ma.array, (np.arange(8000), x, y)), [np.ma.array(v)], 7.0, 3.0, 0.01, 100.0)
    assert n.sum() > 15e6 and max(looked) < 5000 and (sums[0][1] == n).all() and abs(dx.sum()) < 1e-6  # what one is moved, the other is back
