"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table has a number of projections on Gaussian vectors, floor((a.x + b) / width), which make a bucket. A query visits its own
bucket and perturbed ones in the order of their estimated success: the perturbation sets of least expected squared distance to the
bucket's borders, from a template over the ranks of those distances. The tables' candidates are compared exactly and merged.

The numbers of tables, projections and probes and the width are chosen by measurement: CALIBRATE queries (bounded) are searched in all
rows by brute force, and of the choices that find RECALL of their true neighbours the one of least cost is taken: the rows compared,
estimated from SAMPLE rows (bounded), and the buckets visited at VISIT rows each, as a visit ships a query and its K + 1 finds. True neighbours come nearer as rows become more, so that structured vectors are searched with finer hashes in larger
tables; vectors without structure have no near neighbours, and most rows must then be compared, whatever the hash: then a few large
buckets are visited, not hundreds of small ones.

Equal vectors are one class, of which a search needs the K + 1 smallest ids at most; they are pre-aggregated in salted windows, so
that a vector of a third of all rows costs no more than another. Buckets are dealt out in parts of PART_BYTES of vectors by QPART queries, so
no task holds a whole large bucket or all of its visitors. Every row is indexed. Queries with fewer than K candidates in their
buckets (few rows in all) are compared with every class, dealt out likewise.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; vectors are compared with those of
their own length; ids that repeat count as rows with one id; a null id takes no part; ties go to the smaller id; empty tables give no
rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, mix, table

PART_BYTES, QPART, QSLICE, SAMPLE, CALIBRATE, RECALL = 1 << 24, 512, 64, 2000, 60, 0.97
#: What is tried: tables, projections to a table, widths in spreads of the projections; most probes of a table. Compared rows that a
#: visited bucket costs as much as.
CHOICES = [(t, m, w) for t in (1, 2, 4) for m in (1, 2, 3, 4, 6, 8, 10, 12, 16) for w in (0.5, 1.0, 1.5)]
PROBES, VISIT = 500, 256


class Hashes:
    """The projections, and the order of perturbations."""

    def __init__(self, dim: int, spread: float, *, tables: int, hashes: int, width: float, probes: int = PROBES, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.tables, self.hashes, self.width = tables, hashes, width * spread
        self.a = rng.standard_normal((dim, tables * hashes))
        self.b = rng.uniform(0, self.width, tables * hashes)
        self.salt = rng.integers(1, 1 << 63, (tables, hashes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.template = self._template(hashes, probes)

    @staticmethod
    def _template(m: int, probes: int) -> list[tuple[int, ...]]:
        """Sets of ranks of border distances (0 to 2m - 1; ranks j and 2m - 1 - j are the two borders of one projection), by expected
        sum of squares: each set is followed by the one with its last rank raised, and the one with the next rank added."""
        j = np.arange(1, 2 * m + 1)
        z = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)))
        out, heap = [()], [(float(z[0]), (0,))]
        while heap and len(out) < probes:
            cost, s = heapq.heappop(heap)
            if len({min(r, 2 * m - 1 - r) for r in s}) == len(s):
                out.append(s)
            if s[-1] + 1 < 2 * m:
                up = s[-1] + 1
                heapq.heappush(heap, (cost - float(z[s[-1]]) + float(z[up]), (*s[:-1], up)))
                heapq.heappush(heap, (cost + float(z[up]), (*s, up)))
        return out

    def _cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.hashes)
        cell = np.floor(p)
        return cell.astype(np.int64), p - cell

    def _key(self, cell: np.ndarray) -> np.ndarray:
        salt = self.salt.reshape((1, self.tables) + (1,) * (cell.ndim - 3) + (self.hashes,))
        key = mix((cell.view(np.uint64) * salt).sum(axis=-1, dtype=np.uint64))
        return key.view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) of bucket keys."""
        return self._key(self._cells(x)[0])

    def probes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, probes) of bucket keys, likeliest first."""
        cell, part = self._cells(x)
        m = self.hashes
        away = np.concatenate([part, 1 - part], axis=-1) ** 2  # to the lower and the upper border
        order = np.argsort(away, axis=-1, kind="stable")
        step = np.zeros((*cell.shape[:2], len(self.template), m), np.int64)
        for t, ranks in enumerate(self.template):
            for r in ranks:
                which = order[:, :, r]
                np.put_along_axis(step[:, :, t], (which % m)[..., None], np.where(which < m, -1, 1)[..., None], -1)
        return self._key(cell[:, :, None, :] + step)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def best_of(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest rows and all that tie with the last. Products choose the few rows whose
    distances are then taken exactly, in double precision."""
    near = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * (q @ x.T)
    if len(x) > k:
        slack = 1e-9 * ((q * q).sum(axis=1) + (x * x).sum(axis=1).max())
        i, j = np.nonzero(near <= (np.partition(near, k - 1, axis=1)[:, k - 1] + slack)[:, None])
    else:
        i, j = (a.ravel() for a in np.indices(near.shape))
    d = np.empty(len(i))
    for a in range(0, len(i), 65536):
        diff = x[j[a : a + 65536]] - q[i[a : a + 65536]]
        d[a : a + 65536] = np.sqrt((diff * diff).sum(axis=1))
    order = np.lexsort((d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.searchsorted(i, np.arange(len(q)))
    last = np.minimum(first + k, np.searchsorted(i, np.arange(len(q)), "right")) - 1
    keep = d <= d[last][i]
    return i[keep], j[keep], d[keep]


def classes(vectors: DataFrame, *, id_col: str, vec_col: str, k: int) -> DataFrame:
    """-> h1, h2, ids: the k + 1 smallest, x: array<double>. Only rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    v = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    v = v.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("x", lambda e: e != 0))
    v = v.select("id", F.transform("x", lambda e: e + 0.0).alias("x"))  # -0.0 is 0.0
    v = v.select("id", "x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(9), "x").alias("h2"), F.pmod(F.spark_partition_id(), F.lit(16)).alias("salt"))
    few = v.withColumn("k", F.row_number().over(Window.partitionBy("h1", "h2", "salt").orderBy("id"))).where(F.col("k") <= k + 1)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("k") <= k + 1)
    return few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("x").alias("x"))


def chosen(sample: np.ndarray, asked: np.ndarray, true: np.ndarray, *, rows: int, recall: float = RECALL, choices=CHOICES) -> tuple[Hashes, float, float]:
    """sample: rows; asked: queries; true: (queries, k, dim) of their true neighbours (nan: fewer) -> the hashes, the share of true
    neighbours that they find, and of rows that they compare."""
    spread = max(float(np.sqrt(((sample - sample.mean(axis=0)) ** 2).mean(axis=0).sum())), 1e-9)
    known = np.isfinite(true).all(axis=2)
    best = None
    for tables, m, width in choices:
        h = Hashes(sample.shape[1], spread, tables=tables, hashes=m, width=width)
        probes = h.probes(asked)
        ours, theirs = h.buckets(sample), h.buckets(np.nan_to_num(true).reshape(-1, true.shape[2])).reshape(*true.shape[:2], tables)
        n = len(h.template)
        compared, rank = np.zeros(n), np.full(known.shape, n)
        for q in range(len(asked)):
            for t in range(tables):
                order = np.argsort(probes[q, t], kind="stable")
                keys = probes[q, t][order]

                def rank_of(b, keys=keys, order=order):
                    at = np.minimum(np.searchsorted(keys, b), n - 1)
                    return np.where(keys[at] == b, order[at], n)

                compared += np.bincount(rank_of(ours[:, t]), minlength=n + 1)[:n] / len(sample) / len(asked)
                rank[q] = np.minimum(rank[q], rank_of(theirs[q, :, t]))
        found = np.cumsum(np.bincount(rank[known], minlength=n + 1)[:n]) / max(int(known.sum()), 1)
        enough = np.flatnonzero(found >= recall)
        p = int(enough[0]) if len(enough) else n - 1
        share = float(compared[: p + 1].sum())
        cost = (len(enough) == 0, -found[p] if not len(enough) else 0.0, rows * share + VISIT * tables * (p + 1))
        if best is None or cost < best[0]:
            best = cost, Hashes(sample.shape[1], spread, tables=tables, hashes=m, width=width, probes=p + 1), float(found[p]), share
    return best[1:]


def exact(of: DataFrame, asked: list, k: int) -> dict:
    """The k nearest classes of a few asked ones (h1, h2, x), by brute force over all rows -> (h1, h2): vectors, themselves left out."""
    keys, q = [(r["h1"], r["h2"]) for r in asked], np.array([r["x"] for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(2))
                i, j, d = best_of(q, x, k + 1)
                yield pa.record_batch([pa.array(i), pa.array(d), batch.column(0).take(pa.array(j)), batch.column(1).take(pa.array(j)), batch.column(2).take(pa.array(j))], names=["q", "d", "h1", "h2", "x"])

    near = of.select("h1", "h2", "x").mapInArrow(run, "q bigint, d double, h1 bigint, h2 bigint, x array<double>")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "h1", "h2"))).where(F.col("n") <= k + 1)
    out = {key: [] for key in keys}
    for r in near.orderBy("q", "n").collect():  # k + 1 rows for each asked
        if (r["h1"], r["h2"]) != keys[r["q"]]:
            out[keys[r["q"]]].append(r["x"])
    return out


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, recall: float = RECALL) -> DataFrame:
    """queries: ids among the vectors' -> query_id, rank, vec_id, score."""
    vectors = vectors.select(id_col, vec_col)
    of = materialize(classes(vectors, id_col=id_col, vec_col=vec_col, k=k))
    # the queries: their own vectors, a class once
    q = vectors.join(queries.select(F.col(id_col).alias("_q")).distinct(), vectors[id_col] == F.col("_q"), "left_semi")
    q = q.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.transform(F.col(vec_col).cast("array<double>"), lambda e: e + 0.0).alias("x"))
    q = materialize(q.select("query_id", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(9), "x").alias("h2")))
    out = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for r in of.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():  # a row a length of vectors
        out = out.unionAll(_nearest(of.where(F.size("x") == r["dim"]), q, r["dim"], r["n"], k, recall))
    return out


def _nearest(of: DataFrame, q: DataFrame, dim: int, rows_: int, k: int, recall: float) -> DataFrame:
    asked = of.join(q.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("x").alias("q"))
    asked = materialize(asked)
    few = of.orderBy("h1", "h2").select("h1", "h2", "x").limit(SAMPLE).collect()  # SAMPLE rows at most
    tried = few[:CALIBRATE]
    near = exact(of, tried, k)
    true = np.full((len(tried), k, dim), np.nan)
    for i, r in enumerate(tried):
        for j, x in enumerate(near[r["h1"], r["h2"]][:k]):
            true[i, j] = x
    hashes, _, _ = chosen(np.array([r["x"] for r in few]), np.array([r["x"] for r in tried]), true, rows=rows_, recall=recall)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := len(batch):
                keys = hashes.buckets(_matrix(batch.column(2)))
                row = pa.array(np.repeat(np.arange(n), hashes.tables))
                yield pa.record_batch([pa.array(keys.ravel()), *(batch.column(c).take(row) for c in (0, 1, 2))], names=["bucket", "h1", "h2", "x"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                b = batch.slice(i, 256)
                keys = hashes.probes(_matrix(b.column(2))).reshape(len(b), -1)
                row = pa.array(np.repeat(np.arange(len(b)), keys.shape[1]))
                yield pa.record_batch([pa.array(keys.ravel()), *(b.column(c).take(row) for c in (0, 1, 2))], names=["bucket", "q1", "q2", "q"])

    rows = of.select("h1", "h2", "x").mapInArrow(index, "bucket bigint, h1 bigint, h2 bigint, x array<double>")
    probes = asked.mapInArrow(probe, "bucket bigint, q1 bigint, q2 bigint, q array<double>")
    ids = of.select("h1", "h2", "ids")

    def ranked(pairs: DataFrame) -> DataFrame:
        near = pairs.join(ids, ["h1", "h2"]).select("q1", "q2", "score", F.explode("ids").alias("vec_id"))
        near = near.withColumn("n", F.row_number().over(Window.partitionBy("q1", "q2").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
        lists = near.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
        return q.join(lists, (q.h1 == lists.q1) & (q.h2 == lists.q2)).select("query_id", F.slice(F.filter("near", lambda c: c.vec_id != F.col("query_id")), 1, k).alias("near"), "h1", "h2")

    lists = materialize(ranked(_met(rows, probes, dim, k)))
    done = lists.where(F.size("near") >= k)
    rest = materialize(asked.join(done.select(F.col("h1").alias("q1"), F.col("h2").alias("q2")), ["q1", "q2"], "left_anti"))
    if rest.limit(1).count():
        one = F.lit(0).cast("long").alias("bucket")
        done = done.unionAll(ranked(_met(of.select(one, "h1", "h2", "x"), rest.select(one, "q1", "q2", "q"), dim, k)))
    return done.select("query_id", F.posexplode("near").alias("at", "c")).select("query_id", (F.col("at") + 1).alias("rank"), "c.vec_id", "c.score")


def _met(rows: DataFrame, probes: DataFrame, dim: int, k: int) -> DataFrame:
    """rows(bucket, h1, h2, x), probes(bucket, q1, q2, q) -> q1, q2, h1, h2, score: the k + 1 nearest classes of each query in its
    buckets and all that tie with the last. Parts of buckets meet parts of their visitors."""
    part = max(256, PART_BYTES // (8 * dim))
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    visits = probes.groupBy("bucket").agg(F.ceil(F.count("*") / QPART).cast("int").alias("qparts"))
    sizes = materialize(sizes.join(visits, "bucket"))
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    r = rows.join(sizes, "bucket").select("bucket", F.pmod("h1", F.col("parts")).cast("int").alias("part"), all_("qparts").alias("qpart"), "h1", "h2", "x")
    v = probes.join(sizes, "bucket").select("bucket", all_("parts").alias("part"), F.pmod("q1", F.col("qparts")).cast("int").alias("qpart"), "q1", "q2", "q")
    kind = "q1 bigint, q2 bigint, h1 bigint, h2 bigint, score double"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.combine_chunks(), right.combine_chunks()
        if not len(a) or not len(b):
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in ("q1", "q2", "h1", "h2", "score")})
        q, x = _matrix(a["q"].combine_chunks()), _matrix(b["x"].combine_chunks())
        found = [best_of(q[o : o + QSLICE], x, k + 1) for o in range(0, len(q), QSLICE)]
        i, j, d = (np.concatenate(c) for c in zip(*[(r + o * QSLICE, c, s) for o, (r, c, s) in enumerate(found)], strict=True))
        return pa.table({**{c: a[c].take(pa.array(i)) for c in ("q1", "q2")}, **{c: b[c].take(pa.array(j)) for c in ("h1", "h2")}, "score": pa.array(d)})

    by = ["bucket", "part", "qpart"]
    found = v.groupBy(by).cogroup(r.groupBy(by)).applyInArrow(meet, kind).distinct()
    near = found.withColumn("n", F.rank().over(Window.partitionBy("q1", "q2").orderBy("score")))
    return materialize(near.where(F.col("n") <= k + 1).drop("n"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
