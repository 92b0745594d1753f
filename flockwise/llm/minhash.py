"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set are its distinct shingles of five words (A-Z lower-cased); a shorter one is a single shingle, one without words is
empty and linked with nothing. A sketch has BINS coordinates. In round i < BINS each shingle is hashed to a bin and a value, in round
BINS + b every shingle goes to bin b, and a bin keeps the least value of the first round that reached it: every coordinate fills, and
the share of equal coordinates estimates the Jaccard similarity with concentration like that of independent draws. ROWS coordinates
are a band; documents that agree in a band are in a bucket. A pair of similarity 0.85 has a bucket in common but for one case in two
million, one of 0.8 but for one in thirty thousand.

Equal sets are one class, a node with a key of its own; only classes go on, so repeated ids keep their texts apart. Comparisons are
all on full sets:

1. Stars. A bucket's members are dealt out to SALTS parts by key, each part's least member is its pivot, and the bucket's pivots have
   one again. Each class is compared with the pivot of most of its buckets: linear work, and no bucket meets in one task.
2. Within buckets that then still hold several components, classes of different components are compared if the sizes of their sets
   allow the similarity: buckets are cut by size class, and those parts into blocks of bounded bytes. A pair that shares several
   buckets is compared in the first, and a block passes on only links that join two of its components.

Defined results: a null text is empty; a null doc_id is linked with nothing, kept, and has a null component; rows that share a
doc_id are each judged by their own set, under that id; repeated rows are rows each; empty tables give no rows. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, bucketed, forget, fresh, map_texts, materialize, mix, span_hash, table, text_chunks, word_spans

BINS, ROWS, SALTS = 80, 4, 1024
#: Members and bytes of a block that is compared with another.
BLOCK, BLOCK_BYTES = 512, 1 << 23
_R = np.random.default_rng(85)
PLACE = _R.integers(1, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROUND = _R.integers(1, 1 << 63, 2 * BINS, dtype=np.uint64)


def shingles(buf: np.ndarray, offs: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of documents: hashes, sorted within a document, and n+1 places of the documents in them."""
    n = len(offs) - 1
    a, b, first = word_spans(buf, offs)
    w = span_hash(LOWER[buf], a, b)
    count = np.diff(first)
    s = np.zeros(len(w), np.uint64)
    for k in range(words):
        s[: len(w) - k] += w[k:] * PLACE[k]
    doc = np.repeat(np.arange(n), count)
    left = first[1:][doc] - np.arange(len(w))  # words from here to the end
    whole = left >= words
    # fewer words than a shingle: one hash of all of them
    few = (count[doc] < words) & (left == count[doc])
    at = np.flatnonzero(few)
    if len(at):
        short = np.zeros(len(at), np.uint64)
        for k in range(words - 1):
            on = left[at] > k
            short[on] += w[at[on] + k] * PLACE[k]
        s[at] = short + left[at].astype(np.uint64)
    keep = whole | few
    h, doc = mix(s[keep]), doc[keep]
    order = np.argsort(h)
    if n < 1 << 16:
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n + 1))


def sketches(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(documents, BINS) of uint64; rows of empty sets are the largest number throughout."""
    n = len(places) - 1
    size = np.diff(places)
    out = np.full(n * BINS, np.iinfo(np.uint64).max)
    doc = np.repeat(np.arange(n), size)
    for i in range(2 * BINS):
        if not len(h):
            break
        x = mix(h ^ ROUND[i])
        bin_ = (((x & np.uint64(0xFFFFFF)) * np.uint64(BINS)) >> np.uint64(24)).astype(np.int64) if i < BINS else i - BINS
        np.minimum.at(out, doc * BINS + bin_, (x >> np.uint64(8)) | np.uint64(i << 56))
        open_ = (out.reshape(n, BINS) == np.iinfo(np.uint64).max).any(axis=1)
        if not open_[doc].all():
            h, doc = h[open_[doc]], doc[open_[doc]]
    return out.reshape(n, BINS)


def _identity(h: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set."""
    sums = []
    for salt in (1, 2):
        c = np.r_[np.uint64(0), np.cumsum(mix(h ^ np.uint64(salt)))]
        sums.append((c[places[1:]] - c[places[:-1]]).view(np.int64))
    return sums


def signatures(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """-> doc_id, n_shingles, h1, h2 (of the set), bands: array<bigint>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, buf, offs in text_chunks(batch.column(1)):
                h, places = shingles(buf, offs)
                n, size = len(offs) - 1, np.diff(places)
                sk = sketches(h, places)
                bands = np.zeros((n, BINS // ROWS), np.uint64)
                for k in range(ROWS):
                    bands += sk[:, k::ROWS] * PLACE[k]
                bands = mix(bands + np.arange(BINS // ROWS, dtype=np.uint64))
                at = np.r_[0, np.cumsum(np.where(size > 0, bands.shape[1], 0))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(bands[size > 0].ravel().view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(i, n), pa.array(size.astype(np.int64)), *map(pa.array, _identity(h, places)), lists], names=["doc_id", "n_shingles", "h1", "h2", "bands"])

    return map_texts(docs.select(F.col(id_col).cast("long"), text_col), run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>")


def full_sets(texts: DataFrame) -> DataFrame:
    """texts(text) -> h1, h2, set: eight bytes a shingle, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, offs in text_chunks(batch.column(0)):
                h, places = shingles(buf, offs)
                yield pa.record_batch([*map(pa.array, _identity(h, places)), pa.array([h[x:y].tobytes() for x, y in zip(places, places[1:], strict=False)], pa.binary())], names=["h1", "h2", "set"])

    return map_texts(texts, run, "h1 bigint, h2 bigint, set binary")


def _shared(mine: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others."""
    size = np.array([len(x) for x in others])
    other, row = np.concatenate(others), np.repeat(np.arange(len(others)), size)
    j = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
    return np.bincount(row, mine[j] == other, minlength=len(others)).astype(np.int64)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) of nodes whose sets have 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                inter = int(_shared(x, [y])[0])
                ok[i] = 100 * inter >= percent * (len(x) + len(y) - inter)
            yield batch.select([0, 1]).filter(pa.array(ok))

    return map_texts(both, run, "a bigint, b bigint")


def members_of(rows: DataFrame) -> DataFrame:
    """rows(band, node) -> band, node, pivot of buckets with several members: each part's least node is its members' pivot, the
    bucket's least is the parts' pivots'. No task has more of a bucket than a part of it, or SALTS pivots."""
    part = Window.partitionBy("band", "salt")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).withColumn("pivot", F.min("node").over(part)).withColumn("n", F.count("*").over(part))
    whole = Window.partitionBy("band")
    pivots = rows.where("node = pivot").select("band", "node", F.min("node").over(whole).alias("pivot"), F.sum("n").over(whole).alias("n"))
    return rows.where("node != pivot").select("band", "node", "pivot").unionAll(pivots.where("n > 1").select("band", "node", "pivot"))


def within(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members(band, node, label, size, bands) -> a, b: labels of nodes in one bucket that are alike, where the labels differ."""
    step = math.log(100 / percent) * (1 + 1e-9)
    of = members.withColumn("c", F.floor(F.log("size") / step).cast("int"))
    # a member meets those of its own size class (role 1: as the one compared), and those of the class below
    both = of.withColumn("upper", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("c", F.col("c") - F.col("upper"))
    groups = both.groupBy("band", "c").agg(F.sum(1 - F.col("upper")).alias("n"), F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    most = F.greatest(F.lit(8.0), F.least(F.lit(float(BLOCK)), BLOCK_BYTES / 8 / F.exp((F.col("c") + 2) * step)))
    parts = lambda n: F.ceil(F.col(n) / most).cast("int")
    groups = materialize(groups.where("n > 0 and m > 1 and lo != hi").select("band", "c", parts("n").alias("lefts"), parts("m").alias("rights")))
    dealt = both.join(groups, ["band", "c"]).withColumn("h", F.xxhash64("node"))
    l, r = F.pmod("h", F.col("lefts")), F.pmod("h", F.col("rights"))
    all_ = lambda n: F.sequence(F.lit(0).cast("bigint"), (F.col(n) - 1).cast("bigint"))
    one = F.array(F.struct(l.alias("l"), r.alias("r"), F.when(F.col("upper") == 0, 3).otherwise(2).alias("role")))
    many = F.concat(
        F.when(F.col("upper") == 0, F.transform(all_("rights"), lambda k: F.struct(l.alias("l"), k.alias("r"), F.lit(1).alias("role")))).otherwise(F.array().cast("array<struct<l:bigint,r:bigint,role:int>>")),
        F.transform(all_("lefts"), lambda k: F.struct(k.alias("l"), r.alias("r"), F.lit(2).alias("role"))),
    )
    dealt = dealt.select("band", "c", "upper", "node", "label", "bands", F.explode(F.when((F.col("lefts") == 1) & (F.col("rights") == 1), one).otherwise(many)).alias("x"))
    dealt = dealt.select("band", "c", "x.l", "x.r", "x.role", "upper", "node", "label", "bands").join(sets, "node")

    def pairs(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        band, node, label, upper, role = (t[c].to_numpy() for c in ("band", "node", "label", "upper", "role"))
        sets_ = [np.frombuffer(v.as_py(), np.uint64) for v in t["set"]]
        bands = np.asarray(t["bands"].combine_chunks().flatten()).reshape(len(t), -1)
        size, right = np.array([len(x) for x in sets_]), (role & 2) > 0
        of = label.copy()  # components as far as the block has found them; only what joins two of them goes out
        out = []
        for i in np.flatnonzero((role & 1) > 0).tolist():
            ok = right & (of != of[i]) & ((upper == 1) | (node < node[i])) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            at = np.flatnonzero(ok)
            same = bands[at] == bands[i]  # the first bucket that both are in
            at = at[bands[at, same.argmax(axis=1)] == band[0]]
            if len(at):
                inter = _shared(sets_[i], [sets_[k] for k in at])
                hit = at[100 * inter >= percent * (size[i] + size[at] - inter)]
                if len(hit):
                    met, first = np.unique(of[hit], return_index=True)
                    out += [(int(label[i]), x) for x in label[hit[first]].tolist()]
                    of[np.isin(of, met)] = of[i]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return dealt.groupBy("band", "c", "l", "r").applyInArrow(pairs, "a bigint, b bigint")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(a, b), nodes(id) -> id, label: the smallest id reachable. Least labels spread and jump until none changes."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(nodes.select("id", F.col("id").alias("label")).join(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")), "id", "left").select("id", F.least("label", F.coalesce("m", "label")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        spread = labels.join(near, "id", "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = spread.join(labels.select(F.col("id").alias("label"), F.col("label").alias("further")), "label", "left")
        new = materialize(jump.select("id", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = new.where(F.col("was") != F.col("label")).limit(1).count()
        forget(labels)
        if not changed:
            forget(both)
            return new.select("id", "label")
        labels = new


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """-> doc_id, n_shingles, component_id, kept."""
    sig = materialize(signatures(docs, id_col=id_col, text_col=text_col))
    full = sig.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "rep", "size", "bands"))
    members = materialize(members_of(classes.select("node", F.explode("bands").alias("band")).distinct()))
    nodes = materialize(members.select("node").distinct())
    of = classes.join(nodes, "node", "left_semi")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = full_sets(texts.join(of.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").select("text"))
    sets = materialize(found.join(of.select("node", "h1", "h2"), ["h1", "h2"]).select("node", "set").dropDuplicates(["node"]))
    star = members.where("node != pivot").groupBy("node", "pivot").agg(F.count("*").alias("n"))
    star = star.groupBy("node").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("b")).select(F.col("node").alias("a"), "b")
    edges = materialize(verified(materialize(star), sets, percent))
    labels = components(edges, nodes.select(F.col("node").alias("id"))).withColumnRenamed("id", "node")
    known = materialize(members.select("band", "node").join(labels, "node"))
    mixed = materialize(known.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("band"))
    rest = materialize(known.join(mixed, "band").join(of.select("node", "size", "bands"), "node"))
    links = materialize(within(rest, sets, percent))
    for used in (sets, members, known, edges):
        forget(used)
    joined = components(links, labels.select(F.col("label").alias("id")).distinct()).select(F.col("id").alias("label"), F.col("label").alias("top"))
    top = labels.join(joined, "label").select("node", "top")
    classes = classes.join(top, "node", "left").select("h1", "h2", "rep", F.coalesce("top", "node").alias("top"))
    least = classes.groupBy("top").agg(F.min("rep").alias("c"))  # the smallest doc_id of a component
    of_class = materialize(classes.join(least, "top").select("h1", "h2", "c"))
    out = sig.join(of_class, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("c")).alias("c"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of smallest id (null last), and all rows without words. Each row is
    judged by itself, under a key of its own: repeats of a row are near-duplicates, and null ids are rows like others."""
    row, n = fresh(docs, "_row"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # texts move once, here: both joins by the key below read them where they then lie
    docs = bucketed(docs.withColumn(row, F.monotonically_increasing_id()).repartition(n, row), row, n)
    found = near_duplicates(docs.select(row, text_col), id_col=row, text_col=text_col, percent=percent).select(F.col("doc_id").alias(row), "component_id")
    ids = docs.select(row, F.col(id_col).alias("id")).join(found, row)
    best = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", row)).alias("best"))
    return docs.join(materialize(best.select(F.col("best")[row].alias(row))).hint("merge"), row, "left_semi").drop(row)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
