"""Ranked lexical search: exact top documents by term weights, over clusters that recursive graph bisection makes.

Index. Each task takes its documents in groups of GROUP and reorders every group by recursive graph bisection: a run of documents is
halved, pairs are swapped between the halves while that brings the documents of a term closer together (by the logarithmic gap cost
of postings), and the halves are halved again down to LEAF documents. A leaf is a cluster, a row of the index: its documents with their
lengths, its terms with their postings, and of each term what bounds its score there: documents, most occurrences, shortest document.
Nothing is shuffled for that, and no group spans tasks; documents that lie near in the input are clustered with each other. The order
decides the work only, never the result.

Search. Items are the stated query set, taken in blocks of at most BLOCK terms. A pass over the index's terms sums the documents that
hold the block's terms; from these weights follow. For each item each cluster has a bound, the sum of its terms' greatest possible
scores. The FIRST clusters of greatest bound are visited; the top-th score found there is the item's threshold. A cluster whose bound
is below it cannot hold a better document, nor one that ties, so one more pass visits only the clusters that reach it, in order
of bound, and raises the threshold as it finds better. Positions go back to document ids before ranking, so ties fall to the least.

Terms are whole strings throughout. Weights and thresholds of a block pass through the driver: BLOCK terms and `top` scores an item.

Defined results: null texts have no terms; documents without terms and items without found terms have no rows; rows that share a
doc_id are documents each, items that share an item_id are items each; null doc_ids come last among ties; items with a null id are
answered under it; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, forget, map_texts, materialize, ragged, table, text_chunks, word_spans

TOP, LEAF, FIRST = 50, 64, 8
#: Documents and bytes of a group that is bisected; rounds of swaps at each level; terms of a block of items.
GROUP, GROUP_BYTES, ROUNDS, BLOCK = 4096, 1 << 22, 6, 20_000
#: Bytes of the index that a Python task gets at once.
BATCH_BYTES = 1 << 23
#: Row groups of the index: a task holds one while it writes and, decoded, while it reads, however much its file or split has.
SMALL_GROUPS = {"parquet.block.size": 1 << 23, "parquet.block.row.count.limit": 64, "parquet.page.size.row.check.min": 4}
GAP = np.ones(256, bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = GAP[128:] = False
SCALE = 1_000_000_000
INDEX = "cluster bigint, docs array<bigint>, lens array<bigint>, terms array<string>, df array<int>, most array<bigint>, least array<bigint>, at array<int>, tf array<bigint>"
_LOG = np.log2(np.arange(2 * GROUP + 2) + 1.0)


def postings(buf: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of documents, (document, term, occurrences) in order, and the documents' lengths."""
    a, b, places = word_spans(buf, offs, GAP)
    ends = np.r_[0, np.cumsum(b - a)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(LOWER[buf[~GAP[buf]]])]).dictionary_encode()
    n, t = np.diff(places), max(len(words.dictionary), 1)
    key, tf = np.unique(np.repeat(np.arange(len(n)), n) * t + words.indices.to_numpy(), return_counts=True)
    return words.dictionary.cast(pa.string()), key // t, key % t, tf.astype(np.int64), n.astype(np.int64)


def bisected(doc: np.ndarray, term: np.ndarray, n: int, leaf: int = LEAF) -> np.ndarray:
    """An order of n documents (term sets as pairs) in which those with terms in common are near: all runs of a level at once."""
    order, size = np.arange(n), 1
    while size * leaf < n:
        size *= 2
    uses = np.bincount(term, minlength=1) if len(term) else np.zeros(1, int)
    keep = (uses[term] > 1) & (uses[term] < n)  # others are no nearer anywhere
    doc, term = doc[keep], term[keep]
    if not len(doc):
        return order
    runs = 1
    while runs < size:
        # a run's documents are the places from edge to edge; the left half are those before the middle
        edge = np.linspace(0, n, runs + 1).astype(np.int64)
        middle = np.linspace(0, n, 2 * runs + 1).astype(np.int64)[1::2]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        run = np.searchsorted(edge, place, "right") - 1
        left = place < middle[run]
        cell, of = np.unique(run[doc] * (term.max() + 1) + term, return_inverse=True)
        for _ in range(ROUNDS):
            here = np.bincount(of, left[doc], len(cell)).astype(np.int64)
            there = np.bincount(of, minlength=len(cell)) - here
            # what a move of one document to the other half saves, by term: degrees d cost d * log(d + 1) less
            to_right = (here - 1) * _LOG[np.maximum(here - 1, 0)] + (there + 1) * _LOG[there + 1] - here * _LOG[here] - there * _LOG[there]
            to_left = (here + 1) * _LOG[here + 1] + (there - 1) * _LOG[np.maximum(there - 1, 0)] - here * _LOG[here] - there * _LOG[there]
            gain = np.bincount(doc, np.where(left[doc], to_right[of], to_left[of]), n)
            # the best of each half change places, while together they gain
            by = np.lexsort((-gain, ~left, run))
            side = 2 * run[by] + ~left[by]
            _, rank = ragged(np.bincount(side, minlength=2 * runs))
            l, r = np.full((2, runs, int(np.diff(edge).max()) + 1), -1)
            l[run[by][side % 2 == 0], rank[side % 2 == 0]] = by[side % 2 == 0]
            r[run[by][side % 2 == 1], rank[side % 2 == 1]] = by[side % 2 == 1]
            swap = (l >= 0) & (r >= 0) & (gain[l] + gain[r] > 1e-9)
            if not swap.any():
                break
            left[l[swap]], left[r[swap]] = False, True
        order = np.lexsort((place, ~left, run))
        runs *= 2
    return order


def clusters(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """The index: a row a cluster of documents with terms. Postings of a term are `df` pairs of a place in docs (at) and tf."""

    def rows(ids: np.ndarray, words: pa.Array, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray, first: int) -> pa.RecordBatch:
        order = bisected(doc, term, len(ids), leaf)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        at = place[doc]
        by = np.lexsort((at, term, at // leaf))
        at, term, tf = at[by], term[by], tf[by]
        count = -(-len(ids) // leaf)
        size = n[order]
        new = np.ones(len(at), bool)
        new[1:] = (term[1:] != term[:-1]) | (at[1:] // leaf != at[:-1] // leaf)
        head = np.flatnonzero(new)
        some = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
        docs_at = np.minimum(np.arange(count + 1) * leaf, len(ids))
        terms_at = np.searchsorted(at[head] // leaf, np.arange(count + 1))
        posts_at = np.searchsorted(at // leaf, np.arange(count + 1))
        df = np.diff(np.r_[head, len(at)])
        least = np.minimum.reduceat(size[at], head) if len(head) else head
        most = np.maximum.reduceat(tf, head) if len(head) else head
        cols = [pa.array(first + np.arange(count)), some(docs_at, ids.take(pa.array(order))), some(docs_at, pa.array(size)), some(terms_at, words.take(pa.array(term[head]))), some(terms_at, pa.array(df.astype(np.int32))), some(terms_at, pa.array(most)), some(terms_at, pa.array(least)), some(posts_at, pa.array((at % leaf).astype(np.int32))), some(posts_at, pa.array(tf))]
        return pa.record_batch(cols, names=["cluster", "docs", "lens", "terms", "df", "most", "least", "at", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        held, size = [], 0

        def group() -> pa.RecordBatch:
            nonlocal first
            t = pa.concat_tables(held).combine_chunks()
            # whole group at once: its limit is its bytes and documents
            (_, buf, offs), *rest = list(text_chunks(t["text"], 1 << 62))
            assert not rest
            words, doc, term, tf, n = postings(buf, offs)
            some = np.flatnonzero(n > 0)
            new = np.full(len(n), -1)
            new[some] = np.arange(len(some))
            ids = t["id"].combine_chunks() if isinstance(t["id"], pa.ChunkedArray) else t["id"]
            out = rows(ids.take(pa.array(some)), words, new[doc], term, tf, n[some], first)
            first += len(out)
            return out

        for batch in batches:
            for i in range(0, len(batch), 256):
                part = pa.Table.from_batches([batch.slice(i, 256)]).rename_columns(["id", "text"])
                held.append(part)
                size += part.nbytes
                if sum(map(len, held)) >= GROUP or size >= GROUP_BYTES:
                    yield group()
                    held, size = [], 0
        if held:
            yield group()

    return map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, INDEX)


class Block:
    """Items with their terms: the block's terms as strings, and (item, term) pairs."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        raw = [t.encode() for t in texts]
        offs = np.cumsum([0, *map(len, raw)]).astype(np.int64)
        words, self.item, self.term, _, _ = postings(np.frombuffer(b"".join(raw), np.uint8), offs)
        self.words, self.ids = words.to_pylist(), ids

    def found(self, terms: pa.Array) -> np.ndarray:
        """Of each of these strings its number in the block, -1 if it has none."""
        import pyarrow.compute as pc

        return pc.fill_null(pc.index_in(terms, pa.array(self.words, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def blocks_of(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[Block]:
    """Items in turn, so many that they have about `limit` words."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"]) // 4 + 1
        if size >= limit:
            yield Block(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Block(ids, texts)


def _impact(tf: np.ndarray, n: np.ndarray, total: int, words: int) -> np.ndarray:
    """A term's part of a document's score before its weight; it rises with tf and falls with n."""
    return (SCALE * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // words))


def restricted(index: DataFrame, block: Block) -> DataFrame:
    """The index with the block's terms only, as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = b.column(3)
            cluster, _ = ragged(np.asarray(terms.value_lengths()))
            df = np.asarray(b.column(4).flatten()).astype(np.int64)
            no = block.found(terms.flatten())
            on = np.flatnonzero(no >= 0)
            group, place = ragged(df[on])
            posts = (np.cumsum(df) - df)[on][group] + place
            ends = lambda of: pa.array(np.searchsorted(cluster[on][of], np.arange(len(b) + 1)).astype(np.int32))
            t, p = ends(np.arange(len(on))), ends(group)
            some = lambda e, k, at: pa.ListArray.from_arrays(e, b.column(k).flatten().take(pa.array(at)))
            out = [b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(t, pa.array(no[on])), *[some(t, k, on) for k in (4, 5, 6)], *[some(p, k, posts) for k in (7, 8)]]
            out = pa.record_batch(out, names=["cluster", "docs", "lens", "terms", "df", "most", "least", "at", "tf"])
            yield out.filter(pa.array(np.diff(np.asarray(t)) > 0))

    return map_texts(index, run, INDEX.replace("terms array<string>", "terms array<bigint>"))


class Scorer:
    """Bounds and scores of a block's items in clusters."""

    def __init__(self, block: Block, weight: np.ndarray, total: int, words: int):
        self.total, self.words, self.weight, self.items = total, words, weight, len(block.ids)
        order = np.argsort(block.term, kind="stable")
        self.item = block.item[order]
        self.first = np.searchsorted(block.term[order], np.arange(len(weight) + 1))

    def uses(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into term, item) of every item that has a term."""
        group, place = ragged(self.first[term + 1] - self.first[term])
        return group, self.item[self.first[term][group] + place]

    def bounds(self, terms: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
        g, item = self.uses(terms)
        out = np.zeros(self.items, np.int64)
        np.add.at(out, item, (self.weight[terms] * _impact(most, least, self.total, self.words))[g])
        return out

    def scores(self, items: np.ndarray, terms: np.ndarray, df: np.ndarray, at: np.ndarray, tf: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """(these items, documents of the cluster)"""
        row = np.full(self.items, -1)
        row[items] = np.arange(len(items))
        g, item = self.uses(terms)
        on = row[item] >= 0
        g, item = g[on], item[on]
        add = self.weight[np.repeat(terms, df)] * _impact(tf, lens[at], self.total, self.words)
        group, place = ragged(df[g])
        post = (np.cumsum(df) - df)[g][group] + place
        out = np.zeros((len(items), len(lens)), np.int64)
        np.add.at(out, (row[item][group], at[post]), add[post])
        return out


def _each(b: pa.RecordBatch):
    """Rows of the restricted index as numpy arrays."""
    for k in range(len(b)):
        yield [b.column(0)[k].as_py(), b.column(1)[k].values] + [np.asarray(b.column(c)[k].values) for c in range(2, 9)]


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, leaf: int = LEAF, first: int = FIRST, block: int = BLOCK) -> DataFrame:
    """-> item_id, rank, doc_id, score."""
    spark, key = docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)
    index = materialize(clusters(docs, id_col=id_col, text_col=text_col, leaf=leaf), **SMALL_GROUPS)
    sizes = index.select(F.size("docs").cast("long").alias("n"), F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    total, words = sizes["n"] or 0, sizes["l"] or 0
    kind = "item_id bigint, rank int, doc_id bigint, score bigint"
    out = None
    for b in blocks_of(items, item_col, item_text_col, block) if total else ():
        found = _block(index, b, total, words, top, first)
        out = found if out is None else out.unionAll(found)
    forget(index)
    return spark.createDataFrame([], kind) if out is None else out


def _block(index: DataFrame, block: Block, total: int, words: int, top: int, first: int) -> DataFrame:
    spark = index.sparkSession
    part = materialize(restricted(index, block), **SMALL_GROUPS)
    held = part.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).collect()  # a row a term of the block
    weight = np.zeros(len(block.words), np.int64)
    for r in held:
        weight[r["terms"]] = math.floor(1000 * math.log((2 * total + 2) / (2 * r["df"] + 1)))
    scorer = Scorer(block, weight, total, words)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each item the clusters of greatest bound among this task's."""
        best, where = np.zeros((scorer.items, 0), np.int64), np.zeros((scorer.items, 0), np.int64)
        for b in batches:
            ends = np.asarray(b.column(1).offsets)
            terms, most, least = (np.asarray(b.column(k).flatten()) for k in (1, 2, 3))
            new = np.array([scorer.bounds(terms[x:y], most[x:y], least[x:y]) for x, y in zip(ends - ends[0], ends[1:] - ends[0], strict=False)]).reshape(len(b), scorer.items).T
            best, where = np.hstack([best, new]), np.hstack([where, np.broadcast_to(np.asarray(b.column(0)), (scorer.items, len(b)))])
            keep = np.argsort(-best, axis=1, kind="stable")[:, :first]
            best, where = np.take_along_axis(best, keep, 1), np.take_along_axis(where, keep, 1)
        item, k = np.nonzero(best > 0)
        yield pa.record_batch([pa.array(item), pa.array(where[item, k]), pa.array(best[item, k])], names=["item", "cluster", "bound"])

    reach = map_texts(part.select("cluster", "terms", "most", "least"), bounds, "item bigint, cluster bigint, bound bigint")
    w = Window.partitionBy("item").orderBy(F.desc("bound"), "cluster")
    visits = reach.withColumn("k", F.row_number().over(w)).where(F.col("k") <= first).select("item", "cluster").collect()  # `first` an item
    start: dict[int, list[int]] = {}
    for r in visits:
        start.setdefault(r["cluster"], []).append(r["item"])

    def best_of(rows, floor: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """rows: the restricted index's; of each item the `top` documents of the clusters that it visits. floor: an item's threshold,
        which rises here with every batch; without it, the clusters to visit are given."""
        low = np.zeros(scorer.items, np.int64) if floor is None else floor.copy()
        held = [np.zeros(0, np.int64)] * 4  # item, score, no id, id
        for b in rows:
            seen = list(_each(b))
            bound = np.array([scorer.bounds(r[3], r[5], r[6]) for r in seen]).reshape(len(seen), scorer.items)
            found = [held]
            for k in np.argsort(-bound.max(axis=1, initial=0), kind="stable"):
                cluster, docs, lens, terms, df, _, _, at, tf = seen[k]
                who = np.array(start.get(cluster, []), np.int64) if floor is None else np.flatnonzero((bound[k] > 0) & (bound[k] >= low))
                if len(who):
                    s = scorer.scores(who, terms, df, at, tf, lens)
                    i, d = np.nonzero((s > 0) & (s >= low[who][:, None]))
                    found.append([who[i], s[i, d], np.asarray(docs.is_null())[d].astype(np.int64), docs.fill_null(0).to_numpy()[d]])
            item, score, none, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((doc, none, -score, item))
            _, rank = ragged(np.bincount(item, minlength=scorer.items))
            order = order[rank < top]
            held = [x[order] for x in (item, score, none, doc)]
            last = np.flatnonzero(rank[rank < top] == top - 1)
            low[held[0][last]] = np.maximum(low[held[0][last]], held[1][last])
        yield pa.record_batch([pa.array(held[0]), pa.array(held[3], mask=held[2] > 0), pa.array(held[1])], names=["item", "doc_id", "score"])

    shape = "item bigint, doc_id bigint, score bigint"
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top_of = lambda df: df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    near = part.where(F.col("cluster").isin(sorted(start))) if start else part.limit(0)
    reached = top_of(map_texts(near, lambda rows: best_of(rows, None), shape)).where(F.col("rank") == top).select("item", "score").collect()  # a row an item
    floor = np.zeros(scorer.items, np.int64)
    for r in reached:
        floor[r["item"]] = r["score"]
    best = materialize(top_of(map_texts(part, lambda rows: best_of(rows, floor), shape)))
    forget(part)
    ids = spark.createDataFrame([(k, i) for k, i in enumerate(block.ids)], "item bigint, item_id bigint")
    return best.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
n AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w)>0), a AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS words FROM n),
i AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS w FROM benchmark), q AS (SELECT i, item_id, unnest(w) AS term FROM i),
t AS (SELECT r, unnest(w) AS term FROM d), p AS (SELECT r, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000*ln((2*total+2)::DOUBLE/(2*count(*)+1))) AS BIGINT) AS w FROM p, a GROUP BY term, total),
s AS (SELECT i, any_value(item_id) AS item_id, r, sum(w*((1000000000*tf)//(1000*tf+20*(100-50+((50*n*total)//words))))) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN n USING (r), a GROUP BY i, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s JOIN n USING (r) WHERE score>0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank<=50
"""
