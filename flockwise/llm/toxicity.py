"""Toxicity by nearest labelled examples: exact cosine of weighted TF-IDF over a block-max inverted index, and distance-weighted votes.

Fit: at most EXAMPLES labelled documents (those of the least hash of doc_id) are the examples, and every word of theirs is a term; a
word that no example holds weighs nothing. Document frequencies of the terms count every document. A term weighs idf * (1 + z * z), z
being how many standard errors its share of toxic examples is off the share of all: no term is left out, and those that tell labels
apart decide which examples are near. A text's vector has (1 + ln tf) times these weights, at length 1; examples of one direction are
kept once, with their numbers of toxic and clean labels. The index's bytes travel with the tasks.

Search: the COMMON terms of most examples are a matrix, the others have posting lists, which are summed for all examples. Examples lie
in blocks of BLOCK, with the largest weight of each common term in each block. A text's bound on a block is the best of these sums
there and its common weights times the block's largest; blocks that can't reach the K-th best are left out, common terms are added in
the others, and those examples that are near enough to the K-th are summed again in double precision, so that the K nearest are
exact. Each votes with the labels it stands for, weighted by 1 / (0.05 + 1 - cosine); votes are shrunk to the share of toxic labels
among all examples. A text that shares no term with any example has no neighbour at a distance; it is scored by the examples without
words.

Defined results: a null text is empty and scored like any text without terms; rows that share a doc_id are each scored, and the least
of their texts is the example; a null doc_id is scored and never an example; without labels every score is the prior, 0.5 of no
examples; very long texts are scored whole; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, map_texts, materialize, ragged, span_hash, table, text_chunks, word_spans

EXAMPLES, K, BLOCK = 20_000, 15, 64
#: Terms that are kept as a matrix; blocks that are multiplied at once; what sums of single precision may be off by.
COMMON, SPAN, ROUND = 512, 16, 1e-4
#: Terms of examples that are summed again at once.
TERMS = 1 << 19
#: Words are cut at ASCII characters that are neither letters nor digits.
BREAK = np.zeros(256, bool)
BREAK[[c for c in range(128) if not chr(c).isalnum()]] = True


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased), and n+1 places of the documents in them."""
    a, b, places = word_spans(buf, offs, BREAK)
    return span_hash(LOWER[buf], a, b), places


def term_counts(buf: np.ndarray, offs: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, tf) of the terms (sorted hashes) that documents hold, sorted."""
    h, places = word_hashes(buf, offs)
    if not len(terms) or not len(h):
        none = np.zeros(0, np.int64)
        return none, none, none
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    hit = terms[at] == h
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(places))[hit]
    key, tf = np.unique(doc * len(terms) + at[hit], return_counts=True)
    return key // len(terms), key % len(terms), tf


def vectors(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights, of length 1 in each document."""
    w = (1 + np.log(tf)) * idf[term]
    norm = np.sqrt(np.bincount(doc, w * w, minlength=int(doc[-1]) + 1 if len(doc) else 0))
    return w / norm[doc] if len(w) else w


def stretches(start: np.ndarray, end: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    """Of each array the places from each start to its end, one stretch after the other."""
    cuts = [slice(a, b) for a, b in zip(start.tolist(), end.tolist())]
    return [np.concatenate([x[:0], *[x[c] for c in cuts]]) for x in arrays]


class Index:
    """Examples in blocks, with postings by term. labels: (examples, 2) numbers of clean and toxic labels."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, labels: np.ndarray):
        self.n, self.n_terms, self.labels = len(labels), n_terms, labels
        self.blocks = -(-self.n // BLOCK)
        if not ((step := np.diff(example)) >= 0).all() or (np.diff(term)[step == 0] <= 0).any():  # a model's examples are in order
            order = np.lexsort((term, example))
            example, term, weight = example[order], term[order], weight[order]
        self.example, self.term, self.weight = example.astype(np.int32), term.astype(np.int32), weight
        self.start = np.searchsorted(self.example, np.arange(self.n + 1))
        # the terms of most examples are columns of a matrix, all others have posting lists
        common = np.sort(np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:COMMON])
        self.column = np.full(n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        at = self.column[self.term]
        dense = at >= 0
        self.dense = np.zeros((self.blocks * BLOCK, len(common)), np.float32)
        self.dense[self.example[dense], at[dense]] = self.weight[dense]
        self.most = self.dense.reshape(self.blocks, BLOCK, -1).max(axis=1) if self.n else np.zeros((0, len(common)), np.float32)
        t, post, weight = (x[~dense] for x in (self.term, self.example, self.weight))
        order = np.argsort((t & 0xFFFF).astype(np.uint16), kind="stable")  # by halves, as only short numbers are sorted by their digits
        order = order[np.argsort((t >> 16).astype(np.uint16)[order], kind="stable")]
        self.post = np.empty((len(t), 2), np.int32)  # examples, and the weights' bits: a list is read in one stretch
        self.post[:, 0], self.post[:, 1] = post[order], weight.astype(np.float32)[order].view(np.int32)
        self.post_start = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=n_terms))])

    def nearest(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(n, k) examples and cosines, best first, ties to the smaller example; -1 and 0 where there are no more with a term shared."""
        best, cos = np.full((n, k), -1), np.zeros((n, k))
        if not self.n or not len(doc):
            return best, cos
        start, lookup = np.searchsorted(doc, np.arange(n + 1)), np.full(self.n_terms, -1, np.int32)
        for i in range(0, n, BLOCK):
            j = min(i + BLOCK, n)
            a, b = start[i], start[j]
            self._nearest(doc[a:b] - i, term[a:b], weight[a:b], best[i:j], cos[i:j], k, lookup)
        return best, cos

    def _kth(self, top: np.ndarray, k: int) -> np.ndarray:
        """A bound from below on the k-th best score, as the best examples of k blocks reach it."""
        return np.partition(top, self.blocks - k, axis=1)[:, self.blocks - k] if self.blocks >= k else np.zeros(len(top), np.float32)

    def _nearest(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, best: np.ndarray, cos: np.ndarray, k: int, lookup: np.ndarray) -> None:
        n, width = len(best), self.blocks * BLOCK
        at = self.column[term]
        of = at >= 0
        query = np.zeros((n, self.dense.shape[1]), np.float32)
        query[doc[of], at[of]] = weight[of]
        d, t, w = doc[~of], term[~of], weight[~of].astype(np.float32)
        a, b, start = self.post_start[t], self.post_start[t + 1], np.searchsorted(d, np.arange(n + 1))
        size = b - a
        score = np.empty((n, width), np.float32)
        for r in range(n):  # a text at a time, whose sums stay in the processor's cache
            mine = slice(start[r], start[r + 1])
            (post,) = stretches(a[mine], b[mine], self.post)
            sums = np.repeat(w[mine], size[mine])
            sums *= post[:, 1].view(np.float32)
            score[r] = np.bincount(post[:, 0], sums, minlength=width)
        top = score.reshape(n, self.blocks, BLOCK).max(axis=2)
        live = top + query @ self.most.T >= self._kth(top, k)[:, None] - ROUND
        for b in range(0, self.blocks, SPAN):  # several blocks at once, if any is live for any text
            if live[:, b : b + SPAN].any():
                span = slice(b * BLOCK, (b + SPAN) * BLOCK)
                score[:, span] += query @ self.dense[span].T
        top = score.reshape(n, self.blocks, BLOCK).max(axis=2)
        low = np.maximum(self._kth(top, k), 0)
        near = (top >= low[:, None] - ROUND) & (top > 0)
        row, block = np.nonzero(near)
        i, place = np.nonzero((part := score.reshape(n, self.blocks, BLOCK)[row, block]) >= (low - ROUND)[row][:, None])
        row, example, sums = row[i], block[i] * BLOCK + place, part[i, place]
        keep = sums > 0
        row, example, sums = row[keep], example[keep], sums[keep]
        order = np.lexsort((-sums, row))
        row, example, sums = row[order], example[order], sums[order]
        first = np.searchsorted(row, np.arange(n + 1))
        if not len(row):
            return
        kth = np.where(np.diff(first) > k, sums[np.minimum(first[:-1] + k - 1, len(row) - 1)] - ROUND, 0)
        keep = sums >= kth[row]
        row, example = row[keep], example[keep]
        # these are summed again: the texts' terms are columns of a small matrix
        own, column = np.unique(term, return_inverse=True)
        lookup[own] = np.arange(len(own))
        exact = np.zeros((n, len(own) + 1))  # the last column stays 0, for other terms
        exact[doc, column] = weight
        size, c = self.start[example + 1] - self.start[example], np.zeros(len(row))
        cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // TERMS, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            of, of_weight = stretches(self.start[example[a:b]], self.start[example[a:b] + 1], self.term, self.weight)
            group = np.repeat(np.arange(b - a), size[a:b])
            c[a:b] = np.bincount(group, exact.ravel()[(row[a:b] * exact.shape[1])[group] + lookup[of]] * of_weight, minlength=b - a)
        c = np.round(c, 12)
        lookup[own] = -1
        order = np.lexsort((example, -c, row))
        row, example, c = row[order], example[order], c[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        pick = (place < k) & (c > 0)
        best[row[pick], place[pick]], cos[row[pick], place[pick]] = example[pick], c[pick]


class Model:
    """terms: hashes of words, sorted; examples: where each one's terms begin (n+1 places), their terms and tf; labels as in Index."""

    def __init__(self, terms: np.ndarray, words: pa.Array, idf: np.ndarray, examples: tuple[np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray, bare: tuple[int, int], prior: float):
        self.terms, self.words, self.idf, self.examples, self.labels, self.bare, self.prior = terms, words, idf, examples, labels, bare, prior

    @cached_property
    def index(self) -> Index:
        """Built where it is used, as it takes several times the examples' room."""
        at, term, tf = self.examples
        example = np.repeat(np.arange(len(at) - 1), np.diff(at))
        return Index(example, term, np.round(vectors(example, term, tf, self.idf), 9), max(len(self.terms), 1), self.labels)

    def score(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, nearest example (-1: none) and its cosine."""
        n = len(offs) - 1
        doc, term, tf = term_counts(buf, offs, self.terms)
        clean, toxic = self.bare
        out = np.full(n, (toxic + self.prior) / (clean + toxic + 1))
        best, cos = np.full((n, K), -1), np.zeros((n, K))
        if len(doc):
            has, doc = np.unique(doc, return_inverse=True)
            best[has], cos[has] = self.index.nearest(doc, term, vectors(doc, term, tf, self.idf), len(has), K)
            w = np.where(best >= 0, 1 / (0.05 + 1 - cos), 0)[:, :, None] * self.index.labels[best]
            votes = w.sum(axis=1)
            out[has] = ((votes[:, 1] + self.prior) / (votes.sum(axis=1) + 1))[has]
        return out, best[:, 0], cos[:, 0]

    def shown(self, example: np.ndarray) -> pa.Array:
        """The words of each of these examples (-1: null)."""
        own, at = np.unique(example, return_inverse=True)
        some, index = own[own >= 0], self.index
        (term,) = stretches(index.start[some], index.start[some + 1], index.term)
        size = index.start[some + 1] - index.start[some]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), self.words.take(pa.array(term)))
        return pc.binary_join(lists, " ").take(pa.array(at - (len(own) - len(some)), mask=example < 0))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic): every row of labels may become an example."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(examples)  # `examples` rows at most
    mine = docs.join(F.broadcast(chosen), docs["id"] == F.col("_id")).groupBy("_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # `examples` rows at most
    mine = materialize(mine)
    words = F.array_distinct(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[a-z0-9\x{80}-\x{10FFFF}]+"), F.lit(0)))
    totals = mine.agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    n, t = totals["n"] or 0, totals["t"] or 0
    if not n:
        return Model(np.zeros(0, np.uint64), pa.array([], pa.string()), np.zeros(0), (np.zeros(1, np.int64), *[np.zeros(0, np.int32)] * 2), np.zeros((0, 2)), (0, 0), 0.5)
    words = mine.select(F.explode(words).alias("word")).distinct().toArrow().column(0).combine_chunks()  # of `examples` texts at most
    hashes = np.concatenate([word_hashes(buf, o)[0] for _, buf, o in text_chunks(words)] or [np.zeros(0, np.uint64)])
    order = np.argsort(hashes)
    hashes, words = hashes[order], words.take(pa.array(order))
    n_docs, df = document_frequencies(docs, hashes)
    idf = np.log((1 + n_docs) / (1 + df)) + 1e-3

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, buf, o in text_chunks(batch.column(1)):
                d, w, tf = term_counts(buf, o, hashes)
                at = np.searchsorted(d, np.arange(len(o))).astype(np.int32)
                vec = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (w, tf)]
                yield pa.record_batch([batch.column(0).slice(i, len(o) - 1), *vec], names=["y", "term", "tf"])

    rows = map_texts(mine.select("y", "text"), cut, "y int, term array<int>, tf array<int>").groupBy("y", "term", "tf").count().toArrow()  # no more than examples
    y, count = (rows.column(c).to_numpy() for c in ("y", "count"))
    terms, tfs = (rows.column(c).combine_chunks() for c in ("term", "tf"))
    at, of, tf = terms.offsets.to_numpy(), terms.values.to_numpy(), tfs.values.to_numpy()
    size, share = np.diff(at), t / n
    seen, toxic = (np.bincount(of, np.repeat(c, size), len(words)) for c in (count, y * count))
    z = np.maximum(np.abs(toxic - seen * share) - 0.5, 0) / np.sqrt(seen * share * (1 - share) + 1)  # rare words need more
    idf = idf * (1 + z * z)
    bare, by = [0, 0], {}
    for k in range(len(y)):
        if not size[k]:
            bare[y[k]] += int(count[k])
            continue
        term = of[at[k] : at[k + 1]]
        w = (1 + np.log(tf[at[k] : at[k + 1]])) * idf[term]
        key = hashlib.blake2b(term.tobytes() + np.round(w / np.sqrt((w * w).sum()), 9).tobytes(), digest_size=16).digest()
        by.setdefault(key, (k, [0, 0]))[1][y[k]] += int(count[k])
    kept = [by[key] for key in sorted(by)]
    group, place = ragged(size[[k for k, _ in kept]] if kept else np.zeros(0, np.int64))
    place += at[[k for k, _ in kept]][group] if kept else 0
    labels = np.array([c for _, c in kept], float).reshape(-1, 2)
    return Model(hashes, words, idf, (np.searchsorted(group, np.arange(len(kept) + 1)), of[place], tf[place]), labels, tuple(bare), share)


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Of all documents: their number, and how many hold each term. The result has one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(terms) + 1, np.int64), len(terms)
        for batch in batches:
            for _, buf, o in text_chunks(batch.column(1)):
                df[:n] += np.bincount(term_counts(buf, o, terms)[1], minlength=n)[:n]
                df[n] += len(o) - 1
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "n"])

    out = np.zeros(len(terms) + 1, np.int64)
    rows = map_texts(docs, run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return int(out[-1]), out[:-1]


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id, score, nearest: the nearest example's terms, cosine."""
    packed, kind = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model)), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(packed.value)
        for batch in batches:
            for k, buf, o in text_chunks(batch.column(1)):
                s, best, cos = m.score(buf, o)
                yield pa.record_batch([batch.column(0).slice(k, len(o) - 1), pa.array(s), m.shown(best), pa.array(cos)], names=["doc_id", "score", "nearest", "cosine"])

    return map_texts(docs.select(id_col, text_col), run, f"doc_id {kind}, score double, nearest string, cosine double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held).select("doc_id", "toxic")
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "nearest", "cosine")
