"""Benchmark decontamination: n-gram seeds lead from passages to test items, Smith-Waterman alignment scores them.

The items are a stated query set; they are taken in blocks of at most BLOCK_GRAMS n-grams, each of them against all documents. Words
are runs of letters and digits, A-Z lower-cased. Every n-gram of an item is a seed, so that a copy is only missed if its edits leave
no WORDS words in a row. One pass finds the seeds in the documents, merges those of one document and item that lie on nearby
diagonals, and aligns the union of their passages with the item (match 2, mismatch -1, gap -1). The
score is the best local alignment's, divided by twice the item's number of words: 1 for an exact copy. Edited and paraphrased
copies lose a share; THRESHOLD decides.

Items of fewer than SHORT words have seeds of two words, as edits leave them few runs of WORDS; a single word is its own seed.

Defined results: a null text has no words and is never contaminated, nor is an item without words found. Links are between ids: rows
that share a doc_id are one document of several texts, items that share an item_id one item of several texts, and the best score of
any two counts; null ids have no links. `decontaminate` judges each row by its own text, whatever its id. Very long texts take time in proportion to their length; empty tables give no rows. Other columns are
ignored, or passed on by `decontaminate`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, map_texts, mix, ragged, span_hash, table, text_chunks, word_spans
from .toxicity import BREAK

WORDS, SHORT, THRESHOLD, BLOCK_GRAMS = 3, 16, 0.5, 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_PLACE = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, places = word_spans(buf, offs, BREAK)
    return span_hash(LOWER[buf], a, b), places


def _grams(w: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; 0 where the document ends before."""
    g = np.zeros(len(w), np.uint64)
    for k in range(n):
        g[: len(w) - k] += w[k:] * _PLACE[k]
    left = np.repeat(places[1:], np.diff(places)) - np.arange(len(w))
    return np.where(left >= n, mix(g + np.uint64(n)), np.uint64(0))


class Items:
    """A block of test items: their words, and their n-grams, which are the seeds."""

    def __init__(self, ids: list[int], texts: list[str], words: int):
        raw = [t.encode() for t in texts]
        offs = np.cumsum([0, *map(len, raw)]).astype(np.int64)
        self.ids = np.array(ids, np.int64)
        self.words, self.places = _words(np.frombuffer(b"".join(raw), np.uint8), offs)
        self.size = np.diff(self.places)
        item, self.at = ragged(self.size)
        length = np.minimum(self.size, np.where(self.size < SHORT, min(words, 2), words))
        self.n = sorted({*length[length > 0].tolist()})  # lengths of n-grams
        at, gram = [], []
        for n in self.n:
            of = (length[item] == n) & (self.at + n <= self.size[item])
            at.append(np.flatnonzero(of))
            gram.append(_grams(self.words, self.places, n)[of])
        at, gram = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((at, np.int64), (gram, np.uint64)))
        order = np.lexsort((at, gram))
        self.item, self.at = item[at][order], self.at[at][order]
        self.known, self.first, self.uses = np.unique(gram[order], return_index=True, return_counts=True)

    def find(self, w: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the words, index in `known`) of the seeds that documents hold."""
        at, hit = [], []
        for n in self.n:
            g = _grams(w, places, n)
            i = np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)
            ok = np.flatnonzero((self.known[i] == g) & (g != 0))
            at.append(ok)
            hit.append(i[ok])
        return (np.concatenate(at), np.concatenate(hit)) if at else (np.zeros(0, np.int64),) * 2


def blocks_of(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[list[int], list[str]]]:
    """Items in turn (each different text of one is a part of its own), so many that they have about `limit` words."""
    ids, texts, size = [], [], 0
    known = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    for r in known.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).distinct().orderBy("i", "t").toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"].split()) + 1
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def smith_waterman(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Best local alignment scores of pairs of sequences: a row of the passage at a time, for all pairs at once."""
    out = np.zeros(len(x), np.int64)
    order = np.argsort([len(a) * 4096 + len(b) for a, b in zip(x, y, strict=True)], kind="stable")
    for part in np.array_split(order, max(1, len(order) // 256)):
        if not len(part):
            continue
        rows, cols = max(len(x[i]) for i in part), max(len(y[i]) for i in part)
        a, b = np.zeros((len(part), rows), np.uint64), np.ones((len(part), cols), np.uint64)  # 0 never equals 1
        for k, i in enumerate(part):
            a[k, : len(x[i])], b[k, : len(y[i])] = x[i], y[i]
        h, best = np.zeros((len(part), cols + 1), np.int64), np.zeros(len(part), np.int64)
        slope = -GAP * np.arange(cols + 1)
        for r in range(rows):
            new = np.zeros_like(h)
            new[:, 1:] = np.maximum(h[:, :-1] + np.where(a[:, r : r + 1] == b, MATCH, MISMATCH), np.maximum(h[:, 1:] + GAP, 0))
            h = np.maximum(np.maximum.accumulate(new + slope, axis=1) - slope, 0)
            np.maximum(best, h.max(axis=1), out=best)
        out[part] = best
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """-> doc_id, item_id, score: documents and the test items that they hold, at `threshold` or above."""
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint, score double")
    for ids, of in blocks_of(benchmark, item_col, item_text_col, block_grams):
        out = out.unionByName(_links(texts, Items(ids, of, words), threshold))
    return out


def _aligned(s: Items, buf: np.ndarray, offs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, score) of the passages that seeds lead to, at the threshold or above."""
    w, places = _words(buf, offs)
    at, hit = s.find(w, places)
    group, use = ragged(s.uses[hit])
    use += s.first[hit][group]
    doc, item = np.searchsorted(places, at[group], "right") - 1, s.item[use]
    begin = at[group] - s.at[use]  # of the item, if nothing before the seed were inserted or missing
    order = np.lexsort((begin, item, doc))
    doc, item, begin = doc[order], item[order], begin[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(begin) > s.size[item[1:]])
    first = np.flatnonzero(head)
    last = np.r_[first[1:], len(doc)][: len(first)] - 1
    doc, item = doc[first], item[first]
    size = s.size[item]
    a = np.maximum(places[doc], begin[first] - size // 2)  # half the item's length may be inserted or missing
    b = np.minimum(places[doc + 1], begin[last] + size + size // 2)
    x, y = [w[p:q] for p, q in zip(a, b, strict=True)], [s.words[p:q] for p, q in zip(s.places[item], s.places[item + 1], strict=True)]
    score = smith_waterman(x, y) / (MATCH * size)
    ok = score >= threshold
    return doc[ok], item[ok], score[ok]


def _links(texts: DataFrame, items: Items, threshold: float) -> DataFrame:
    spark = texts.sparkSession
    if not len(items.known):
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, score double")
    sent = spark.sparkContext.broadcast(items)  # block_grams n-grams at most

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, buf, offs in text_chunks(batch.column(1)):
                doc, item, score = _aligned(sent.value, buf, offs, threshold)
                yield pa.record_batch([batch.column(0).slice(i, len(offs) - 1).take(pa.array(doc)), pa.array(sent.value.ids[item]), pa.array(score)], names=["doc_id", "item_id", "score"])

    aligned = map_texts(texts, align, "doc_id bigint, item_id bigint, score double")
    return aligned.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """docs without the contaminated rows: each row is judged where it is, so nothing is joined or moved."""
    at = docs.columns.index(text_col)

    def without(docs: DataFrame, items: Items) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(items)  # block_grams n-grams at most

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for i, buf, offs in text_chunks(batch.column(at)):
                    clean[i + _aligned(sent.value, buf, offs, threshold)[0]] = False
                yield batch.filter(pa.array(clean))

        return map_texts(docs, keep, docs.schema)

    for ids, of in blocks_of(benchmark, item_col, item_text_col, block_grams):
        if len((items := Items(ids, of, words)).known):
            docs = without(docs, items)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
