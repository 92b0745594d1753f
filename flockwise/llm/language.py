"""Language ID by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the text's likelihood under byte n-gram models, the declared language of the markup, the
address suffix, and the host's prior. The n-gram models are fitted on at most EXAMPLES labelled texts of each language (those of least
hash). Everything else is counted over all rows by grouped aggregation: how often each declared value comes with each language that the
texts alone suggest, and the mix of languages of each suffix, registered domain and host. The mixes are smoothed from level to level:
a host's prior is its own soft counts and STRENGTH rows' worth of its domain's, that of its suffix's, that of the whole table's.
A row's own share is taken out of the counts of every level and of its declared value first, so that no text is evidence twice.

A text's log likelihood is divided by the number of n-grams that read each byte (the sum of ORDERS), as those tell the same thing.
A text is rejected (`lang` null) if it holds no letters, if its n-grams are less likely under each language than `floor` nats below that
language's own texts (NOISE / sqrt(n) more for n n-grams, as short texts vary), or if the posterior is under `confidence`.

Defined results: null texts, marks and hosts are empty strings, which are values like others; a text without letters is decided
by the other evidence but rejected; ties go to the first language in order of name; rows that share an id, or have none, are each judged
alone, by what they hold; very long texts and markup take time in proportion to their length; empty tables
give no rows. Other columns are ignored, or passed on by `keep_known`, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, fresh, map_texts, materialize, table, text_chunks
from .url_filter import host_levels, url_parts

EXAMPLES, SLOTS, ORDERS, STRENGTH = 500, 1 << 15, (2, 3), 20.0
FLOOR, NOISE, CONFIDENCE = 2.5, 20.0, 0.5
#: Names of languages in markup that mean one of ours: the part before - or _ is looked at.
LETTER = np.zeros(256, bool)
LETTER[[c for c in range(256) if chr(c).isalpha() or c >= 128]] = True


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of every byte n-gram of letters; what isn't a letter is one space."""
    b = np.where(LETTER[buf], LOWER[buf], 32).astype(np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    where, slots = [], []
    for n in ORDERS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        key = np.full(m, n, np.int64)
        for k in range(n):
            key = key * 263 + b[k : k + m]
        ok = (doc[:m] == doc[n - 1 :]) & ~((b[:m] == 32) & (b[1 : m + 1] == 32))
        where.append(doc[:m][ok])
        slots.append((((key * 2654435761) >> 13) & (SLOTS - 1))[ok])
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(where), np.concatenate(slots)


class Model:
    """Log likelihoods of n-grams by language, and what a language's own texts have on average."""

    def __init__(self, langs: list[str], logp: np.ndarray, usual: np.ndarray):
        self.langs, self.logp, self.usual = langs, logp, usual

    def texts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, languages): mean log likelihood of an n-gram; number of n-grams."""
        doc, slot = grams(buf, offs)
        n = np.bincount(doc, minlength=len(offs) - 1)
        out = np.stack([np.bincount(doc, p[slot], minlength=len(offs) - 1) for p in self.logp], axis=1) if len(self.langs) else np.zeros((len(n), 0))
        letters = np.add.reduceat(np.r_[LETTER[buf], False].astype(np.int64), offs[:-1])
        return out / np.maximum(n, 1)[:, None], np.where((np.diff(offs) > 0) & (letters > 0), n, 0)


def fit(labelled: DataFrame, *, text_col: str = "text", label_col: str = "lang", examples: int = EXAMPLES) -> Model:
    """On at most `examples` different texts of each language: copies of one text are one example."""
    spark = labelled.sparkSession
    known = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(label_col) != ""))
    # copies share a hash; counting different hashes moves no texts
    different = known.select(F.col(label_col).alias("lang"), F.xxhash64(text_col, label_col).alias("h")).distinct()
    counts = {r[0]: r[1] for r in different.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(counts)
    none = Model(langs, np.zeros((len(langs), SLOTS)), np.zeros(len(langs)))
    if not langs:
        return none
    # a share of each language that gives about twice the examples, then the least hashes of those
    h = F.pmod(F.xxhash64(text_col, label_col), F.lit(1 << 40))
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, float(min(1.0, (2.0 * examples + 50) / counts[k])))]), F.col(label_col))
    few = known.where(h < share * F.lit(float(1 << 40))).select(F.col(label_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h"))
    rows = spark.createDataFrame([], few.schema)
    for lang in langs:
        rows = rows.unionByName(few.where(F.col("lang") == lang).distinct().orderBy("h", "text").limit(examples))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = np.array([langs.index(x) for x in batch.column(0).to_pylist()], np.int64)
            for i, buf, offs in text_chunks(batch.column(1)):
                doc, slot = grams(buf, offs)
                key, n = np.unique(which[i + doc] * SLOTS + slot, return_counts=True)
                yield pa.record_batch([pa.array(key), pa.array(n)], names=["key", "n"])

    n = np.zeros(len(langs) * SLOTS)
    for r in map_texts(rows.select("lang", "text"), count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect():  # SLOTS a language at most
        n[r["key"]] = r["n"]
    n = n.reshape(len(langs), SLOTS)
    p = (n + 0.1) / (n + 0.1).sum(axis=1, keepdims=True)
    logp = np.log(p)
    return Model(langs, logp, (n * logp).sum(axis=1) / np.maximum(n.sum(axis=1), 1))


def _normal(col):
    """Log weights (array) -> probabilities."""
    top = F.array_max(col)
    e = F.transform(col, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _soft_counts(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("p")[k]) for k in range(n)]).alias("c"))


def identify(rows: DataFrame, model: Model, *, confidence: float = CONFIDENCE, floor: float = FLOOR, strength: float = STRENGTH) -> DataFrame:
    """rows(id, text, declared, suffix, domain, host) -> id, lang, best, posterior, declared, host, text_lang, n_grams."""
    langs, n = model.langs, len(model.langs)
    if not n:
        return rows.select("id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("posterior"), "declared", "host", F.lit(None).cast("string").alias("text_lang"), F.lit(0).cast("long").alias("n_grams"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, buf, offs in text_chunks(batch.column(1)):
                mean, m = model.texts(buf, offs)
                odd = (model.usual - mean).min(axis=1)
                logs = mean * m[:, None] / sum(ORDERS)
                size = len(m)
                at = pa.array((np.arange(size + 1) * n).astype(np.int32))
                yield pa.record_batch([*(batch.column(c).slice(i, size) for c in (0, 2, 3, 4, 5)), pa.ListArray.from_arrays(at, pa.array(logs.ravel())), pa.array(m.astype(np.int64)), pa.array(odd)], names=["id", "declared", "suffix", "domain", "host", "logs", "n_grams", "odd"])

    strings = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("declared", "suffix", "domain", "host")]
    seen = map_texts(rows.select("id", "text", *strings), run, f"id {kind}, declared string, suffix string, domain string, host string, logs array<double>, n_grams bigint, odd double")
    seen = materialize(seen.withColumn("p", _normal(F.col("logs"))))
    hosts = materialize(_soft_counts(seen, ["suffix", "domain", "host"], n))
    up = lambda keys: hosts.groupBy(*keys).agg(F.array(*[F.sum(F.col("c")[k]) for k in range(n)]).alias("c"))
    whole = [(c or 0.0) + 1.0 for c in up([]).first()["c"] or [0.0] * n]  # one row
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    others = lambda c: F.zip_with(c, "p", lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def smoothed(counts, prior):
        return F.zip_with(counts, prior, lambda c, p: (c + strength * p) / (total(counts) + strength))

    domains = up(["suffix", "domain"]).withColumnRenamed("c", "cd").join(up(["suffix"]).withColumnRenamed("c", "cs"), "suffix")
    levels = materialize(hosts.join(domains, ["suffix", "domain"]))
    declared = materialize(_soft_counts(seen, ["declared"], n).withColumnRenamed("c", "dd"))
    joined = seen.join(levels, ["suffix", "domain", "host"]).join(declared, "declared")
    # counts of the other rows, by level
    joined = joined.select("id", "declared", "host", "n_grams", "odd", "logs", "p", F.zip_with(F.array(*[F.lit(c) for c in whole]), "p", lambda c, p: (c - p) / (sum(whole) - 1)).alias("base"), *[others(c).alias(c) for c in ("c", "cd", "cs", "dd")])
    base, prior = F.col("base"), smoothed(F.col("c"), smoothed(F.col("cd"), smoothed(F.col("cs"), F.col("base"))))
    # what the declared value means, shrunk to none of it telling anything: log P(declared | language), but for a constant
    told = F.zip_with(smoothed(F.col("dd"), base), base, lambda a, b: F.log(a) - F.log(b))
    logs = F.zip_with(F.zip_with("logs", prior, lambda a, b: a + F.log(b)), told, lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in langs])
    argmax = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    out = joined.select("id", "declared", "host", "n_grams", "odd", "p", _normal(logs).alias("post"))
    best, posterior = argmax(F.col("post")), F.array_max("post")
    sure = (F.col("n_grams") > 0) & (F.col("odd") <= floor + NOISE / F.sqrt("n_grams")) & (posterior >= confidence)
    return out.select("id", F.when(sure, best).alias("lang"), best.alias("best"), F.round(posterior, 6).alias("posterior"), "declared", "host", argmax(F.col("p")).alias("text_lang"), "n_grams")


_OPEN = re.compile(r"<!--|<(script|style)\b", re.I)
_CLOSE = {"": re.compile("-->"), **{k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style")}}
_TAG = re.compile(r"<[^<>]*>")
_HTML = re.compile(r"<html\b([^>]*)", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)


def visible(markup: str) -> str:
    """Its text: scripts, styles, comments and tags are spaces. An opening that nothing closes is looked up once."""
    out, at, open_ = [], 0, set()
    for m in _OPEN.finditer(markup):
        kind = (m[1] or "").lower()
        if m.start() < at or kind in open_:
            continue
        end = _CLOSE[kind].search(markup, m.end())
        if end is None:
            open_.add(kind)
            continue
        out.append(markup[at : m.start()])
        at = end.end()
    out.append(markup[at:])
    return html_lib.unescape(_TAG.sub(" ", " ".join(out))).encode("utf-8", "replace").decode()


def declared_language(markup: str) -> str:
    tag = _HTML.search(markup)
    m = _LANG.search(tag[1]) if tag else None
    return m[1].lower() if m else ""


def page_texts(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """-> id, text, declared, url: visible text of markup and the language that it declares."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or "" for x in batch.column(1).to_pylist()]
            said, text = [declared_language(x) for x in raw], [visible(x) for x in raw]
            yield pa.record_batch([batch.column(0), pa.array(text, pa.string()), pa.array(said, pa.string()), batch.column(2)], names=["id", "text", "declared", "url"])

    return map_texts(pages.select(id_col, html_col, url_col), run, f"id {kind}, text string, declared string, url string")


def keep_known(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source", **how) -> DataFrame:
    """docs without those rows that are rejected. A source stands for the host. Rows of one text, declared language and source have one
    verdict, so the rejected ones are found by hashes of these (128 bits), whatever their ids."""
    name, parts = fresh(docs, "_key"), [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, declared_col, host_col)]
    key = F.concat(F.hex(F.xxhash64(*parts)), F.lit("-"), F.hex(F.xxhash64(F.lit(9), *parts)))
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text"), F.col(declared_col).alias("declared"), F.lit("").alias("suffix"), F.lit("").alias("domain"), F.col(host_col).alias("host"))
    bad = materialize(identify(rows, model, **how).where(F.col("lang").isNull()).select(F.col("id").alias(name)).distinct())
    return docs.withColumn(name, key).join(bad, name, "left_anti").drop(name)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, by models of the documents' languages."""
    model = fit(table(spark, sf_dir, "documents").select("text", "lang"))
    rows = page_texts(table(spark, sf_dir, "pages"))
    host, _ = url_parts(F.col("url"))
    suffix, domain = host_levels(F.col("host"))
    rows = rows.withColumn("host", host).select("id", "text", "declared", suffix.alias("suffix"), domain.alias("domain"), "host")
    return identify(rows, model).withColumnRenamed("id", "page_id")
