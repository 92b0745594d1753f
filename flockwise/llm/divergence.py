"""Source divergence audit: how far the sources of a language differ from one another and from the language, term by term.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps those that LEAST of its documents
hold. A group (language and source) gives each kept term p = 1 + floor(SCALE * (count + 1) / (N + V)), N the group's occurrences of
kept terms and V the number of kept terms; so does the language as a whole. Two such numbers diverge by f = floor((p - q)^2 / q).

Terms are not compared one by one. A term's counts by source are a sparse vector; terms with the same vector are one class with a
multiplicity, so that every pair of sources is evaluated once for a class. Within a class only the sources that hold it are paired;
what the others have is p at a count of zero, which a source's own histogram of counts settles: the sum over all terms is that with
both counts zero, corrected by the terms that one has and by those that both have. All of it is exact integer arithmetic, in decimals
where products pass 64 bits. At the end the classes' values go back to the terms, of which the TOP of each group are ranked.

Each task counts its own texts first, so that no key moves more than a few rows a task, however common it is. Pairs of sources are
the result and hence inherent; a class needs its own sources in one row.

Defined results: null texts, languages and sources are ''; rows that share a doc_id are rows each; a source without kept terms has
all pairs, and no terms; a language without kept terms has pairs of value 0; a language of one source has no pairs; empty tables give
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, map_texts, materialize, table, text_chunks, word_spans

LEAST, SCALE, TOP = 3, 1_000_000_000, 200
#: Bytes of text counted at once, and rows of counts that a task holds before it passes them on.
CHUNK, HELD = 1 << 21, 1 << 18
#: What isn't part of a term.
GAP = np.ones(256, bool)
GAP[65:91] = GAP[97:123] = GAP[128:] = False


def _counted(buf: np.ndarray, offs: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents in groups: the terms, then (group, term, occurrences, documents) of what occurs."""
    a, b, places = word_spans(buf, offs, GAP)
    ends = np.r_[0, np.cumsum(b - a)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(LOWER[buf[~GAP[buf]]])]).dictionary_encode()
    doc, n = np.repeat(np.arange(len(group)), np.diff(places)), max(len(words.dictionary), 1)
    key, times = np.unique(doc * n + words.indices.to_numpy(), return_counts=True)
    both, at = np.unique(group[key // n] * n + key % n, return_inverse=True)
    return words.dictionary, both // n, both % n, np.bincount(at, times, len(both)).astype(np.int64), np.bincount(at, minlength=len(both)).astype(np.int64)


def counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """-> lang, source, term, c, d: occurrences and documents of parts of the corpus, to be added up."""
    names = ["lang", "source", "term", "c", "d"]

    def merged(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held).combine_chunks().group_by(names[:3], use_threads=False).aggregate([("c", "sum"), ("d", "sum")])
        return t.rename_columns(names) if t.column_names[0] == "lang" else t.select(["lang", "source", "term", "c_sum", "d_sum"]).rename_columns(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            for i, buf, offs in text_chunks(batch.column(2), CHUNK):
                words, g, w, c, d = _counted(buf, offs, group[i : i + len(offs) - 1])
                if not len(g):
                    continue
                cols = [lang.dictionary.take(pa.array(g // len(source.dictionary))), source.dictionary.take(pa.array(g % len(source.dictionary))), words.take(pa.array(w)).cast(pa.string()), pa.array(c), pa.array(d)]
                held.append(pa.table(cols, names=names))
                n += len(g)
            if n > 2 * HELD:
                held = [merged(held)]
                n = len(held[0])
                if n > HELD:
                    yield from held[0].to_batches()
                    held, n = [], 0
        if held:
            yield from merged(held).to_batches()

    of = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (lang_col, source_col, text_col)])
    return map_texts(of, run, "lang string, source string, term string, c bigint, d bigint")


def share(c, n, v):
    """p of a count, exactly: products pass 64 bits."""
    whole = lambda x: x.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(c + 1), whole(F.greatest(n + v, F.lit(1)))) + 1


def diverge(p, q):
    """floor((p - q)^2 / q); p and q are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def vectors(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """Counts -> lang, term, v: array of (source, c) in order of source, of the kept terms. One shuffle, by language and term."""
    c = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    v = c.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "c"))).alias("v"), F.sum("d").alias("d"))
    return v.where(F.col("d") >= least).select("lang", "term", "v")


def _pairs(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """classes(lang, v, m), groups(lang, source, n, terms) -> lang, source, item, value."""
    a, b = (groups.select("lang", F.col("source").alias(k), F.col("n").alias(f"n{k}"), "terms") for k in "ab")
    both = a.join(b, ["lang", "terms"]).where("a <> b")
    p = lambda k, c: share(c, F.col(f"n{k}"), F.col("terms"))
    zero = F.lit(0).cast("bigint")
    none = diverge(p("a", zero), p("b", zero))
    wide = lambda x: x.cast("decimal(38,0)")
    out = both.select("lang", "a", "b", wide(F.when(F.col("terms") > 0, none).otherwise(0) * F.col("terms")).alias("value"))
    # what one source has, as if the other had none of it
    seen = classes.select("lang", "m", F.explode("v").alias("x")).groupBy("lang", F.col("x.source").alias("s"), F.col("x.c").alias("c")).agg(F.sum("m").alias("m"))
    seen = materialize(seen)
    for k, value in (("a", diverge(p("a", F.col("c")), p("b", zero))), ("b", diverge(p("a", zero), p("b", F.col("c"))))):
        out = out.unionAll(seen.withColumnRenamed("s", k).join(both, ["lang", k]).select("lang", "a", "b", wide((value - none) * F.col("m")).alias("value")))
    # what both have, for a class once: its value less what was put in its place above
    x = classes.select("lang", "m", "v", F.posexplode("v").alias("i", "x"))
    x = x.select("lang", "m", "x", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("y"))
    met = x.groupBy("lang", F.col("x.source").alias("a"), F.col("x.c").alias("ca"), F.col("y.source").alias("b"), F.col("y.c").alias("cb")).agg(F.sum("m").alias("m"))
    met = materialize(met)
    met = met.unionAll(met.select("lang", F.col("b").alias("a"), F.col("cb").alias("ca"), F.col("a").alias("b"), F.col("ca").alias("cb"), "m"))
    pa_, pb = p("a", F.col("ca")), p("b", F.col("cb"))
    own = diverge(pa_, pb) - diverge(pa_, p("b", zero)) - diverge(p("a", zero), pb) + none
    out = out.unionAll(met.join(both, ["lang", "a", "b"]).select("lang", "a", "b", wide(own * F.col("m")).alias("value")))
    return out.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").cast("bigint").alias("value"))


def _terms(terms: DataFrame, classes: DataFrame, groups: DataFrame, langs: DataFrame, top: int) -> DataFrame:
    """-> lang, source, item, value, rank: the terms that a source has more of than its language."""
    x = classes.select("lang", "v", F.aggregate("v", F.lit(0).cast("bigint"), lambda s, y: s + y.c).alias("all"), F.explode("v").alias("x"))
    x = x.select("lang", "v", "all", F.col("x.source").alias("source"), F.col("x.c").alias("c")).join(groups, ["lang", "source"]).join(langs, "lang")
    x = x.withColumn("p", share(F.col("c"), F.col("n"), F.col("terms"))).withColumn("q", share(F.col("all"), F.col("whole"), F.col("terms")))
    x = x.where("p > q").select("lang", "v", "source", diverge(F.col("p"), F.col("q")).alias("value"))
    # of equal values all classes stay; of a class no more than its first terms can be among a group's
    x = x.withColumn("k", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("k") <= top).drop("k")
    firsts = terms.withColumn("k", F.row_number().over(Window.partitionBy("lang", "v").orderBy("term"))).where(F.col("k") <= top).select("lang", "v", F.col("term").alias("item"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return x.join(firsts, ["lang", "v"]).select("lang", "source", "item", "value", F.row_number().over(best).alias("rank")).where(F.col("rank") <= top)


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """-> lang, source, part, item, value, rank."""
    terms = materialize(vectors(counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col), least))
    classes = materialize(terms.groupBy("lang", "v").agg(F.count("*").alias("m")))
    of = classes.select("lang", "m", F.explode("v").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum(F.col("m") * F.col("x.c")).alias("n"))
    langs = classes.groupBy("lang").agg(F.sum("m").alias("terms")).join(of.groupBy("lang").agg(F.sum("n").alias("whole")), "lang")
    langs = materialize(langs)
    seen = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    groups = seen.join(of, ["lang", "source"], "left").join(langs.select("lang", "terms"), "lang", "left")
    groups = materialize(groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n", "terms")]))
    pairs = _pairs(classes, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    best = _terms(terms, classes, groups.drop("terms"), langs, top)
    return pairs.unionAll(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang,'') AS lang, coalesce(source,'') AS source, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r)>=3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(c),0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c,0) AS c, 1+(1000000000::HUGEINT*(coalesce(c.c,0)+1))//(n+v) AS p FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang=g.lang AND c.source=g.source AND c.term=k.term),
l AS (SELECT lang, term, 1+(1000000000::HUGEINT*(sum(c)+1))//(sum(sum(c)) OVER (PARTITION BY lang)+any_value(v)) AS q FROM c JOIN v USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p-b.p)*(a.p-b.p))//b.p) AS value FROM p a JOIN p b ON a.lang=b.lang AND a.term=b.term AND a.source<>b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value,0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang=b.lang AND a.source<>b.source LEFT JOIN f ON f.lang=a.lang AND f.source=a.source AND f.item=b.source),
terms AS (SELECT p.lang, source, 'term' AS part, term AS item, CAST(((p-q)*(p-q))//q AS BIGINT) AS value FROM p JOIN l USING (lang, term) WHERE c>0 AND p>q),
both_ AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM both_ WHERE part='pair' OR rank<=200
"""
