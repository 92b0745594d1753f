"""License scans: ordered signature rules, gated by keywords, with priority and interval containment to settle overlaps.

The rules (`license_rules`, some three hundred) are regular expressions over a text's words: runs of ASCII letters and digits and of
characters beyond ASCII, A-Z lower-cased. A text that holds none of the gates is done after counting its words. Of the others the words
are numbered and joined, so that a match brings the places of its first and last word along, and only those rules are tried whose gate
and keyword the text holds. A detection is dropped if one of the same or a stronger tier contains its interval (of equal intervals the
earlier rule's stays): "GNU General Public License, version 3" is gpl-3.0 and nothing less. One sweep over a text's detections in
order of place settles that, with the furthest end that each tier has reached, so repeated phrases take linear time.

Three phrases are always labels, whatever the rules say: their places, first and last are counted by themselves.

All of it is a projection: built-in functions only, no shuffle, a row at a time.

Defined results: a null text is empty (no words, no labels, score 0); rows are rows each, whatever their id; empty tables give no rows.
Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table
from .license_rules import CONFIDENCE, rules

#: The phrases that are always labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Beyond the last tier.
TIERS = max(CONFIDENCE) + 1


def tagged_pattern(pattern: str) -> str:
    """A rule's pattern over words as one over numbered words: each is ' word#number'."""
    return " " + pattern.replace(" ?", "\x01").replace(" ", r"#\d+ ").replace("\x01", r"(?:#\d+ )?").replace("_", "[^ #]+") + r"#\d+"


def _literal_rules() -> Column:
    kinds = "array<struct<no:int,tier:int,label:string,gate:string,keyword:string,pattern:string>>"
    return F.array(*[F.struct(*[F.lit(v) for v in (no, tier, label, gate, key, tagged_pattern(p))]) for no, tier, label, gate, key, p in rules()]).cast(kinds)


def _spans(tagged: Column, rule: Column) -> Column:
    """Detections of a rule: first word, minus the last, tier, rule, label; in this order they are sorted."""
    number = lambda m, p: F.regexp_extract(m, p, 1).cast("int")
    return F.transform(F.regexp_extract_all(tagged, rule.pattern, F.lit(0)), lambda m: F.struct(number(m, r"#(\d+)").alias("a"), (-number(m, r"#(\d+)$")).alias("b"), rule.tier.alias("tier"), rule.no.alias("no"), rule.label.alias("label")))


def _kept(found: Column) -> Column:
    """(label, tier) of the detections that no other one of the same or a stronger tier contains."""
    one = F.struct(F.array_repeat(F.lit(-1), TIERS).alias("far"), F.array().cast("array<struct<label:string,tier:int>>").alias("kept"))

    def step(s, d):
        inside = F.exists(F.slice(s.far, 1, d.tier + 1), lambda e: e >= -d.b)
        far = F.transform(s.far, lambda e, k: F.when(k == d.tier, F.greatest(e, -d.b)).otherwise(e))
        kept = F.when(inside, s.kept).otherwise(F.array_union(s.kept, F.array(F.struct(d.label.alias("label"), d.tier.alias("tier")))))
        return F.struct(far.alias("far"), kept.alias("kept"))

    return F.aggregate(F.sort_array(found), one, step, lambda s: s.kept)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id, n_words, places (first words of the phrases), base_labels, labels (array of label and tier)."""
    gates = sorted({x[3] for x in rules()} | {"license"})
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = text.withColumn("any", F.lower("text"))  # for the gates only: it may hold more than the rules' own lower case
    held = reduce(or_, [F.contains("any", F.lit(g)) for g in gates])
    words = text.select("doc_id", F.when(held, ascii_lower(F.col("text"))).alias("low"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    numbered = F.transform("words", lambda w, i: F.concat(F.lit(" "), ascii_lower(w), F.lit("#"), i.cast("string")))
    words = words.select("doc_id", "low", F.size("words").cast("long").alias("n_words"), F.when(F.col("low").isNotNull(), F.array_join(numbered, "")).alias("tagged"))
    base = F.regexp_extract_all("tagged", F.lit(" (?:" + "|".join(tagged_pattern(p)[1:] for p in PHRASES) + ")"), F.lit(0))
    tried = F.filter(_literal_rules(), lambda r: F.contains(F.col("low"), r.gate) & F.contains(F.col("low"), r.keyword))
    found = F.flatten(F.transform(tried, lambda r: _spans(F.col("tagged"), r)))
    out = words.select("doc_id", "n_words", base.alias("base"), F.when(F.col("tagged").isNotNull(), _kept(found)).alias("kept"))
    none = F.array().cast("array<string>")
    said = lambda p: F.exists("base", lambda m: F.regexp_replace(m, r"#\d+", "") == F.lit(" " + p))
    labels = F.array_compact(F.array(*[F.when(said(p), F.lit(label)) for p, label in PHRASES.items()]))
    out = out.select("doc_id", "n_words", F.coalesce("base", none).alias("base"), F.coalesce(labels, none).alias("base_labels"), F.coalesce("kept", F.array().cast("array<struct<label:string,tier:int>>")).alias("labels"))
    return out.select("doc_id", "n_words", F.transform("base", lambda m: F.regexp_extract(m, r"#(\d+)", 1).cast("long")).alias("places"), "base_labels", "labels")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents"))
    weight = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    labels = F.array_sort(F.array_union("base_labels", F.transform("labels", lambda x: x.label)))
    score = F.coalesce(F.array_max(F.transform("labels", lambda x: F.element_at(weight, x.tier))), F.lit(0.0))
    return s.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_GATES = sorted({x[3] for x in rules()} | {"license"})
ORACLE_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT r, doc_id, low, regexp_extract_all(low, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM d),
t AS (SELECT *, array_to_string(list_transform(w, lambda x, i: ' '||x||'#'||(i-1)), '') AS tagged FROM w WHERE {" OR ".join(f"contains(low,{_quoted(g)})" for g in _GATES)}),
p AS (SELECT r, unnest(regexp_extract_all(tagged, ' (?:{"|".join(tagged_pattern(p)[1:] for p in PHRASES)})')) AS m FROM t),
b AS (SELECT r, count(*) AS n, min(CAST(regexp_extract(m,'#(\\d+)',1) AS BIGINT)) AS first_word, max(CAST(regexp_extract(m,'#(\\d+)',1) AS BIGINT)) AS last_word, list_sort(list(DISTINCT CASE regexp_replace(m,'#\\d+','','g') {" ".join(f"WHEN {_quoted(' ' + p)} THEN {_quoted(v)}" for p, v in PHRASES.items())} END)) AS labels FROM p GROUP BY r),
rule(no, tier, label, gate, keyword, pattern) AS (VALUES {", ".join(f"({no},{tier},{_quoted(label)},{_quoted(gate)},{_quoted(key)},{_quoted(tagged_pattern(p))})" for no, tier, label, gate, key, p in rules())}),
m AS (SELECT r, no, tier, label, unnest(regexp_extract_all(tagged, pattern)) AS m FROM t JOIN rule ON contains(low, gate) AND contains(low, keyword)),
s AS (SELECT r, no, tier, label, CAST(regexp_extract(m,'#(\\d+)',1) AS INT) AS a, CAST(regexp_extract(m,'#(\\d+)$',1) AS INT) AS b FROM m),
k AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.r=s.r AND o.tier<=s.tier AND o.a<=s.a AND o.b>=s.b AND (o.a<s.a OR o.b>s.b OR o.tier<s.tier OR o.no<s.no))),
c AS (SELECT r, list_sort(list(DISTINCT label)) AS labels, max(CASE tier {" ".join(f"WHEN {k} THEN {v}" for k, v in CONFIDENCE.items())} END::DOUBLE) AS score FROM k GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n,0) AS n_base, first_word, last_word, coalesce(array_to_string(b.labels,','),'') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels,[]),coalesce(c.labels,[])))),','),'') AS labels, coalesce(score,0.0::DOUBLE) AS score FROM w LEFT JOIN b USING (r) LEFT JOIN c USING (r)
"""
