"""PII: patterns, then information-theoretic sanitisation. DataFrame functions only.

Base spans: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers, leftmost and non-overlapping per kind. These four
and credentials (a marker such as `token =` and what follows it) are the protected entities, by kind.

A term reveals a kind as far as the corpus says so. Terms are words, and the shapes of words that mix letters and digits (their
alphabet and length), since such a word hardly occurs twice. Counts are of units: a document without entities is one, and documents
with the very same entities are one together, so that copies prove nothing. With n(t) units that hold the term, n(k) that hold an
entity of the kind and n(k,t) that hold both, PMI(t;k) = log2(n(k,t) N / (n(t) n(k))), and the kind's information content is
IC(k) = log2(N / n(k)). A term discloses the kind where PMI >= `disclosure` of IC and the units are evidence of it: n(t) times the
divergence of n(k,t)/n(t) from n(k)/N, in nats, reaches `evidence` (chance reaches that in one of exp(-evidence) cases). Wherever a
disclosing term stands in a document with an entity of its kind, it is removed if it is a shape, or else generalised to [TERM]. What
overlaps a base span stays part of that; markers themselves are left alone.

Rows have a key of their own from the first step on, so null and repeated ids never meet another row's text.

Defined results: a null text is empty and has no spans, and stays null in `sanitise`; null ids and repeated ids and rows are rows like
any other; very long texts are located and cut in time in proportion to their length; empty tables give no rows. Other columns are
passed on by `sanitise` and otherwise ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, materialize, pieces, running, table

#: Possessive forms of the base patterns. A mail address starts where a run of its characters does, or where the last match ended:
#: within a run no later start can succeed where the first one fails.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Markers of a credential, fixed: what follows one is protected.
MARKERS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "private_key", "credential")
CREDENTIAL = r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(MARKERS) + r")[\"']?[\x20\t]{0,3}[:=][\x20\t]{0,3}[^\x20\x09-\x0D]{1,128}"
CLASSES = (*KINDS, "credential")
#: Each kind's text holds this; it is looked for first.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]", "credential": r"(?i)[a-z][\"']?[\x20\t]{0,3}[:=]"}
WORD = r"[\p{L}\p{N}_]{3,}"
SPANS = "array<struct<start:int,end:int,value:string>>"
ADDED = "array<struct<kind:string,start:int,end:int,removed:boolean>>"
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
#: So many candidate terms at most are broadcast; with more, all words are counted and joined.
BROADCAST_TERMS = 100_000


def _digits(v):
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits):
    """Digits pass Luhn's test."""
    n = F.length(digits)
    at = F.sequence(F.lit(1), n)
    total = F.aggregate(
        at, F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def _valid(kind: str, v):
    if kind == "ip":
        # leading zeros may make a part long without making it large
        return F.forall(F.split(v, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(v, r"\."), lambda p: F.substring(F.concat(F.lit("000"), F.regexp_replace(p, "^0+(?=.)", "")), -3, 3).cast("int") <= 255)
    if kind == "card":
        d = _digits(v)
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def locate(df: DataFrame, patterns: dict[str, str], hints: dict[str, str]) -> DataFrame:
    """df with a column more for each pattern: where its successive matches lie in `text`, array<struct<start,end,value>>, in code points.

    The text is split by the pattern once: a match starts where all pieces and matches before it end.
    """
    text, had = F.col("text"), df.columns

    def found(n):
        all_ = F.regexp_extract_all(text, F.lit(patterns[n]), F.lit(0))
        return (F.when(text.rlike(hints[n]), all_) if n in hints else all_).alias(f"{n}_v")

    df = df.select("*", *[found(n) for n in patterns])
    df = df.select("*", *[F.when(F.size(f"{n}_v") > 0, F.transform(F.slice(F.split(text, patterns[n], -1), F.lit(1), F.size(f"{n}_v")), lambda g: F.length(g))).alias(f"{n}_g") for n in patterns])
    df = df.select("*", *[F.zip_with(f"{n}_g", f"{n}_v", lambda g, v: g + F.length(v)).alias(f"{n}_p") for n in patterns])
    df = running(df, [f"{n}_p" for n in patterns], lambda a, b: a + b)
    df = df.select("*", *[F.zip_with(f"{n}_p", f"{n}_g", lambda p, g: p + g).alias(f"{n}_s") for n in patterns])
    span = lambda s, v: F.struct(s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value"))
    return df.select(*had, *[F.when(F.size(f"{n}_v") > 0, F.zip_with(f"{n}_s", f"{n}_v", span)).otherwise(F.array().cast(SPANS)).alias(n) for n in patterns])


def _valid_only(kind: str):
    return F.filter(kind, lambda s: _valid(kind, s.value))


def _values(kind: str):
    return F.transform(kind, lambda s: F.concat(F.lit(kind + ":"), s.value))


def _base(kind: str):
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end"), F.lit(False).alias("removed")))


def find_base(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """-> row (a key), d (the row of docs), text, and email, ip, card, phone, credential: arrays of (start, end, value)."""
    out = docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = locate(out, {**PATTERNS, "credential": CREDENTIAL}, HINT)
    return out.select("row", "d", "text", *[_valid_only(k).alias(k) if k in KINDS else F.col(k) for k in CLASSES])


def _shape(w):
    alphabet = F.when(w.rlike("^[0-9a-f]+$"), "hex").otherwise("mixed")
    return F.when((F.length(w) >= 8) & w.rlike("[0-9]") & w.rlike("[a-z]"), F.concat(F.lit("#"), alphabet, F.lit(":"), F.length(w).cast("string")))


def _terms(text):
    """A text's different words and shapes."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.when(_shape(w).isNull(), F.array(w)).otherwise(F.array(w, _shape(w))))))


def disclosing_terms(work: DataFrame, *, disclosure: float = 0.8, evidence: float = 20.0) -> DataFrame:
    """work(row, text, has: which classes, unit: null without any) -> term, kinds: booleans, by class."""
    spark = work.sparkSession
    flags = [F.col("has")[i].alias(f"k{i}") for i in range(len(CLASSES))]
    unit = work.where(F.col("unit").isNotNull()).select("unit", *flags).distinct()
    sums = [F.coalesce(F.sum(F.col(f"k{i}").cast("long")), F.lit(0)).alias(f"k{i}") for i in range(len(CLASSES))]
    totals = unit.agg(F.count("*").alias("n"), *sums).first()  # one row
    total = totals["n"] + work.where(F.col("unit").isNull()).count()
    classes = [i for i in range(len(CLASSES)) if 0 < totals[f"k{i}"] < total]
    if not classes:
        return spark.createDataFrame([], "term string, kinds array<boolean>")

    def tells(i, n, both):
        """Both thresholds, for a term of n units, `both` of which hold class i."""
        p = totals[f"k{i}"] / total
        share = both / n
        rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0)
        return (both > 0) & (F.log2(share / p) >= disclosure * math.log2(1 / p)) & (n * (share * F.log(share / p) + rest) >= evidence)

    terms = work.where(F.col("unit").isNotNull()).select("unit", *flags, F.explode(_terms(F.col("text"))).alias("term")).distinct()
    held = terms.groupBy("term").agg(F.count("*").alias("n"), *[F.sum(F.col(f"k{i}").cast("long")).alias(f"k{i}") for i in range(len(CLASSES))])
    # units without entities can only lower a share
    may = F.lit(False)
    for i in classes:
        may = may | tells(i, F.col("n"), F.col(f"k{i}"))
    held = materialize(held.where(may))
    words = work.where(F.col("unit").isNull()).select(F.explode(_terms(F.col("text"))).alias("term"))
    if held.count() <= BROADCAST_TERMS:
        words = words.join(F.broadcast(held.select("term")), "term", "left_semi")
    free = words.groupBy("term").agg(F.count("*").alias("free"))
    out = held.join(free, "term", "left").withColumn("n", F.col("n") + F.coalesce("free", F.lit(0)))
    kinds = F.array(*[tells(i, F.col("n"), F.col(f"k{i}")) if i in classes else F.lit(False) for i in range(len(CLASSES))])
    return materialize(out.select("term", kinds.alias("kinds")).where(F.exists("kinds", lambda k: k) & ~F.col("term").isin(*MARKERS)))


def find_pii(docs: DataFrame, *, text_col: str = "text", **thresholds) -> DataFrame:
    """-> row, d (the row of docs), text, base, added: arrays of (kind, start, end, removed), each by kind as listed and start."""
    found = find_base(docs, text_col=text_col)
    values = F.array_sort(F.array_distinct(F.concat(*[_values(k) for k in CLASSES])))
    base = F.concat(*[_base(k) for k in KINDS]).cast(ADDED)
    has = F.array(*[F.size(k) > 0 for k in CLASSES])
    work = found.select("row", "d", base.alias("base"), has.alias("has"), F.when(F.exists(has, lambda x: x), F.xxhash64(values)).alias("unit"))
    work = materialize(work).withColumn("text", F.coalesce(F.col("d")[text_col], F.lit("")))
    told = disclosing_terms(work, **thresholds)
    some = work.where(F.col("unit").isNotNull())
    held = some.select("row", "has", F.explode(_terms(F.col("text"))).alias("term")).join(told, "term")
    held = held.where(F.exists(F.zip_with("has", "kinds", lambda a, b: a & b), lambda x: x)).groupBy("row").agg(F.collect_set("term").alias("told"))
    some = some.join(held, "row", "left").select("row", "d", "text", "base", "told")
    yes = locate(some.where(F.col("told").isNotNull()), {"words": WORD}, {})
    hit = F.filter("words", lambda w: F.array_contains("told", F.lower(w.value)) | F.coalesce(F.array_contains("told", _shape(F.lower(w.value))), F.lit(False)))
    yes = yes.select("row", "d", "text", "base", "told", hit.alias("words"))
    added = F.transform("words", lambda w: F.struct(F.lit("term").alias("kind"), w.start.alias("start"), w.end.alias("end"), F.coalesce(F.array_contains("told", _shape(F.lower(w.value))), F.lit(False)).alias("removed")))
    free = F.filter(added, lambda a: ~F.exists("base", lambda b: (b.start < a.end) & (a.start < b.end)))
    columns = ["row", "d", "text", "base"]
    none = F.array().cast(ADDED).alias("added")
    plain = some.where(F.col("told").isNull()).select(*columns, none)
    return yes.select(*columns, free.cast(ADDED).alias("added")).unionAll(plain).unionAll(work.where(F.col("unit").isNull()).select(*columns, none))


def sanitise(docs: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """docs with its texts cleaned: base spans become tags, disclosing terms [TERM] or nothing."""
    found = find_pii(docs, text_col=text_col, **how)
    spans = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(b.end - a.end))
    found = found.select("d", "text", spans.alias("spans"))
    dirty = F.size("spans") > 0
    found = found.select("d", "text", "spans", F.transform("spans", lambda s: s.end).alias("before"), F.when(dirty, pieces("text")).alias("pieces"))
    found = running(found, ["before"], lambda a, b: F.greatest(a, b))  # where what is already replaced ends

    tag = lambda s: F.when(s.removed, "").otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv]), s.kind))
    out = F.array_join(F.zip_with("spans", "before", lambda s, at: F.when(s.start >= at, F.concat(cut("pieces", at, s.start), tag(s))).otherwise("")), "")
    end = F.array_max(F.transform("spans", lambda s: s.end))
    clean = F.when(dirty, F.concat(out, cut("pieces", end, F.length("text")))).otherwise(F.col("d")[text_col])
    return found.select(*[clean.alias(c) if c == text_col else F.col("d")[c].alias(c) for c in docs.columns])


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _count(kind: str):
    return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base spans and those of disclosing terms."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("d")["doc_id"].alias("doc_id"), *[_count(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_term"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
