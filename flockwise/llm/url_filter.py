"""URL filters: prefix rules, then an empirical-Bayes reputation of hosts. DataFrame functions only.

Labelled page outcomes (1 bad, 0 good) are shrunk through beta-binomial priors: the whole table is the prior of a public suffix, a
suffix of its registered domains, a registered domain of its hosts. The strength of each prior comes from the data (method of
moments on the children's rates). A page without a rule is blocked if its host is credibly worse than hosts are: if the lower
posterior bound of the host's bad rate exceeds the upper bound of a host's rate before any of its own pages are seen.

A public suffix is the last label, or the last two under a country code whose second label is a general one (SECOND); the registered
domain has one label more. An address in digits is its own domain.

Every host is a row of one written table; the levels above are aggregated from it, and only a row of sums a level reaches the driver.

Defined results: a null url, or one without ://, has host and path "", fits no rule and is judged by the host "". Labels of unknown
pages and null labels are ignored, repeated ones each count; repeated pages are rows each, and each of them counts with its labels.
A host without labels has its domain's posterior mean. Empty tables give no rows. Other columns of the inputs are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

#: (action, host, path): a rule fits its host and all subdomains where the path starts with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: General second-level labels under country codes, fixed.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "or", "org")
#: Bounds of a prior's strength, in pages.
FLOOR, CAP = 2.0, 200.0


def url_parts(url) -> tuple:
    """Host and path of a url column."""
    after = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")), F.lit(""))
    host = ascii_lower(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def host_levels(host) -> tuple:
    """Public suffix and registered domain of a host column."""
    last = F.substring_index(host, ".", -1)
    country = (F.length(last) == 2) & F.substring_index(F.substring_index(host, ".", -2), ".", 1).isin(*SECOND)
    digits = host.rlike(r"^[0-9.]+$")
    suffix = F.when(digits, "").when(country, F.substring_index(host, ".", -2)).otherwise(last)
    return suffix, F.when(digits, host).when(country, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def fitting_rule(host, path, rules=RULES):
    """(action, name) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<action:string,name:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last one wins
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("name"))).otherwise(out)
    return out


def _strength(children: DataFrame, up) -> float:
    """children(n, bad): the prior's strength by moments, from their variance about `up` beyond binomial noise."""
    n, rate = F.col("n"), F.col("bad") / F.col("n")
    r = children.where("n >= 2").agg(F.count("*").alias("k"), F.avg((rate - up) ** 2).alias("v"), F.avg(up * (1 - up) / n).alias("noise"), F.avg(up * (1 - up)).alias("pq")).first()  # one row
    if r["k"] < 2 or r["v"] <= r["noise"]:
        return CAP
    return min(max(r["pq"] / (r["v"] - r["noise"]) - 1, FLOOR), CAP)


def host_reputation(outcomes: DataFrame) -> tuple[DataFrame, float, float]:
    """outcomes(host, bad) -> (host, n, alpha, beta): each host's posterior of its bad rate; the mean of all, and the strength of a
    prior that knows nothing but that mean. A host's rows may all have a null outcome."""
    suffix, domain = host_levels(F.col("host"))
    counts = [F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")]
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialize(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"))
    domains = materialize(hosts.groupBy("domain", "suffix").agg(*counts))
    suffixes = materialize(domains.groupBy("suffix").agg(*counts))
    whole = suffixes.agg(*counts).first()  # one row
    m = (whole["bad"] + 1) / (whole["n"] + 2)
    prior = _strength(hosts, F.lit(m))

    def shrunk(children, s):
        return children.withColumn("up", (F.col("bad") + s * F.col("up")) / (F.col("n") + s)).drop("n", "bad")

    suffixes = shrunk(suffixes.withColumn("up", F.lit(m)), _strength(suffixes, F.lit(m)))
    domains = materialize(domains.join(suffixes, "suffix"))
    domains = shrunk(domains, _strength(domains, F.col("up"))).drop("suffix")
    hosts = materialize(hosts.join(domains, "domain"))
    s = _strength(hosts, F.col("up"))
    return hosts.select("host", "n", (F.col("bad") + s * F.col("up")).alias("alpha"), (F.col("n") - F.col("bad") + s * (1 - F.col("up"))).alias("beta")), m, prior


def judge_urls(pages: DataFrame, outcomes: DataFrame, *, rules=RULES, z: float = 1.645) -> DataFrame:
    """pages(page_id, url), outcomes(page_id, bad) -> page_id, host, path, rule, verdict, bad_rate, bad_rate_low, threshold, labelled.

    bad_rate_low is the posterior mean less z posterior standard deviations, `threshold` the prior's mean plus z of its own.
    """
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.select(F.col("page_id").alias("of"), F.col("bad").cast("long").alias("bad"))
    rep, m, prior = host_reputation(urls.join(known, urls.page_id == known.of, "left").select("host", "bad"))
    threshold = m + z * math.sqrt(m * (1 - m) / (prior + 1))
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    sd = F.sqrt(mean * (1 - mean) / (F.col("alpha") + F.col("beta") + 1))
    own = rep.select("host", F.col("n").alias("labelled"), F.round(mean, 6).alias("bad_rate"), F.round(F.greatest(mean - z * sd, F.lit(0.0)), 6).alias("bad_rate_low"))
    out = urls.join(own, "host").withColumn("hit", fitting_rule(F.col("host"), F.col("path"), rules))
    return out.select(
        "page_id", "host", "path", F.col("hit.name").alias("rule"),
        F.coalesce(F.col("hit.action"), F.when(F.col("bad_rate_low") > threshold, "block").otherwise("allow")).alias("verdict"),
        "bad_rate", "bad_rate_low", F.round(F.lit(threshold), 6).alias("threshold"), "labelled",
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; outcomes are the quality labels (0: bad) of the same number."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes)


def _strength_sql(name: str, children: str, up: str) -> str:
    return f"""{name} AS (SELECT CASE WHEN k < 2 OR v <= noise THEN 200.0 ELSE least(greatest(pq / (v - noise) - 1, 2.0), 200.0) END AS s FROM (
  SELECT count(*) AS k, avg((bad/n - {up}) ** 2) AS v, avg({up} * (1 - {up}) / n) AS noise, avg({up} * (1 - {up})) AS pq FROM {children} WHERE n >= 2))"""


ORACLE_OP5 = f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
l AS (SELECT host, string_split(host, '.') AS p, CAST(count(quality) AS DOUBLE) AS n, CAST(coalesce(sum(1 - quality), 0) AS DOUBLE) AS bad
  FROM u LEFT JOIN labels ON page_id = doc_id GROUP BY host),
v AS (SELECT *, regexp_full_match(host, '[0-9.]+') AS digits, length(p[-1]) = 2 AND coalesce(p[-2], p[-1]) IN {SECOND} AS country FROM l),
h AS (SELECT host, n, bad, CASE WHEN digits THEN host ELSE array_to_string(p[(CASE WHEN country THEN -3 ELSE -2 END):], '.') END AS domain,
  CASE WHEN digits THEN '' ELSE array_to_string(p[(CASE WHEN country THEN -2 ELSE -1 END):], '.') END AS suffix FROM v),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
x AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
m AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS m FROM x),
{_strength_sql("s0", "h, m", "m")},
{_strength_sql("s1", "x, m", "m")},
x2 AS (SELECT suffix, (bad + s * m) / (n + s) AS up FROM x, m, s1),
d1 AS (SELECT d.*, up FROM d JOIN x2 USING (suffix)),
{_strength_sql("s2", "d1", "up")},
d2 AS (SELECT domain, (bad + s * up) / (n + s) AS up FROM d1, s2),
h1 AS (SELECT h.*, up FROM h JOIN d2 USING (domain)),
{_strength_sql("s3", "h1", "up")},
post AS (SELECT host, n, (bad + s * up) / (n + s) AS mean, n + s AS size FROM h1, s3),
own AS (SELECT host, CAST(n AS BIGINT) AS labelled, round(mean, 6) AS bad_rate,
  round(greatest(mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)), 0), 6) AS bad_rate_low FROM post),
t AS (SELECT m + 1.645 * sqrt(m * (1 - m) / (s + 1)) AS threshold FROM m, s0),
r AS (SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN bad_rate_low > threshold THEN 'block' ELSE 'allow' END AS verdict, bad_rate, bad_rate_low, round(threshold, 6) AS threshold, labelled
FROM r JOIN own USING (host), t
"""
