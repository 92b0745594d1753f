"""Queries over settings, records, texts, files and control messages: the small operators around the simulations and dialogues."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import adapters as A
from ..sources import settings
from ..sources.shared import shared

DI, MO = A.SQL["discussion"], A.SQL["models"]
#: The agents in the order in which they speak.
AGENTS = ("theorist", "critic", "empiricist", "synthesizer")


def config_resolved(spark, sf):
    """A setting per nation: from the command line unless it is unset (null, or the default 500), else from the file, else the default."""
    n = A.table(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, 500).when(F.col("n_nationkey") % 3 == 1, F.col("n_nationkey") * 10).alias("cli"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") + 100).alias("file"))
    return n.select("n_nationkey", F.coalesce(F.nullif("cli", F.lit(500)), "file", F.lit(500)).cast("bigint").alias("n_boids"))


def settings_files(spark, sf):
    """A settings file per nation, each with a few of the settings, written and read; the rest have their defaults."""
    path = shared(spark, "settings")
    k = F.col("n_nationkey").cast("string")
    lines = F.array_compact(F.array(F.lit("# of one nation"), F.lit("boids:"), F.concat(F.lit("  n_boids: "), k, F.lit("0")), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("  noise_std: 0."), k, F.lit("5  # measured"))), F.when(F.col("n_nationkey") % 5 == 0, F.lit("  boundary: 'reflective'")), F.lit("sweep:"), F.lit("  n_runs: 3")))
    n = A.table(spark, sf, "nation").select("n_nationkey", F.array_join(lines, "\n").alias("value"))
    n.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    r = settings.resolved(settings.read_settings(spark, path), "boids")
    return r.select(F.regexp_extract("file", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), "n_boids", "world_size", "boundary", "noise_std")


def model_records(spark, sf):
    return A.models(spark, sf).select("id", F.to_json(F.struct("id", "provider", "name")).alias("record"))


def parsed_costs(spark, sf):
    """Prices that come as text: empty, missing and malformed ones are 0."""
    text = F.when(F.col("p_partkey") % 7 == 0, "").when(F.col("p_partkey") % 11 == 0, "n/a").when(F.col("p_partkey") % 13 != 0, F.col("p_size").cast("string"))
    return A.table(spark, sf, "part").groupBy("p_brand").agg(F.sum(F.coalesce(text.try_cast("double"), F.lit(0.0))).alias("cost"))


def round_filter(spark, sf):
    """Entries of the second round, by agent."""
    return A.discussion(spark, sf).where("round = 1").groupBy("agent").agg(F.count("*").alias("n"))


def padded_lines(spark, sf):
    """Agent names in capitals, padded to twelve, before their trimmed entry."""
    return A.discussion(spark, sf).select("conv", "round", F.md5(F.concat(F.rpad(F.upper("agent"), 12, " "), F.trim("content"))).alias("line"))


def mini_markdown(spark, sf):
    """Escaped text with headings, bold and code as HTML."""
    t = F.col("content")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    for pattern, new in ((r"(?m)^### (.+)$", "<h3>$1</h3>"), (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"`([^`]+)`", "<code>$1</code>")):
        t = F.regexp_replace(t, pattern, new)
    d = A.discussion(spark, sf).withColumn("content", F.concat(F.lit("### "), F.col("agent"), F.lit("\n**"), "agent", F.lit("** `"), F.col("round").cast("string"), F.lit("` "), "content"))
    return d.select("conv", "round", F.md5(t).alias("html"))


def dropdown_labels(spark, sf):
    """Names without a leading vendor, with the cost per million."""
    m = A.models(spark, sf).withColumn("name", F.concat("provider", F.lit(": "), "name")).withColumn("cost", F.when(F.col("cost") < 0.01, 0.0).otherwise(F.round("cost", 4)))
    return m.select("id", F.concat(F.regexp_replace("name", r"^[^:]+:\s*", ""), F.when(F.col("cost") == 0, " (Free)").otherwise(F.format_string(" ($%.2f/M)", F.col("cost") * 100))).alias("label"))


def event_times(spark, sf):
    """Event times as ISO text, milliseconds and a version name, and the seconds since the agent's first."""
    t = F.col("ts").cast("timestamp_ntz")
    e = A.table(spark, sf, "events")
    return e.select("event_id", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("iso"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.date_format(t, "yyyyMMdd_HHmmss").alias("version"), F.expr("timestampdiff(SECOND, min(ts) OVER (PARTITION BY user_id), ts)").alias("elapsed"))


def vector_arrays(spark, sf):
    """Arrays cut, joined, reshaped to pairs and reduced, over all their numbers."""
    e = A.table(spark, sf, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 2).cast("int") - 1), lambda k: F.slice("v", k * 2 + 1, F.lit(2)))
    mean = lambda a, n: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / n
    return e.select("vec_id", F.array_position("v", F.array_max("v")).alias("argmax"), F.round(mean(F.flatten(pairs), F.size("v")), 6).alias("mean"), F.size(F.concat("v", F.slice("v", 1, 4))).cast("bigint").alias("size"), F.round(F.aggregate(F.transform(pairs, lambda p: p[0] * p[1]), F.lit(0.0), lambda x, y: x + y), 6).alias("products"))


def props_roundtrip(spark, sf):
    """A field out of JSON, doubled, and back into JSON."""
    e = A.table(spark, sf, "events").select("event_id", F.from_json("props", "k BIGINT").alias("p"))
    return e.select("event_id", F.to_json(F.struct((F.col("p.k") * 2).alias("k2"), "event_id")).alias("json"))


def token_counts(spark, sf):
    """A first count or, where it is 0 or missing, a second one."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return A.table(spark, sf, "events").select("event_id", F.coalesce(F.nullif(k % 5, F.lit(0).cast("bigint")), k).alias("tokens"))


def telemetry_totals(spark, sf):
    """Records, agents, ticks and seconds covered."""
    return A.ticks(spark, sf).agg(F.count("*").alias("records"), F.count_distinct("agent").alias("agents"), F.max("tick").alias("ticks"), F.expr("timestampdiff(SECOND, min(ts), max(ts))").alias("uptime"))


def control_config(spark, sf):
    """Each session's settings after all its control messages: the last of each field, and how often topology and agents were rebuilt
    (a new number of agents rebuilds both)."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    m = A.table(spark, sf, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("alpha"), F.when(F.col("event_type") == "view", k % 4).alias("topology"), F.when(F.col("event_type") == "purchase", k % 50 + 2).alias("n_agents"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    was = lambda c, d: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(d))
    m = m.withColumn("topo", F.coalesce(F.col("topology") != was("topology", 0), F.lit(False))).withColumn("agents", F.coalesce(F.col("n_agents") != was("n_agents", 10), F.lit(False)))
    last = lambda c, d: F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "event_id"))), F.lit(d)).alias(c)
    return m.groupBy("user_id").agg(last("alpha", 0.5), last("topology", 0), last("n_agents", 10), F.count(F.when(F.col("topo") | F.col("agents"), 1)).alias("topology_rebuilds"), F.count(F.when(F.col("agents"), 1)).alias("agent_rebuilds"))


def history_trimmed(spark, sf):
    """Each conversation's history is cut to its last twenty messages: how many, and the round of the oldest."""
    w = Window.partitionBy("conv").orderBy(F.desc("round"), F.desc("agent"), F.desc("content"))
    return A.discussion(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 20").groupBy("conv").agg(F.count("*").alias("n"), F.min("round").alias("oldest"))


def next_step(spark, sf):
    """Who speaks next, in which round, and the counters after that: four agents in turn, the round rises with the first."""
    d = A.discussion(spark, sf).groupBy("conv").agg(F.count("*").alias("n"))
    index, done = F.col("n") % 4, F.floor(F.col("n") / 4)
    after = F.pmod(index + 1, F.lit(4))
    return d.select("conv", F.element_at(F.array(*[F.lit(a) for a in AGENTS]), (index + 1).cast("int")).alias("agent"), (done + 1).alias("round"), after.alias("next_index"), F.when(after == 0, done + 1).otherwise(done).alias("current_round"))


def reset_sessions(spark, sf):
    """Every agent that spoke, with an empty history, and the seed document."""
    return A.discussion(spark, sf).select("agent").distinct().select("agent", F.lit(0).cast("bigint").alias("messages"), F.lit(0).cast("bigint").alias("last_round"), F.lit("# State Document v1").alias("state"))


def agent_prompts(spark, sf):
    """What an agent is asked: a system line, its last five messages, and what came in now (the conversation's last entry)."""
    w = Window.partitionBy("conv").orderBy(F.desc("round"), F.desc("agent"), F.desc("content"))
    d = A.discussion(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 6")
    tag = F.when(F.col("k") == 1, "Received: ").when(F.col("agent") == "user", "Received: ").otherwise("You: ")
    g = d.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), F.concat(tag, F.col("content")).alias("line")))).alias("e"))
    return g.select("conv", F.md5(F.concat(F.lit("You are an agent.\n\n"), F.array_join(F.transform("e", lambda e: e.line), "\n"))).alias("prompt"))


def csv_roundtrip(spark, sf):
    """Suppliers written as CSV with a header and read again, quotes and commas whole."""
    path = shared(spark, "csv")
    A.write_csv(A.table(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit(', "'), F.col("s_nationkey").cast("string"), F.lit('"')).alias("s_name"), "s_acctbal"), path)
    return A.read_csv(spark, path, "s_suppkey BIGINT, s_name STRING, s_acctbal DOUBLE")


def json_roundtrip(spark, sf):
    """Nations nested in their regions, written as JSON and read again."""
    path = shared(spark, "json")
    n = A.table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("bigint").alias("region")).agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("name")))).alias("nations"))
    A.write_json(n.agg(F.sort_array(F.collect_list(F.struct("region", "nations"))).alias("regions")), path)  # a document of five regions
    back = A.read_json_document(spark, path, "regions ARRAY<STRUCT<region: BIGINT, nations: ARRAY<STRUCT<key: BIGINT, name: STRING>>>>")
    return back.select(F.explode("regions").alias("r")).select("r.region", F.explode("r.nations").alias("n")).select("region", "n.key", "n.name")


def text_roundtrip(spark, sf):
    """Prompts written as texts, a file each, and read whole."""
    path = shared(spark, "text")
    A.table(spark, sf, "region").select("r_regionkey", F.concat(F.lit("# "), "r_name", F.lit("\nsecond line")).alias("value")).repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    return A.read_text(spark, path).select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), F.length(F.rtrim(F.regexp_replace("value", r"\n+$", ""))).cast("bigint").alias("chars"))


def latest_version(spark, sf):
    """Two versions of an output; the later one is read."""
    path = shared(spark, f"runs-{uuid.uuid4().hex[:6]}")
    r = A.table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"))
    A.write_run(r.where("r_regionkey < 2"), path, "20260101_000000")
    A.write_run(r, path, "20260102_000000")
    return A.latest_run(spark, path).select("r_regionkey", F.col("run_id").cast("string").alias("version"))


QUERIES = {f.__name__: f for f in (config_resolved, settings_files, model_records, parsed_costs, round_filter, padded_lines, mini_markdown, dropdown_labels, event_times, vector_arrays, props_roundtrip, token_counts, telemetry_totals, control_config, history_trimmed, next_step, reset_sessions, agent_prompts, csv_roundtrip, json_roundtrip, text_roundtrip, latest_version)}
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_LAST = lambda c, d: f"coalesce(arg_max({c}, (ts, event_id)) FILTER ({c} IS NOT NULL), {d}) AS {c}"
_WAS = lambda c, d: f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {d})"
ORACLE = {
    "config_resolved": "WITH n AS (SELECT n_nationkey, CASE n_nationkey%3 WHEN 0 THEN 500 WHEN 1 THEN n_nationkey*10 END AS cli, CASE WHEN n_nationkey%2=0 THEN n_nationkey+100 END AS file FROM nation) SELECT n_nationkey, CAST(coalesce(nullif(cli,500), file, 500) AS BIGINT) AS n_boids FROM n",
    "settings_files": "SELECT n_nationkey, CAST(n_nationkey*10 AS BIGINT) AS n_boids, 100.0::DOUBLE AS world_size, CASE WHEN n_nationkey%5=0 THEN 'reflective' ELSE 'periodic' END AS boundary, CASE WHEN n_nationkey%2=0 THEN CAST('0.'||n_nationkey||'5' AS DOUBLE) ELSE 0.1::DOUBLE END AS noise_std FROM nation",
    "model_records": f"WITH {MO} SELECT id, CAST(json_object('id',id,'provider',provider,'name',name) AS VARCHAR) AS record FROM models",
    "parsed_costs": "SELECT p_brand, sum(coalesce(TRY_CAST(CASE WHEN p_partkey%7=0 THEN '' WHEN p_partkey%11=0 THEN 'n/a' WHEN p_partkey%13<>0 THEN CAST(p_size AS VARCHAR) END AS DOUBLE),0.0)) AS cost FROM part GROUP BY p_brand",
    "round_filter": f"WITH {DI} SELECT agent, count(*) AS n FROM discussion WHERE round=1 GROUP BY agent",
    "padded_lines": f"WITH {DI} SELECT conv, round, md5(rpad(upper(agent),12,' ')||trim(content,' ')) AS line FROM discussion",
    "mini_markdown": f"""WITH {DI}, e AS (SELECT conv, round, replace(replace(replace('### '||agent||chr(10)||'**'||agent||'** `'||round||'` '||content,'&','&amp;'),'<','&lt;'),'>','&gt;') AS t FROM discussion)
 SELECT conv, round, md5(regexp_replace(regexp_replace(regexp_replace(t,'(?m)^### (.+)$','<h3>\\1</h3>','g'),'\\*\\*(.+?)\\*\\*','<strong>\\1</strong>','g'),'`([^`]+)`','<code>\\1</code>','g')) AS html FROM e""",
    "dropdown_labels": f"WITH {MO}, c AS (SELECT id, provider||': '||name AS name, CASE WHEN cost<0.01 THEN 0.0 ELSE round(cost,4) END AS cost FROM models) SELECT id, regexp_replace(name,'^[^:]+:\\s*','')||CASE WHEN cost=0 THEN ' (Free)' ELSE printf(' ($%.2f/M)',cost*100) END AS label FROM c",
    "event_times": "SELECT event_id, strftime(ts,'%Y-%m-%dT%H:%M:%S.%g') AS iso, epoch_us(ts)//1000 AS ms, strftime(ts,'%Y%m%d_%H%M%S') AS version, CAST(floor((epoch_us(ts)-epoch_us(min(ts) OVER (PARTITION BY user_id)))/1000000) AS BIGINT) AS elapsed FROM events",
    "vector_arrays": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, CAST(list_position(v, list_max(v)) AS BIGINT) AS argmax, round(list_sum(v)/len(v),6) AS mean, len(list_concat(v, v[1:4])) AS size, round(list_sum(list_transform(range(1,len(v),2), lambda i: v[i]*v[i+1])),6) AS products FROM v",
    "props_roundtrip": f"SELECT event_id, '{{\"k2\":'||{_K}*2||',\"event_id\":'||event_id||'}}' AS json FROM events",
    "token_counts": f"SELECT event_id, coalesce(nullif({_K}%5,0), {_K}) AS tokens FROM events",
    "telemetry_totals": f"WITH {A.SQL['ticks']} SELECT count(*) AS records, count(DISTINCT agent) AS agents, max(tick) AS ticks, CAST(floor((epoch_us(max(ts))-epoch_us(min(ts)))/1000000) AS BIGINT) AS uptime FROM ticks",
    "control_config": f"""WITH m AS (SELECT user_id, ts, event_id, CASE WHEN event_type='click' THEN value END AS alpha, CASE WHEN event_type='view' THEN {_K}%4 END AS topology, CASE WHEN event_type='purchase' THEN {_K}%50+2 END AS n_agents FROM events),
 c AS (SELECT *, coalesce(topology<>{_WAS("topology", 0)}, false) AS topo, coalesce(n_agents<>{_WAS("n_agents", 10)}, false) AS agents FROM m)
 SELECT user_id, {_LAST("alpha", 0.5)}, {_LAST("topology", 0)}, {_LAST("n_agents", 10)}, count(*) FILTER (topo OR agents) AS topology_rebuilds, count(*) FILTER (agents) AS agent_rebuilds FROM c GROUP BY user_id""",
    "history_trimmed": f"WITH {DI}, k AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY round DESC, agent DESC, content DESC) AS k FROM discussion) SELECT conv, count(*) AS n, min(round) AS oldest FROM k WHERE k<=20 GROUP BY conv",
    "next_step": f"WITH {DI}, d AS (SELECT conv, count(*) AS n FROM discussion GROUP BY conv) SELECT conv, {list(AGENTS)}[n%4+1] AS agent, n//4+1 AS round, (n+1)%4 AS next_index, CASE WHEN (n+1)%4=0 THEN n//4+1 ELSE n//4 END AS current_round FROM d",
    "reset_sessions": f"WITH {DI} SELECT DISTINCT agent, 0::BIGINT AS messages, 0::BIGINT AS last_round, '# State Document v1' AS state FROM discussion",
    "agent_prompts": f"WITH {DI}, k AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY round DESC, agent DESC, content DESC) AS k FROM discussion) SELECT conv, md5('You are an agent.'||chr(10)||chr(10)||string_agg(CASE WHEN k=1 OR agent='user' THEN 'Received: ' ELSE 'You: ' END||content, chr(10) ORDER BY k DESC)) AS prompt FROM k WHERE k<=6 GROUP BY conv",
    "csv_roundtrip": "SELECT s_suppkey, s_name||', \"'||s_nationkey||'\"' AS s_name, s_acctbal FROM supplier",
    "json_roundtrip": "SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation",
    "text_roundtrip": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, length('# '||r_name||chr(10)||'second line') AS chars FROM region",
    "latest_version": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, '20260102_000000' AS version FROM region",
}
