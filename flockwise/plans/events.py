"""Queries over state sequences, agent ticks, topologies, dialogues and model catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import topology
from ..operators import info, ordered, select, series
from ..sources import adapters as A
from .frames import mi_sql
from .sweeps import G

R6 = lambda c: F.round(c, 6)
ST, TK, DI, MO = (A.SQL[k] for k in ("states", "ticks", "discussion", "models"))


def one(df: DataFrame, name: str = "run") -> DataFrame:
    return df.withColumn(name, F.lit(1))


def state_histogram(spark, sf):
    return A.states(spark, sf).groupBy("state").agg(F.count("*").alias("n"))


def macro_state_distinct(spark, sf):
    return A.states(spark, sf).groupBy("entity").agg(F.count_distinct("state").alias("states"), F.count("*").alias("rows"))


def entropy(spark, sf):
    return info.entropy(A.states(spark, sf), ["entity"], ["state"]).select("entity", R6("entropy").alias("entropy"))


def all_pairs(spark, sf) -> DataFrame:
    return one(info.pairs(A.states(spark, sf), ["entity"], "seq", "state"))


def conditional_entropy(spark, sf):
    """H(next, now) - H(now)."""
    p = all_pairs(spark, sf)
    j = info.entropy(p, ["run"], ["s", "t"], "joint").join(info.entropy(p, ["run"], ["s"], "own"), "run")
    return j.select("run", R6(F.col("joint") - F.col("own")).alias("conditional"))


def mutual_information(spark, sf):
    return info.mutual_information(all_pairs(spark, sf), ["run"]).select("run", R6("mi").alias("mi"))


def predictability(spark, sf):
    """H(next) - H(next given now)."""
    p = all_pairs(spark, sf)
    h = info.entropy(p, ["run"], ["t"], "ht").join(info.entropy(p, ["run"], ["s", "t"], "hst"), "run").join(info.entropy(p, ["run"], ["s"], "hs"), "run")
    return h.select("run", R6(F.col("ht") - F.col("hst") + F.col("hs")).alias("predictability"))


def quantile_edges(spark, sf) -> DataFrame:
    """Edges of eight bins of each state's values: a state may hold any share of all rows, so they are selected, not buffered."""
    s = A.states(spark, sf)
    edges = select.quantiles(s, ["state"], "value", [k / 8 for k in range(1, 8)], "edges")
    return edges.join(s.groupBy("state").agg(F.stddev_pop("value").alias("sd")), "state")


def binned(spark, sf) -> DataFrame:
    s = A.states(spark, sf).join(F.broadcast(quantile_edges(spark, sf)), "state")  # a row a state of five
    return s.select("state", "entity", "seq", F.when(F.col("sd") < 1e-10, 0).otherwise(S.digitize(F.col("value"), F.col("edges"))).alias("bin"))


def quantile_bins(spark, sf):
    return binned(spark, sf).groupBy("state", "bin").agg(F.count("*").alias("n"))


EDG = f"{ST}, q AS (SELECT state, quantile_cont(value, [{','.join(str(k / 8) for k in range(1, 8))}]) AS edges, stddev_pop(value) AS sd FROM states GROUP BY state), b AS (SELECT s.state, entity, seq, CASE WHEN sd<1e-10 THEN 0 ELSE CAST(len(list_filter(edges, lambda e: s.value>=e)) AS INT) END AS bin FROM states s JOIN q USING (state))"


def transfer_entropy(spark, sf):
    """From a row's binned value to the next row's state: H(next, now) - H(now) - H(next, now, bin) + H(now, bin), at least 0."""
    w = Window.partitionBy("entity").orderBy("seq")
    p = binned(spark, sf).select(F.col("state").alias("s"), F.lead("state").over(w).alias("t"), "bin").where(F.col("t").isNotNull())
    p = one(p)
    h = [info.entropy(p, ["run"], c, n) for c, n in ((["s", "t"], "a"), (["s"], "b"), (["s", "t", "bin"], "c"), (["s", "bin"], "d"))]
    j = h[0].join(h[1], "run").join(h[2], "run").join(h[3], "run")
    return j.select("run", R6(F.greatest(F.lit(0.0), F.col("a") - F.col("b") - F.col("c") + F.col("d"))).alias("te"))


def _h(rows: str, states: str) -> str:
    return f"(SELECT -sum(p*log2(p+1e-10)) FROM (SELECT count(*)/sum(count(*)) OVER () AS p FROM {rows} GROUP BY {states}))"


PR = f"{ST}, q AS (SELECT 1 AS run, state AS s, lead(state) OVER (PARTITION BY entity ORDER BY seq) AS t FROM states), j0 AS (FROM q WHERE t IS NOT NULL)"


def mi_hopping_windows(spark, sf):
    """Mean MI of windows of 10 rows, 5 apart, over each entity's sequence of pairs."""
    p = info.pairs(A.states(spark, sf), ["entity"], "seq", "state")
    w = info.mutual_information(info.hopping_windows(p, ["entity"], "seq", 10, 5), ["entity", "w"])
    return w.groupBy("entity").agg(F.round(F.avg("mi"), 4).alias("mi"), F.count("*").alias("windows"))


HOP = f"""WITH {ST}, q AS (SELECT entity, seq, state AS s, lead(state) OVER (PARTITION BY entity ORDER BY seq) AS t FROM states),
 z AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq)-1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM q WHERE t IS NOT NULL),
 x AS (SELECT entity, w, s, t FROM z, range((SELECT max(n) FROM z)) r(w) WHERE w*5<=i AND i<w*5+10 AND w*5<n-11),
 h AS ({"WITH " + mi_sql("x", "entity, w")}) SELECT entity, round(avg(mi),4) AS mi, count(*) AS windows FROM h GROUP BY entity"""


def digitize_bins(spark, sf):
    top = A.table(spark, sf, "events").agg(F.max("value").alias("top"))  # one row
    e = A.table(spark, sf, "events").crossJoin(F.broadcast(top)).where(F.col("value").isNotNull())
    edges = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: k / 10)
    return e.select(S.digitize(F.col("value") / F.col("top"), edges).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


#: Suppliers that make a network of agents.
N = 12


def agents(spark, sf) -> DataFrame:
    """net, i, n: every N suppliers are a network; i counts its agents from 0."""
    s = A.table(spark, sf, "supplier").select(F.floor(F.col("s_suppkey") / N).alias("net"), "s_suppkey")
    w = Window.partitionBy("net")
    return s.select("net", (F.row_number().over(w.orderBy("s_suppkey")) - 1).cast("bigint").alias("i"), F.count("*").over(w).alias("n"))


def edges_of(nets: DataFrame, name: str) -> DataFrame:
    """nets(net, i, n) -> net, src, dst of a topology, both ways."""
    ids = nets.where("n > 1").withColumnRenamed("i", "src")
    if name == "ring":
        return ids.select("net", "src", F.explode(F.array(F.pmod(F.col("src") - 1, "n"), F.pmod(F.col("src") + 1, "n"))).alias("dst"))
    zero = F.lit(0).cast("bigint")
    if name == "star":
        spokes = ids.where("src > 0")
        return spokes.select("net", "src", zero.alias("dst")).union(spokes.select("net", zero.alias("src"), F.col("src").alias("dst")))
    others = ids.select("net", "src", F.explode(F.sequence(zero, F.col("n") - 1)).alias("dst")).where("src <> dst")
    if name == "mesh":
        return others
    # random: a coin for each pair; who is left alone is tied to the next one
    some = others.where(S.uniform(F.lit("3"), "net", F.least("src", "dst"), F.greatest("src", "dst")) < 0.5)
    alone = ids.join(some.select("net", "src").distinct(), ["net", "src"], "left_anti").select("net", "src", F.pmod(F.col("src") + 1, "n").alias("dst"))
    return some.union(alone).union(alone.select("net", F.col("dst"), F.col("src"))).distinct()


def topology_ring(spark, sf):
    return edges_of(agents(spark, sf), "ring")


def topology_mesh(spark, sf):
    return edges_of(agents(spark, sf), "mesh")


def topology_star(spark, sf):
    return edges_of(agents(spark, sf), "star")


def topology_random(spark, sf):
    return edges_of(agents(spark, sf), "random")


#: The topologies by name.
TOPOLOGIES = ("ring", "mesh", "star", "random")


def topology_lateral(spark, sf):
    """Each agent's neighbours by the table function, in a lateral join; networks take the four topologies in turn."""
    topology.register(spark)
    a = agents(spark, sf).withColumn("topology", F.element_at(F.array(*map(F.lit, TOPOLOGIES)), (F.col("net") % 4 + 1).cast("int")))
    return spark.sql("SELECT net, i AS src, dst FROM {a} a, LATERAL neighbors(a.topology, a.net, a.i, a.n)", a=a)


AG = f"ag AS (SELECT net, row_number() OVER (PARTITION BY net ORDER BY s_suppkey)-1 AS i, count(*) OVER (PARTITION BY net) AS n FROM (SELECT s_suppkey//{N} AS net, s_suppkey FROM supplier))"
EDGE_SQL = {
    "ring": "SELECT net, i AS src, (i+d+n)%n AS dst FROM ag, (VALUES (-1),(1)) y(d) WHERE n>1",
    "mesh": "SELECT a.net, a.i AS src, b.i AS dst FROM ag a JOIN ag b ON a.net=b.net AND a.i<>b.i",
    "star": "SELECT net, i AS src, 0::BIGINT AS dst FROM ag WHERE i>0 UNION ALL SELECT net, 0::BIGINT, i FROM ag WHERE i>0",
    "random": "SELECT net, src, dst FROM rs UNION SELECT net, src, dst FROM rl UNION SELECT net, dst, src FROM rl",
}
RND = f"""WITH {AG}, ro AS (SELECT a.net, a.i AS src, b.i AS dst FROM ag a JOIN ag b ON a.net=b.net AND a.i<>b.i), rs AS (SELECT * FROM ro WHERE ('0x'||substr(md5('3|'||net||'|'||least(src,dst)||'|'||greatest(src,dst)),1,8))::BIGINT/4294967296.0<0.5),
 rl AS (SELECT net, i AS src, (i+1)%n AS dst FROM ag WHERE n>1 AND (net, i) NOT IN (SELECT (net, src) FROM rs))"""


def partner_choice(spark, sf):
    """On rings, ten ticks, alpha .7: the agent itself if its draw is above alpha, else the neighbour that a second draw points to."""
    near = edges_of(agents(spark, sf), "ring").groupBy("net", "src").agg(F.sort_array(F.collect_list("dst")).alias("near"))  # two
    t = near.select("net", "src", "near", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("tick"))
    pick = F.floor(S.uniform(F.lit("5"), "net", "tick", "src", F.lit("pick")) * F.size("near")).cast("int")
    return t.select("net", F.col("src").alias("agent"), "tick", F.when(S.uniform(F.lit("5"), "net", "tick", "src", F.lit("go")) > 0.7, F.col("src")).otherwise(F.get("near", pick)).alias("partner"))


_H = lambda k: f"(('0x'||substr(md5('5|'||net||'|'||tick||'|'||agent||'|{k}'),1,8))::BIGINT/4294967296.0)"


def asof_partner_output(spark, sf):
    """The latest latency that the partner (the next agent, the first after the last) had shown before: one union, in which the
    last value is carried along, so that a much asked partner isn't one task."""
    t = A.ticks(spark, sf)
    n = t.agg((F.max("agent") + 1).alias("n"))  # one row
    asks = t.crossJoin(F.broadcast(n)).select(F.col("event_id"), ((F.col("agent") + 1) % F.col("n")).alias("of"), "ts", F.lit(None).cast("double").alias("seen"), F.lit(1).alias("asks"))
    shows = t.select("event_id", F.col("agent").alias("of"), "ts", F.col("latency_ms").alias("seen"), F.lit(0).alias("asks"))
    both = ordered.carried_last(asks.unionByName(shows), ["of"], ["ts", "asks", "event_id"], "seen", "partner_latency")
    return both.where("asks = 1").select("event_id", F.col("of").alias("partner"), "partner_latency")


ASOF = f"WITH {TK}, a AS (SELECT event_id, (agent+1)%(SELECT max(agent)+1 FROM ticks) AS partner, ts FROM ticks), s AS (SELECT agent, ts, arg_max(latency_ms, event_id) AS latency FROM ticks WHERE latency_ms IS NOT NULL GROUP BY agent, ts) SELECT a.event_id, a.partner, s.latency AS partner_latency FROM a ASOF LEFT JOIN s ON a.partner=s.agent AND a.ts>=s.ts"


def event_series(spark, sf):
    """All events as one long series: the next event's type, the mean of three values, and the slope of the values over time."""
    e = A.table(spark, sf, "events").select("event_id", "ts", "event_type", F.col("value").alias("y"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("x"))

    def columns(w):
        return {"next_type": F.lead("event_type").over(w), "rolling": series.rolling_mean("y", w), "slope": series.gradient("y", "x", w)}

    s = ordered.windowed(e, [], ["ts", "event_id"], 1, columns)
    return s.select("event_id", "next_type", S.rounded(F.col("rolling"), 6).alias("rolling"), S.rounded(F.col("slope"), 4).alias("slope"))


def agent_history(spark, sf):
    """The last five ticks of every agent, oldest first."""
    w = Window.partitionBy("agent").orderBy(F.desc("tick"))
    t = A.ticks(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 5")
    return t.groupBy("agent").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tick", "event_id"))), lambda s: s.event_id.cast("string")), ",").alias("last"))


def telemetry_by_tick(spark, sf):
    return A.ticks(spark, sf).groupBy("tick").agg(F.count("*").alias("agents"), R6(F.avg("latency_ms")).alias("latency"), F.sum("tokens").alias("tokens"))


def replay_last_n(spark, sf):
    return A.ticks(spark, sf).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "agent", "tick")


def dialogue_last_k(spark, sf):
    """The last four entries of each conversation."""
    w = Window.partitionBy("conv").orderBy(F.desc("round"))
    return A.discussion(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 4").select("conv", "round", "agent", F.length("content").cast("bigint").alias("chars"))


def dialogue_by_round(spark, sf):
    """The records of each conversation's rounds of two entries: who, and the start of what."""
    d = A.discussion(spark, sf).withColumn("preview", F.concat(F.substring("content", 1, 200), F.lit("...")))
    g = d.groupBy("conv", F.floor(F.col("round") / 2).alias("round2")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("round", "agent", "preview"))).alias("r"))
    return g.select("conv", F.col("round2").alias("round"), "n", F.md5(F.array_join(F.transform("r", lambda r: F.concat_ws("|", r.round.cast("string"), r.agent, r.preview)), "\n")).alias("records"))


def dialogue_context(spark, sf):
    """What the next speaker is shown: the round, the state, the last four entries, and for every fourth conversation (a synthesizer
    speaks) the last round's entries once more; then the limit."""
    w = Window.partitionBy("conv").orderBy(F.desc("round"))
    d = A.discussion(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 4").withColumn("last", F.max("round").over(Window.partitionBy("conv")))
    g = d.groupBy("conv", "last").agg(F.sort_array(F.collect_list(F.struct("round", "agent", "content"))).alias("e"))
    entry = lambda e: F.concat(F.lit("### "), F.upper(e.agent), F.lit(" (Round "), e.round.cast("string"), F.lit(")\n"), e.content, F.lit("\n\n"))
    again = F.concat(F.lit("## This Round's Outputs (for synthesis)\n"), F.array_join(F.transform(F.filter("e", lambda e: e.round == F.col("last")), lambda e: F.concat(F.lit("### "), F.upper(e.agent), F.lit("\n"), e.content, F.lit("\n\n"))), ""))
    text = F.concat(F.lit("# Current Round: "), F.col("last").cast("string"), F.lit("\n\n## Current State Document\n# State Document v1\n\n## Recent Discussion\n"), F.array_join(F.transform("e", entry), ""), F.when(F.col("conv") % 4 == 3, again).otherwise(""), F.lit("Stay under 500 words."))
    return g.select("conv", F.md5(text).alias("context"))


def round_headers(spark, sf):
    """Where a round (of two entries) begins that is later than the one before."""
    w = Window.partitionBy("conv").orderBy("round")
    d = A.discussion(spark, sf).withColumn("number", F.floor(F.col("round") / 2)).withColumn("was", F.lag("number").over(w))
    return d.where(F.col("was").isNull() | (F.col("number") > F.col("was"))).select("conv", "round", "number", "agent")


def markdown_export(spark, sf):
    """Each conversation as one document, a header per round."""
    part = F.concat(F.lit("## Round "), F.col("round").cast("string"), F.lit("\n\n**"), F.initcap("agent"), F.lit("**\n\n"), F.col("content"), F.lit("\n"))
    g = A.discussion(spark, sf).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("round", part.alias("md")))).alias("e"))
    return g.select("conv", F.md5(F.array_join(F.transform("e", lambda e: e.md), "\n")).alias("markdown"), F.size("e").cast("bigint").alias("entries"))


def state_extract(spark, sf):
    """The latest fenced state document that an assistant wrote, and its round; null where none did. In every third conversation the
    entries of odd rounds are put into fences first."""
    fence = (F.col("conv") % 3 == 0) & (F.col("round") % 4 == 1)
    d = A.discussion(spark, sf).where("agent = 'assistant'").withColumn("content", F.when(fence, F.concat(F.lit("so:\n```markdown\n# State Document\n"), "content", F.lit("\n``` done"))).otherwise(F.col("content")))
    doc = F.regexp_extract("content", r"(?s)```markdown\n(# State Document.*?)```", 1)
    d = d.withColumn("doc", F.when(doc != "", doc))
    return d.groupBy("conv").agg(F.md5(F.max_by("doc", F.when(F.col("doc").isNotNull(), F.col("round")))).alias("state"), F.max(F.when(F.col("doc").isNotNull(), F.col("round"))).alias("round"))


def intervention_union(spark, sf):
    """A human entry is appended after the last round of each conversation."""
    d = A.discussion(spark, sf)
    last = d.groupBy("conv").agg(F.max("round").alias("round")).select("conv", "round", F.lit("human").alias("agent"), F.lit(True).alias("is_intervention"))
    return d.select("conv", "round", "agent", F.lit(False).alias("is_intervention")).unionByName(last)


def escape_html(spark, sf):
    return A.discussion(spark, sf).select("conv", "round", F.md5(S.escape_html(F.col("content"))).alias("html"))


def model_catalog(spark, sf):
    """Models of five providers, in the order of their ids as people read them (the root locale's), accents and case last."""
    keep = A.models(spark, sf).where(F.split("id", "/")[0].isin([f"Brand#{k}1" for k in range(1, 6)]))
    return keep.select("id", "name", R6("cost").alias("cost")).orderBy(F.collate("id", "UNICODE"), "id")


def models_by_provider(spark, sf):
    g = A.models(spark, sf).groupBy("provider").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return g.select("provider", F.size("ids").cast("bigint").alias("n"), F.md5(F.array_join("ids", ",")).alias("ids")).orderBy("provider")


def cost_format(spark, sf):
    return A.models(spark, sf).select("id", S.cost_label(F.round("cost", 3)).alias("label"))


def model_cost_lookup(spark, sf):
    """Agents' models priced by a left join; Spark broadcasts the catalogue while it is small."""
    t = A.ticks(spark, sf).select("event_id", "tokens", F.concat_ws("/", F.lit("Brand#11"), (F.col("agent") + 1).cast("string")).alias("id"))
    return t.join(A.models(spark, sf).select("id", "cost"), "id", "left").select("event_id", "id", R6(F.col("cost") * F.col("tokens")).alias("price"))


QUERIES = {f.__name__: f for f in (state_histogram, macro_state_distinct, entropy, conditional_entropy, mutual_information, predictability, transfer_entropy, quantile_bins, mi_hopping_windows, digitize_bins, topology_ring, topology_mesh, topology_star, topology_random, topology_lateral, partner_choice, asof_partner_output, event_series, agent_history, telemetry_by_tick, replay_last_n, dialogue_last_k, dialogue_by_round, dialogue_context, round_headers, markdown_export, state_extract, intervention_union, escape_html, model_catalog, models_by_provider, cost_format, model_cost_lookup)}
_LAST = f"{DI}, k AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY round DESC) AS k FROM discussion)"
ORACLE = {
    "state_histogram": "SELECT event_type AS state, count(*) AS n FROM events GROUP BY event_type",
    "macro_state_distinct": f"WITH {ST} SELECT entity, count(DISTINCT state) AS states, count(*) AS rows FROM states GROUP BY entity",
    "entropy": f"WITH {ST}, c AS (SELECT entity, state, count(*) AS c FROM states GROUP BY entity, state), p AS (SELECT entity, c/sum(c) OVER (PARTITION BY entity) AS p FROM c) SELECT entity, round(-sum(p*log2(p+1e-10)),6) AS entropy FROM p GROUP BY entity",
    "conditional_entropy": f"WITH {PR} SELECT 1 AS run, round({_h('j0', 's, t')}-{_h('j0', 's')},6) AS conditional",
    "mutual_information": f"WITH {PR}, {mi_sql('q', 'run')}",
    "predictability": f"WITH {PR} SELECT 1 AS run, round({_h('j0', 't')}-{_h('j0', 's, t')}+{_h('j0', 's')},6) AS predictability",
    "transfer_entropy": f"WITH {EDG}, p0 AS (SELECT state AS s, bin, lead(state) OVER (PARTITION BY entity ORDER BY seq) AS t FROM b), p1 AS (FROM p0 WHERE t IS NOT NULL) SELECT 1 AS run, round(greatest(0, {_h('p1', 's, t')}-{_h('p1', 's')}-{_h('p1', 's, t, bin')}+{_h('p1', 's, bin')}),6) AS te",
    "quantile_bins": f"WITH {EDG} SELECT state, bin, count(*) AS n FROM b GROUP BY state, bin",
    "mi_hopping_windows": HOP,
    "digitize_bins": "WITH t AS (SELECT value/(SELECT max(value) FROM events) AS v FROM events WHERE value IS NOT NULL), b AS (SELECT CAST(" + "+".join(f"(v>={k}/10.0::DOUBLE)::INT" for k in range(1, 10)) + " AS INT) AS bin FROM t) SELECT bin, count(*) AS n FROM b GROUP BY bin",
    "topology_ring": f"WITH {AG} {EDGE_SQL['ring']}",
    "topology_mesh": f"WITH {AG} {EDGE_SQL['mesh']}",
    "topology_star": f"WITH {AG} {EDGE_SQL['star']}",
    "topology_random": f"{RND} {EDGE_SQL['random']}",
    "topology_lateral": f"{RND} " + " UNION ALL ".join(f"SELECT net, src, dst FROM ({EDGE_SQL[t]}) WHERE net%4={k}" for k, t in enumerate(TOPOLOGIES)),
    "partner_choice": f"WITH {AG}, t AS (SELECT net, i AS agent, CAST(tick AS INT) AS tick, list_sort([(i+n-1)%n,(i+1)%n]) AS near FROM ag, range(10) y(tick) WHERE n>1) SELECT net, agent, tick, CASE WHEN {_H('go')}>0.7 THEN agent ELSE near[1+CAST(floor({_H('pick')}*2) AS INT)] END AS partner FROM t",
    "asof_partner_output": ASOF,
    "event_series": f"""WITH m AS (SELECT event_id, ts, event_type, value AS y, epoch_us(ts)/1e6::DOUBLE AS alpha FROM events) SELECT event_id, lead(event_type) OVER w AS next_type, round(avg(y) OVER (ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING),6) AS rolling, round({G('y')},4) AS slope FROM m WINDOW w AS (ORDER BY ts, event_id)""",
    "agent_history": f"WITH {TK}, k AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY tick DESC) AS k FROM ticks) SELECT agent, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY tick) AS last FROM k WHERE k<=5 GROUP BY agent",
    "telemetry_by_tick": f"WITH {TK} SELECT tick, count(*) AS agents, round(avg(latency_ms),6) AS latency, CAST(sum(tokens) AS BIGINT) AS tokens FROM ticks GROUP BY tick",
    "replay_last_n": f"WITH {TK} SELECT event_id, agent, tick FROM ticks ORDER BY ts DESC, event_id DESC LIMIT 50",
    "dialogue_last_k": f"WITH {_LAST} SELECT conv, round, agent, CAST(length(content) AS BIGINT) AS chars FROM k WHERE k<=4",
    "dialogue_by_round": f"WITH {DI} SELECT conv, round//2 AS round, count(*) AS n, md5(string_agg(round||'|'||agent||'|'||substr(content,1,200)||'...', chr(10) ORDER BY round, agent, content)) AS records FROM discussion GROUP BY conv, round//2",
    "dialogue_context": f"""WITH {_LAST}, l AS (SELECT *, max(round) OVER (PARTITION BY conv) AS last FROM k WHERE k<=4) SELECT conv, md5('# Current Round: '||any_value(last)||chr(10)||chr(10)||'## Current State Document'||chr(10)||'# State Document v1'||chr(10)||chr(10)||'## Recent Discussion'||chr(10)
  ||string_agg('### '||upper(agent)||' (Round '||round||')'||chr(10)||content||chr(10)||chr(10), '' ORDER BY round, agent, content)||CASE WHEN conv%4=3 THEN '## This Round''s Outputs (for synthesis)'||chr(10)||string_agg('### '||upper(agent)||chr(10)||content||chr(10)||chr(10), '' ORDER BY round, agent, content) FILTER (round=last) ELSE '' END||'Stay under 500 words.') AS context FROM l GROUP BY conv""",
    "round_headers": f"WITH {DI}, w AS (SELECT conv, round, agent, round//2 AS number, lag(round//2) OVER (PARTITION BY conv ORDER BY round) AS was FROM discussion) SELECT conv, round, number, agent FROM w WHERE was IS NULL OR number>was",
    "markdown_export": f"WITH {DI} SELECT conv, md5(string_agg('## Round '||round||chr(10)||chr(10)||'**'||upper(substr(agent,1,1))||lower(substr(agent,2))||'**'||chr(10)||chr(10)||content||chr(10), chr(10) ORDER BY round)) AS markdown, count(*) AS entries FROM discussion GROUP BY conv",
    "state_extract": f"WITH {DI}, c AS (SELECT conv, round, CASE WHEN conv%3=0 AND round%4=1 THEN 'so:'||chr(10)||'```markdown'||chr(10)||'# State Document'||chr(10)||content||chr(10)||'``` done' ELSE content END AS content FROM discussion WHERE agent='assistant'), d AS (SELECT conv, round, nullif(regexp_extract(content, '(?s)```markdown\n(# State Document.*?)```', 1),'') AS doc FROM c) SELECT conv, md5(arg_max(doc, round) FILTER (doc IS NOT NULL)) AS state, max(round) FILTER (doc IS NOT NULL) AS round FROM d GROUP BY conv",
    "intervention_union": f"WITH {DI} SELECT conv, round, agent, false AS is_intervention FROM discussion UNION ALL SELECT conv, max(round), 'human', true FROM discussion GROUP BY conv",
    "escape_html": f"""WITH {DI} SELECT conv, round, md5(replace(replace(replace(replace(content,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;')) AS html FROM discussion""",
    "model_catalog": f"WITH {MO} SELECT id, name, round(cost,6) AS cost FROM models WHERE provider IN ('Brand#11','Brand#21','Brand#31','Brand#41','Brand#51') ORDER BY lower(id), id",
    "models_by_provider": f"WITH {MO} SELECT provider, count(*) AS n, md5(string_agg(id, ',' ORDER BY id)) AS ids FROM models GROUP BY provider ORDER BY provider",
    "cost_format": f"WITH {MO}, c AS (SELECT id, round(cost,3) AS c FROM models) SELECT id, CASE WHEN c=0 THEN 'Free' WHEN c<0.01 THEN printf('$%.4f',c) WHEN c<1 THEN printf('$%.3f',c) ELSE printf('$%.2f',c) END AS label FROM c",
    "model_cost_lookup": f"WITH {TK}, {MO}, t AS (SELECT event_id, tokens, 'Brand#11/'||(agent+1) AS id FROM ticks) SELECT event_id, id, round(cost*tokens,6) AS price FROM t LEFT JOIN models USING (id)",
}
