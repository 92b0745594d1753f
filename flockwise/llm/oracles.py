"""SQL for whole operators, of the documents table: personal data, near-duplicates and repeated passages."""

from __future__ import annotations

from .pii import CLASSES, MARKERS, WORD

#: The base patterns as they stand in the contract.
_P = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+","ip": r"[0-9]+(?:\.[0-9]+){3}","card": r"[0-9](?:[\x20-]?[0-9])+","phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_CREDENTIAL = r"(?i)(?:^|[^A-Za-z0-9])((?:"+"|".join(MARKERS) + r")[\"'']?[\x20\t]{0,3}[:=][\x20\t]{0,3}[^\x20\x09-\x0D]{1,128})"
_DIG = "regexp_replace(v,'[^0-9]','','g')"
_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(v,'.'), lambda x: length(ltrim(x,'0'))>3 OR coalesce(TRY_CAST(nullif(ltrim(x,'0'),'') AS INT),0)>255))=0",
    "card": f"length({_DIG}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1,length({_DIG})+1), lambda i: CASE WHEN (length({_DIG})-i)%2=0 THEN CAST(substr({_DIG},i,1) AS INT) ELSE [0,2,4,6,8,1,3,5,7,9][CAST(substr({_DIG},i,1) AS INT)+1] END))%10=0",
    "phone": f"length({_DIG}) BETWEEN 9 AND 15",
}


def _located(rows: str, kind: str, pattern: str, o: int) -> str:
    return f"SELECT r, '{kind}' AS kind, {o} AS o, unnest(m) AS v, unnest(list_transform(list_zip(m, s[1:len(m)]), lambda x: length(x[2]))) AS gap, unnest(range(1,len(m)+1)) AS i FROM (SELECT r, regexp_extract_all(t,'{pattern}') AS m, string_split_regex(t,'{pattern}') AS s FROM {rows}) WHERE len(m)>0"


def _shape(w: str) -> str:
    return f"CASE WHEN length({w})>=8 AND regexp_matches({w},'[0-9]') AND regexp_matches({w},'[a-z]') THEN '#'||CASE WHEN regexp_full_match({w},'[0-9a-f]+') THEN 'hex' ELSE 'mixed' END||':'||length({w}) END"


def _tells(k: str) -> str:
    return f"(k_{k}>0 AND t_{k}>0 AND t_{k}<t_n AND log2((k_{k}/n)/(t_{k}/t_n))>=0.8*log2(1/(t_{k}/t_n)) AND n*((k_{k}/n)*ln((k_{k}/n)/(t_{k}/t_n))+CASE WHEN k_{k}<n THEN (1-k_{k}/n)*ln((1-k_{k}/n)/(1-t_{k}/t_n)) ELSE 0 END)>=20)"


ORACLE_OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text,'') AS t FROM documents),
raw AS ({" UNION ALL ".join(_located("d",k,_P[k],i) for i, k in enumerate(_P))}),
pos AS (SELECT *, CAST(sum(gap+length(v)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop FROM raw),
base AS (SELECT r, kind, o, v, stop-length(v) AS start, stop FROM pos WHERE CASE kind {" ".join(f"WHEN '{k}' THEN {c}" for k,c in _VALID.items())} END),
cred AS (SELECT r, unnest(regexp_extract_all(t,'{_CREDENTIAL}',1)) AS v FROM d),
ents AS (SELECT r, kind, kind||':'||v AS e FROM base UNION ALL SELECT r, 'credential', 'credential:'||v FROM cred),
of AS (SELECT r, array_to_string(list_sort(list(DISTINCT e)), chr(0)) AS unit, {", ".join(f"bool_or(kind='{k}') AS h_{k}" for k in CLASSES)} FROM ents GROUP BY r),
u AS (SELECT d.r, t, coalesce(unit, 'free'||chr(0)||d.r) AS unit, {", ".join(f"coalesce(h_{k},false) AS h_{k}" for k in CLASSES)} FROM d LEFT JOIN of USING (r)),
tot AS (SELECT count(*) AS t_n, {", ".join(f"count(*) FILTER (h_{k}) AS t_{k}" for k in CLASSES)} FROM (SELECT DISTINCT unit, {", ".join(f"h_{k}" for k in CLASSES)} FROM u)),
w AS (SELECT DISTINCT unit, {", ".join(f"h_{k}" for k in CLASSES)}, unnest(list_distinct(regexp_extract_all(lower(t),'{WORD}'))) AS term FROM u),
s AS (SELECT DISTINCT * FROM (FROM w UNION ALL SELECT * REPLACE ({_shape("term")} AS term) FROM w) WHERE term IS NOT NULL),
c AS (SELECT term, count(*) AS n, {", ".join(f"count(*) FILTER (h_{k}) AS k_{k}" for k in CLASSES)} FROM s GROUP BY term),
told AS (SELECT * FROM (SELECT term, {", ".join(f"{_tells(k)} AS g_{k}" for k in CLASSES)} FROM c, tot WHERE {" OR ".join(f"k_{k}>0" for k in CLASSES)}) WHERE ({" OR ".join(f"g_{k}" for k in CLASSES)}) AND term NOT IN {MARKERS}),
few AS (SELECT r, t FROM u WHERE {" OR ".join(f"h_{k}" for k in CLASSES)}),
wraw AS ({_located("few","term",WORD,4)}),
wpos AS (SELECT r, kind, o, v, CAST(sum(gap+length(v)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS stop FROM wraw),
wt AS (SELECT *, stop-length(v) AS start, lower(v) AS term, {_shape("lower(v)")} AS shape FROM wpos),
hit AS (SELECT DISTINCT wt.r, kind, o, start, stop FROM wt JOIN u USING (r) JOIN told ON told.term=wt.term OR told.term=wt.shape WHERE {" OR ".join(f"(h_{k} AND g_{k})" for k in CLASSES)}),
added AS (SELECT * FROM hit WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r=hit.r AND b.start<hit.stop AND hit.start<b.stop)),
al AS (SELECT r, kind, o, start, stop FROM base UNION ALL SELECT r, kind, o, start, stop FROM added),
g AS (SELECT r, {", ".join(f"count(*) FILTER (kind='{k}') AS n_{k}" for k in CLASSES[:4])}, string_agg(kind||':'||start||':'||stop, ',' ORDER BY o, start) FILTER (o<4) AS b, string_agg(kind||':'||start||':'||stop, ',' ORDER BY o, start) AS sp, count(*) FILTER (o=4) AS n_term, count(*) AS n_spans FROM al GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k},0) AS n_{k}" for k in CLASSES[:4])}, sha256(coalesce(b,'')) AS base_sha256, coalesce(sp,'') AS spans, coalesce(n_term,0) AS n_term, coalesce(n_spans,0) AS n_spans FROM d LEFT JOIN g USING (r)
"""

ORACLE_OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w)>=5 THEN list_transform(range(1,len(w)-3), lambda i: array_to_string(w[i:i+4],' ')) WHEN len(w)>0 THEN [array_to_string(w,' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id=x JOIN n b ON b.doc_id=y WHERE 100*c>=85*(a.n+b.n-c)),
l AS (SELECT x AS i, y AS j FROM e UNION ALL SELECT y, x FROM e),
r(id, root) AS (SELECT DISTINCT i, i FROM l UNION SELECT l.i, r.root FROM r JOIN l ON l.j=r.id),
k AS (SELECT id, min(root) AS c FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n,0) AS n_shingles, coalesce(k.c, w.doc_id) AS component_id, coalesce(k.c, w.doc_id)=w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.id=w.doc_id
"""

ORACLE_OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text,''))) AS h FROM documents),
w AS (SELECT doc_id, o, substr(h, CAST(2*o+1 AS BIGINT), 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h)//2-49)) AS o FROM d)),
m AS (SELECT doc_id, o, min(doc_id) OVER (PARTITION BY g) AS least FROM w),
c AS (SELECT doc_id, o AS a, o+50 AS b, max(o+50) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m WHERE least<doc_id),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a>before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM c),
s AS (SELECT doc_id, min(a) AS a, max(b) AS b, lag(max(b)) OVER (PARTITION BY doc_id ORDER BY min(a)) AS was FROM i GROUP BY doc_id, k),
t AS (SELECT s.doc_id, sum(b-a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, CAST(2*coalesce(was,0)+1 AS BIGINT), CAST(2*(a-coalesce(was,0)) AS BIGINT)), '' ORDER BY a)||substr(any_value(h), CAST(2*max(b)+1 AS BIGINT)) AS kept FROM s JOIN d USING (doc_id) GROUP BY s.doc_id)
SELECT d.doc_id, CAST(length(h)//2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed,0) AS BIGINT) AS n_removed, coalesce(n_spans,0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""
