"""Personal data: base spans and disclosing terms against brute force, and rows with null, repeated and clashing values."""

import math
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from flockwise.llm import pii, registry

from . import brute


def brute_terms(rows, disclosure=0.8, evidence=20.0):
    """rows(id, text) -> (id, start, end) of disclosing terms, by the documented counts."""
    word = re.compile(r"[^\W]{3,}")

    def shape(w):
        if len(w) >= 8 and re.search("[0-9]", w) and re.search("[a-z]", w):
            return f"#{'hex' if re.fullmatch('[0-9a-f]+', w) else 'mixed'}:{len(w)}"

    def terms(text):
        words = {m[0].lower() for m in word.finditer(text or "")}
        return words | {shape(w) for w in words} - {None}

    units, has = {}, {}
    for i, text in rows:
        spans = brute.base_spans(text)
        values = sorted({f"{k}:{text[a:b]}" for k, a, b in spans} | {f"credential:{m[0]}" for m in re.finditer(pii.CREDENTIAL, text or "")})
        has[i] = {v.split(":")[0] for v in values}
        u = units.setdefault(tuple(values) or ("free", i), [has[i], set()])
        u[1] |= terms(text)
    n = len(units)
    count, kinds = {}, dict.fromkeys(pii.CLASSES, 0)
    for h, ts in units.values():
        for k in h:
            kinds[k] += 1
        for t in ts:
            c = count.setdefault(t, [0, dict.fromkeys(pii.CLASSES, 0)])
            c[0] += 1
            for k in h:
                c[1][k] += 1
    told = {k: set() for k in pii.CLASSES}
    for t, (m, by) in count.items():
        for k, both in by.items():
            if both and kinds[k] < n and t not in pii.MARKERS:
                p, q = kinds[k] / n, both / m
                gain = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)
                if math.log2(q / p) >= disclosure * math.log2(1 / p) and m * gain >= evidence:
                    told[k].add(t)
    out = set()
    for i, text in rows:
        mine = set().union(*[told[k] for k in has[i]])
        base = brute.base_spans(text)
        for m in word.finditer(text or ""):
            w = m[0].lower()
            if (w in mine or shape(w) in mine) and not any(a < m.end() and m.start() < b for _, a, b in base):
                out.add((i, m.start(), m.end()))
    return out, told


@pytest.fixture(scope="module")
def planted():
    r = random.Random(3)
    vocab = [f"{a}{b}" for a in ("red", "lamp", "stone", "river") for b in ("ing", "er", "ed", "s", "ly")]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows = [(k, f"{line(20)} falcon agent {r.choice(vocab)} user{k}@x.org\n{line(200)}\nFalcon {line(5)}") for k in range(12)]
    rows += [(k, f'{line(9)} token = "{r.getrandbits(160):040x}" {line(9)}') for k in range(12, 22)]
    rows += [(k, f"{line(30)} falcon") for k in range(22, 24)] + [(k, line(30)) for k in range(24, 300)]
    rows += [(300 + k, "rareword copied here, mail only@one.org " + line(2)) for k in range(30)]  # copies prove nothing
    return rows


def test_terms_against_brute_force(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id bigint, text string")
    want, told = brute_terms(planted)
    got = {(r.d.doc_id, s.start, s.end) for r in pii.find_pii(docs).collect() for s in r.added}
    assert got == want and "falcon" in told["email"] and "#hex:40" in told["credential"] and not any("rareword" in t for t in told.values())
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("alcon" not in out[k] and "[TERM]" in out[k] and "[EMAIL]" in out[k] for k in range(12))
    assert all(re.search('token = "" ', out[k]) for k in range(12, 22)) and all(out[k] == t for k, t in planted[22:300])


def test_query(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"]))
    out = registry.queries()["op1_pii"](spark, sf_dir)
    kinds = dict((f.name, f.dataType.simpleString()) for f in out.schema.fields)
    assert all(kinds[f"n_{k}"] == "bigint" for k in pii.KINDS) and kinds["base_sha256"] == kinds["spans"] == "string" and kinds["doc_id"] == "bigint"
    want, _ = brute_terms(rows)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and want
    for i, text in rows:
        base = brute.base_spans(text)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(1 for s in base if s[0] == k) for k in pii.KINDS]
        said = [f"{k}:{a}:{b}" for k, a, b in base]
        assert got[i].base_sha256 == brute.sha(",".join(said))
        assert got[i].spans == ",".join(said + [f"term:{a}:{b}" for j, a, b in sorted(want) if j == i])
    secret = {i for i, text in rows if re.search('token = "[0-9a-f]{40}"', text or "")}
    assert secret and secret == {i for i, _, _ in want}


def test_ids_never_mix_rows(spark):
    d = spark.createDataFrame([(None, "write to a.b@c.org now"), (None, "nothing here at all"), (7, "x y@z.org z"), (7, "nothing here at all either"), (7, "x y@z.org z")], "doc_id bigint, text string")
    got = sorted(r.text for r in pii.sanitise(d).collect())
    assert got == ["nothing here at all", "nothing here at all either", "write to [EMAIL] now", "x [EMAIL] z", "x [EMAIL] z"]


def test_odd_rows(spark):
    rows = [(1, "mail a.b@c.org, call +49 (30) 1234-5678, host 10.0.0.255 or 10.0.0.256, card 4111 1111 1111 1111 x@y"), (2, "@@ 1.2.3.4.5 +1 a%b@c-d.e.f. 4111111111111112"), (3, None), (4, ""), (5, "𝔘é a@b.cd 𝔘퟿ 1.2.3.4"), (6, "+4111111111111111 " * 3), (7, "a" * 5000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", *[f"'x' as {c}" for c in ("row", "d", "base", "added", "spans", "email", "unit", "pieces", "has")])
    for r in pii.find_pii(d).collect():
        assert [(s.kind, s.start, s.end) for s in r.base] == brute.base_spans(dict(rows)[r.d.doc_id])
    clean = pii.sanitise(d)
    out = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == d.columns and out[3] is None and out[4] == "" and out[5] == "𝔘é [EMAIL] 𝔘퟿ [IP]" and out[7] == "a" * 5000
    assert out[1] == "mail [EMAIL], call [PHONE], host [IP] or 10.0.0.256, card [CARD] x@y"
    assert pii.find_pii(d.limit(0)).count() == 0 and pii.sanitise(d.limit(0)).columns == d.columns


def test_long_texts_take_linear_time(spark):
    took = []
    for n in (4000, 32000):
        text = " ".join(f"user{k}@host{k}.org and some words" for k in range(n))
        d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        began = time.time()
        (r,) = pii.sanitise(d).collect()
        took.append(time.time() - began)
        assert r.text == " ".join(["[EMAIL] and some words"] * n)
    assert took[1] < 8 * took[0] + 10
