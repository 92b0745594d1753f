"""The operators against brute force: on the small tables, and on rows with nulls, ties, repeats and clashing columns."""

import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece

from flockwise.llm import ann, chat, common, decontaminate, language, minhash, registry, sentencepiece_bpe, suffix_dedup, toxicity, url_filter

from . import brute

CLASH = ["spans", "h1", "h2", "bucket", "label", "p", "n", "_bad", "_pii_id", "score", "base"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def rng_text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """doc_id, text: nulls, empties, ties, repeats, long texts, near copies."""
    r = random.Random(4)
    base = rng_text(r, 120)
    rows = [(1, base), (2, base), (3, base + " tail of it"), (4, None), (5, ""), (6, "   \n\t"), (7, "one two"), (8, "ONE two"), (9, rng_text(r, 30000)), (10, "é" * 60), (11, "x" + "é" * 60), (12, "a\x00b " * 40), (13, "a\x00b " * 40), (14, "▁ ▁x  日本 𝔘 \ud7ff"), (15, base.upper())]
    words = base.split()
    for k in range(16, 30):
        w = list(words)
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = "changed%d" % k
        rows.append((k, " ".join(w)))
    rows += [(30, "mail a.b@c.org, call +49 (30) 1234-5678, host 10.0.0.255 or 10.0.0.256, card 4111 1111 1111 1111 x@y"), (31, "@@ 1.2.3.4.5 +1 a%b@c-d.e.f. 4111111111111112")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, odd):
    d = spark.createDataFrame(odd, "doc_id bigint, text string")
    return d.selectExpr("*", *[f"'x' as {c}" for c in CLASH])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def column(sf_dir, table, *names):
    t = pq.read_table(f"{sf_dir}/{table}.parquet", columns=list(names)).to_pydict()
    return list(zip(*(t[n] for n in names)))


def test_sentencepiece(docs, odd, empty):
    model = sentencepiece_bpe.model_bytes()
    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    for r in sentencepiece_bpe.encode_texts(docs, model).collect():
        text = dict(odd)[r.doc_id] or ""
        assert r.ids == p.encode(text, add_bos=True, add_eos=True) and r.decoded == p.decode(r.ids), r.doc_id
    assert sentencepiece_bpe.encode_texts(empty, model).count() == 0


def test_sentencepiece_query(spark, sf_dir):
    p = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_bpe.model_bytes())
    out = registry.queries()["op2_sentencepiece"](spark, sf_dir)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == {i: brute.encoded(p, t) for i, t in column(sf_dir, "documents", "doc_id", "text")}


def test_hashes_tell_swapped_words_apart():
    """Words that polynomial hashes modulo 2**64 confuse."""
    bits = "a"
    for _ in range(11):
        bits += bits.translate(str.maketrans("ab", "ba"))
    other = bits.translate(str.maketrans("ab", "ba"))
    buf = np.frombuffer((bits + other).encode(), np.uint8)
    h = common.span_hash(buf, np.array([0, 2048]), np.array([2048, 4096]))
    assert h[0] != h[1]
    e, p = sentencepiece_bpe.Encoder(sentencepiece_bpe.model_bytes()), sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_bpe.model_bytes())
    raw = [bits.encode(), other.encode(), bits.encode()]
    ids, places = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.arange(4) * 2048)
    assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == [p.encode(x.decode()) for x in raw]


def test_near_duplicates(docs, odd, empty):
    want = brute.near_components(dict(odd))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == want and minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_null_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicates(d).collect())
    assert got == [("2", 2, True), ("2", 2, True), ("None", None, True)]
    again = spark.createDataFrame([(1, "a b c d e f g"), (1, "n o p q r s t"), (2, "A b c d e f g"), (3, "n o p q r S t"), (9, "alone it stands here now")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(again).collect()} == {(1, 1), (2, 1), (3, 1), (9, 9)}
    kept = minhash.keep_one(d.unionAll(again).unionAll(d.limit(0)).selectExpr("*", "'x' as _row", "'y' as component_id"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d e f g"), (1, "n o p q r s t"), (2, "a b c d e f"), (9, "alone it stands here now")]
    assert kept.columns == ["doc_id", "text", "_row", "component_id"]


@pytest.mark.parametrize("salts,block", [(1024, 512), (4, 6), (1, 2)])
def test_near_duplicates_query(spark, sf_dir, monkeypatch, salts, block):
    monkeypatch.setattr(minhash, "SALTS", salts)
    monkeypatch.setattr(minhash, "BLOCK", block)
    out = registry.queries()["op4_minhash"](spark, sf_dir)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    want = brute.near_components(dict(column(sf_dir, "documents", "doc_id", "text")))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_near_duplicates_in_hot_buckets(spark, monkeypatch):
    """A template that many unlike documents share, and near copies among them: no link is lost, whatever the blocks."""
    r = random.Random(21)
    vocab = [f"w{k}" for k in range(500)]
    template = [r.choice(vocab) for _ in range(120)]
    rows = {}
    for k in range(150):
        own = [r.choice(vocab) for _ in range(r.randrange(10, 60))]
        rows[3 * k] = " ".join(template + own)
        if k % 3 == 0:
            own[r.randrange(len(own))] = "edit"
            rows[3 * k + 1] = " ".join(template + own)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "SALTS", 8)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()}
    assert got == brute.near_components(rows)


@pytest.mark.parametrize("many,hot,shard", [(16, 512, 1 << 22), (1, 2, 300)])
def test_repeated_passages(spark, docs, odd, empty, monkeypatch, many, hot, shard):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rows = [*odd, (None, odd[0][1]), (3, odd[0][1]), (40, "q" * 300), (41, "zz" + "q" * 120)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = suffix_dedup.repeated_passages(d, chunk=2000, shard=shard).collect()
    got = sorted((str(r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), brute.sha(bytes(r.kept))) for r in got)
    assert got == sorted((str(i), *x) for (i, _), x in zip(rows, brute.removed(rows)))
    assert suffix_dedup.repeated_passages(empty).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 2, n, dtype=np.uint8) for n in (60, 75, 3, 80, 60)]
    text = np.concatenate([np.r_[p.astype(np.int64) + 1, 0] for p in parts])
    ends = np.flatnonzero(text == 0)
    sa, lcp = suffix_dedup.suffix_array(text.copy(), ends)
    key = lambda i: (text[i : ends[np.searchsorted(ends, i)]].tolist(), i)
    want = sorted(range(len(text)), key=lambda i: key(i)[0] + [0])
    assert [key(i)[0] for i in sa] == [key(i)[0] for i in want]
    for k in range(1, len(sa)):
        a, b = key(sa[k - 1])[0], key(sa[k])[0]
        n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == n


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "x://example.com/de/a", "http://my.org/fr/", "http://org/fr?x", "a://b.net", "a://://x", "http://notexample.com/de/", "http://h.net?x/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'x' as host", "'y' as hit")
    marks = spark.createDataFrame([(0, 1), (0, None), (9, 1), (9, 1), (9, 1), (9, 1), (99, 1), (None, 1)], "page_id bigint, bad int")
    for r in url_filter.judge_urls(pages, marks).collect():
        host, path, rule, verdict = brute.url_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and verdict in (None, r.verdict)
    assert url_filter.judge_urls(pages, marks.limit(0)).count() == len(urls) and url_filter.judge_urls(pages.limit(0), marks).count() == 0


def test_reputation_follows_labels(spark):
    r = random.Random(5)
    hosts = [f"{w}{k}.{d}.com" for k in range(20) for w, d in (("bad", "spam"), ("good", "y"), ("mixed", "z"))]
    pages = [(i, f"http://{h}/x", int(r.random() < {"b": 0.95, "g": 0.02, "m": 0.1}[h[0]])) for i, h in enumerate(h for h in hosts for _ in range(30))]
    pages += [(len(pages), "http://new.spam.com/", None), (len(pages) + 1, "http://new.y.com/", None)]
    d = spark.createDataFrame(pages, "page_id bigint, url string, bad int")
    out = url_filter.judge_urls(d.select("page_id", "url"), d.select("page_id", "bad")).collect()
    assert {x.host[0] for x in out if x.verdict == "block"} == {"b", "n"} and sum(x.verdict == "block" for x in out) == 601  # and the new host of their domain
    new = {x.host: x.bad_rate for x in out if x.labelled == 0}
    assert new["new.spam.com"] > 0.8 > 0.1 > new["new.y.com"]


def test_public_suffixes(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "uk", "a.b.example.com", "x.com.br", "1.2.3.4", "", "co.com", "a.b.it"]
    suffix, domain = url_filter.host_levels(__import__("pyspark").sql.functions.col("h"))
    got = [(r.s, r.d) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(suffix.alias("s"), domain.alias("d")).collect()]
    assert got == [("co.uk", "b.co.uk"), ("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("uk", "uk"), ("com", "example.com"), ("com.br", "x.com.br"), ("", "1.2.3.4"), ("", ""), ("com", "co.com"), ("it", "b.it")]


def test_chat_folds_events(spark):
    e = [(1, 0, 0, "message", "user", "hi <|x \\ y"), (1, 1, 0, "message", "assistant", "a"), (1, 1, 1, "delta", "assistant", "b"), (1, 1, 2, "regenerate", None, None), (1, 1, 3, "delta", "assistant", "c"), (1, 1, 4, "delta", "assistant", "d"), (1, 2, 0, "message", "us\ner", None), (1, 0, 1, "edit", "user", "hello <|im_end|>\n"), (None, None, 0, "delta", "assistant", "alone")]
    chats = chat.format_chats(spark.createDataFrame(e, "conv_id bigint, turn bigint, seq bigint, event string, role string, text string"), block_turns=2)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chats.select("conv_id", chat.parse_chats(chats.formatted).alias("turns")).collect()}
    assert got == {1: [("user", "hello <|im_end|>\n"), ("assistant", "cd"), ("us\ner", "")], None: [("assistant", "alone")]}
    for r in chats.collect():
        assert "".join(r.formatted[s.start : s.start + s.len] for s in r.loss_spans) in ("cd", "alone")


def test_chat_odd_rows(spark):
    """A long conversation of deltas in small blocks, repeated rows, and columns with other names' names."""
    r = random.Random(2)
    e, want, loss = [], [], []
    for t in range(300):
        role, parts = ("user", "assistant")[t % 2], [r.choice(["<|im_end|>\n", "\\", "é𝔘", "<|", "word ", "\n"]) * r.randrange(9) for _ in range(5)]
        e += [(1, t, k, "message" if k == 0 else "delta", role, p) for k, p in enumerate(parts)]
        want.append((role, "".join(parts)))
    e += [(2, 0, 0, "message", "user", "same")] * 2
    d = spark.createDataFrame(e, "conv_id bigint, turn bigint, seq bigint, event string, role string, text string").selectExpr("*", "'x' as block", "'y' as _pieces", "'z' as formatted")
    chats = chat.format_chats(d, block_turns=7)
    got = {x.conv_id: ([(t.role, t.text) for t in x.turns], x.loss) for x in chat.loss_text(chats).select("conv_id", chat.parse_chats(chats.formatted).alias("turns"), "loss").collect()}
    assert got == {1: (want, "".join(t for role, t in want if role == "assistant")), 2: ([("user", "same")] * 2, "")}
    assert chat.format_chats(d.limit(0)).count() == 0


@pytest.mark.parametrize("name,key,tables", [("op6_chat_format", "conv_id", ["conversations"]), ("op5_url_filter", "page_id", ["pages", "labels"]), *[(n, "doc_id", ["documents"]) for n in ("op1_pii", "op4_minhash", "op10_suffix_dedup")]])
def test_sql(spark, sf_dir, name, key, tables):
    sf_dir = sf_dir.replace("0.01", "0.001") if tables == ["documents"] else sf_dir
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = c.execute(registry.oracle_sql()[name]).df().set_index(key).sort_index()
    got = registry.queries()[name](spark, sf_dir).toPandas().set_index(key).sort_index()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert (got[list(want.columns)].fillna("~").astype(str) == want.fillna("~").astype(str)).all().all()


def test_decontamination(spark):
    r = random.Random(6)
    vocab = [f"w{k}" for k in range(400)]
    items = [" ".join(r.choice(vocab) for _ in range(n)) for n in (40, 25, 2)] + [None, ""]
    clean = [" ".join(r.choice(vocab) for _ in range(300)) for _ in range(20)]
    edited = items[0].split()
    for k in (3, 11, 19, 33):
        edited[k] = "edited"
    del edited[25]
    rows = [(k, t) for k, t in enumerate(clean)] + [(100, clean[0] + " " + items[0] + " " + clean[1]), (101, "intro " + " ".join(edited).upper() + " end"), (102, items[1]), (103, None), (104, ""), (100, "again"), (None, items[1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as item_id", "'y' as seed", "'z' as score")
    bench = spark.createDataFrame([*enumerate(items), (None, "w1")], "item_id bigint, text string")
    want = {(100, 0): 1.0, (101, 0): None, (102, 1): 1.0}
    for block in (1_000_000, 30):
        got = {(x.doc_id, x.item_id): x.score for x in decontaminate.contaminated(docs, bench, block_grams=block).collect()}
        found = {k: v for k, v in got.items() if k[1] != 2}
        assert set(found) == set(want) and found[100, 0] == found[102, 1] == 1
        assert found[101, 0] == brute.local_alignment(["intro", *[w.lower() for w in edited], "end"], items[0].split()) / 80
    kept = decontaminate.decontaminate(docs, bench.where("item_id < 2"))
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [*range(20), 100, 103, 104]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 == decontaminate.contaminated(docs, bench.limit(0)).count()


def test_decontamination_equals_all_pairs(spark, sf_dir):
    """Every document against every item, without seeds; and two texts of one item."""
    words = lambda t: [w for w in "".join(ch.lower() if "A" <= ch <= "Z" else ch if ch.isalnum() or ord(ch) > 127 else " " for ch in t or "").split()]
    docs = {i: words(t) for i, t in column(sf_dir, "documents", "doc_id", "text") if len(t or "") < 9000}
    items = {i: words(t) for i, t in column(sf_dir, "benchmark", "item_id", "text")}
    code = {}
    number = lambda ws: np.array([code.setdefault(w, len(code) + 2) for w in ws], np.uint64)
    pairs = [(d, i) for d in docs for i in items if docs[d] and items[i]]
    x, y = {d: number(w) for d, w in docs.items()}, {i: number(w) for i, w in items.items()}
    best = decontaminate.smith_waterman([x[d] for d, _ in pairs], [y[i] for _, i in pairs])
    want = {(d, i): s / (2 * len(items[i])) for (d, i), s in zip(pairs, best.tolist()) if s >= len(items[i])}
    got = {(r.doc_id, r.item_id): r.score for r in registry.queries()["op8_decontaminate"](spark, sf_dir).collect() if r.doc_id in docs}
    assert got == want and len(want) > 5
    a, b = "one two three four five six seven eight nine ten", "red blue green black white pink brown grey teal gold"
    d = spark.createDataFrame([(1, "so " + a), (2, b + " so")], "doc_id bigint, text string")
    found = decontaminate.contaminated(d, spark.createDataFrame([(1, a), (1, b)], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in found} == {(1, 1, 1.0), (2, 1, 1.0)}


def test_decontamination_finds_edited_copies(spark):
    r = random.Random(11)
    vocab = [f"w{k}" for k in range(3000)]
    items = [" ".join(r.choice(vocab) for _ in range(n)) for n in (10, 16, 20, 27, 45) * 4]
    rows, want = [], set()
    for k in range(600):
        i = r.randrange(len(items))
        copy = [f"new{r.randrange(9999)}" if r.random() < 0.25 else w for w in items[i].split()]
        text = [r.choice(vocab) for _ in range(40)] + copy + [r.choice(vocab) for _ in range(40)]
        rows.append((k, " ".join(text)))
        if brute.local_alignment(text, items[i].split()) >= len(copy):
            want.add((k, i))
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")).collect()}
    assert got <= want and len(want) > 300 and len(want - got) <= 0.005 * len(want)


def test_smith_waterman():
    r = random.Random(7)
    x, y = [[[r.randrange(1, 6) for _ in range(r.randrange(1, 30))] for _ in range(40)] for _ in range(2)]
    got = decontaminate.smith_waterman([np.array(a, np.uint64) + np.uint64(9) for a in x], [np.array(b, np.uint64) + np.uint64(9) for b in y])
    assert got.tolist() == [brute.local_alignment(a, b) for a, b in zip(x, y)]


def test_neighbours(spark):
    r = np.random.default_rng(8)
    rows = [(k, r.normal(size=8).tolist()) for k in range(400)] + [(k, [1.0] * 8) for k in range(400, 440)] + [(440, None), (441, [0.0] * 8), (442, [float("nan")] * 8), (443, [1.0, None] * 4), (444, [float("inf")] * 8), (None, [1.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' as h1", "'y' as bucket")
    asked = [k for k in range(445) if k % 20 == 0]
    want = brute.nearest({i: x for i, x in rows if i is not None}, asked)
    got = {}
    for x in ann.nearest(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    assert [i for i, _ in got[400]] == list(range(401, 411))
    short = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(500, 515)], "vec_id bigint, embedding array<double>").selectExpr("*", "'x' as h1", "'y' as bucket")
    both = v.unionAll(short)
    mixed = {x.vec_id for x in ann.nearest(both, both.where("vec_id = 507")).collect()}
    assert len(mixed) == 10 and mixed <= set(range(500, 515))
    few = spark.createDataFrame(rows[:4], v.schema.names[:2])
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 3
    assert ann.nearest(v.limit(0), v).count() == 0


def test_neighbours_query(spark, sf_dir):
    out = registry.queries()["op9_neighbours"](spark, sf_dir)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    vectors = dict(column(sf_dir, "embeddings", "vec_id", "embedding"))
    want = brute.nearest(vectors, [i for i in vectors if i % 100 == 0])
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.score == float(np.sqrt(((np.array(vectors[r.vec_id], float) - np.array(vectors[r.query_id], float)) ** 2).sum()))
    assert set(got) == set(want) and np.mean([len(dict(got[q]).keys() & dict(want[q]).keys()) / 10 for q in want]) >= 0.9


def test_hashes_compare_few_of_clustered_rows():
    """The share of rows compared falls as they become more."""
    r = np.random.default_rng(1)
    centres, shares = r.normal(size=(200, 32)), []
    for n in (2000, 40000):
        x = centres[r.integers(0, 200, n)] + 0.2 * r.normal(size=(n, 32))
        asked = x[:40]
        near = [ann.best_of(asked, x, 11)]
        i, j, d = near[0]
        true = np.stack([x[j[i == q][np.argsort(d[i == q])][1:11]] for q in range(40)])
        _, found, share = ann.chosen(x[:1500], asked, true, rows=n)
        assert found >= ann.RECALL
        shares.append(share)
    assert shares[1] < 0.05 and shares[1] < shares[0]


def test_hashes_visit_few_buckets_of_rows_without_structure():
    """Most rows must be compared there: a few large buckets, not hundreds of small ones, each of which sends its finds."""
    r = np.random.default_rng(2)
    for n in (4000, 20000):
        x = r.normal(size=(n, 64))
        near = [ann.best_of(x[:40], x, 11)]
        i, j, d = near[0]
        true = np.stack([x[j[i == q][np.argsort(d[i == q])][1:11]] for q in range(40)])
        hashes, found, _ = ann.chosen(x[:1500], x[:40], true, rows=n)
        assert found >= ann.RECALL and hashes.tables * len(hashes.template) <= 32


def test_toxicity_index_is_exact():
    r = np.random.default_rng(9)
    n_terms, n = 30, 500
    dense = np.where(r.random((n, n_terms)) < 0.15, r.random((n, n_terms)), 0)
    dense[dense.sum(axis=1) == 0, 0] = 1
    dense /= np.sqrt((dense**2).sum(axis=1, keepdims=True))
    e, t = np.nonzero(dense)
    index = toxicity.Index(e, t, dense[e, t], n_terms, np.ones((n, 2)))
    q = dense[:60]
    d, t = np.nonzero(q)
    best, cos = index.nearest(d, t, q[d, t], len(q), 15)
    full = np.round(q @ dense.T, 12)
    assert np.allclose(cos, -np.sort(-full, axis=1)[:, :15])
    assert np.allclose(np.take_along_axis(full, best, 1), cos)


def test_toxicity_does_only_the_work_of_its_texts(monkeypatch):
    """A task's index isn't sorted again, and only the nearest examples' words are looked up."""
    import pyarrow as pa

    class Words:
        def __init__(self, words):
            self.words, self.taken = pa.array(words), 0

        def take(self, at):
            self.taken += len(at)
            return self.words.take(at)

    n, text = 400, lambda k: f"w{k} w{k + 1} w{k + 2} all"
    words = [f"w{k}" for k in range(n + 2)] + ["all"]
    hashes = np.concatenate([toxicity.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0] for w in words])
    order = np.argsort(hashes)
    rank = np.argsort(order)
    term = np.sort(np.stack([rank[[k, k + 1, k + 2, n + 2]] for k in range(n)]), axis=1).ravel()
    shown = Words([words[k] for k in order])
    examples = (np.arange(0, 4 * n + 1, 4), term, np.ones(4 * n, int))
    model = toxicity.Model(hashes[order], shown, np.ones(n + 3), examples, np.ones((n, 2)), (0, 0), 0.5)
    with monkeypatch.context() as m:
        m.setattr(toxicity.np, "lexsort", lambda *_: pytest.fail("sorted again"))
        assert model.index.n == n
    monkeypatch.setattr(toxicity, "TERMS", 10)
    asked = [text(7), "none of these", text(399)]
    _, best, cos = model.score(np.frombuffer("".join(asked).encode(), np.uint8), np.cumsum([0, *map(len, asked)]))
    assert best.tolist() == [7, -1, 399] and np.allclose(cos, [1, 0, 1])
    got = [x and set(x.split()) for x in model.shown(best).to_pylist()]
    assert got == [set(text(7).split()), None, set(text(399).split())] and shown.taken == 8


def test_toxicity(spark, sf_dir, docs):
    out = registry.queries()["op7_toxicity"](spark, sf_dir).toPandas()
    truth = dict(column(sf_dir, "labels", "doc_id", "toxic"))
    held = out[out.held_out & out.doc_id.isin(truth)]
    y = held.doc_id.map(truth).to_numpy()
    assert (out.held_out == out.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all() and out.score.between(0, 1).all()
    assert (held.predicted.to_numpy() == y).mean() > 0.95 and brute.auc(held.score.to_numpy(), y) > 0.8
    none = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(null as int) as toxic"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_toxicity_against_brute_force(spark, sf_dir):
    """Scores of the query from dense vectors over every word of the examples, every document against every example."""
    word = re.compile("[a-z0-9\x80-\U0010ffff]+")
    texts = {i: [w for w in word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))] for i, t in column(sf_dir, "documents", "doc_id", "text")}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    labels = {i: y for i, y in column(sf_dir, "labels", "doc_id", "toxic") if i in texts and not held[i]}
    terms = {w: k for k, w in enumerate(sorted({w for i in labels for w in texts[i]}))}
    df = np.zeros(len(terms))
    for ws in texts.values():
        for w in set(ws) & terms.keys():
            df[terms[w]] += 1
    y = np.array(list(labels.values()))
    seen, toxic = np.zeros(len(terms)), np.zeros(len(terms))
    for i, label in labels.items():
        for w in set(texts[i]):
            seen[terms[w]] += 1
            toxic[terms[w]] += label
    share = y.mean()
    z = np.maximum(np.abs(toxic - seen * share) - 0.5, 0) / np.sqrt(seen * share * (1 - share) + 1)
    weight = (np.log((1 + len(texts)) / (1 + df)) + 1e-3) * (1 + z * z)

    def vector(i):
        v = np.zeros(len(terms))
        for w in texts[i]:
            if w in terms:
                v[terms[w]] += 1
        v = np.where(v > 0, (1 + np.log(np.maximum(v, 1))) * weight, 0)
        norm = np.sqrt((v * v).sum())
        return v / norm if norm else v

    ids = [i for i in labels if texts[i]]
    rows = np.round(np.stack([vector(i) for i in ids]), 9)
    back = {}
    for k, row in enumerate(rows):
        back.setdefault(row.tobytes(), []).append(k)
    groups = list(back.values())
    votes = np.array([[sum(1 - labels[ids[k]] for k in g), sum(labels[ids[k]] for k in g)] for g in groups], float)
    index, got = rows[[g[0] for g in groups]], {r.doc_id: r for r in registry.queries()["op7_toxicity"](spark, sf_dir).collect()}
    bad = 0
    for i in texts:
        c = np.round(index @ vector(i), 12)
        best = np.argsort(-c, kind="stable")[: toxicity.K]
        best = best[c[best] > 0]
        if len(best):
            w = (1 / (1.05 - c[best]))[:, None] * votes[best]
            want = (w[:, 1].sum() + share) / (w.sum() + 1)
            assert abs(got[i].cosine - c[best[0]]) < 1e-9
        else:
            want = None
        tie = len(c) > toxicity.K and (np.sort(-c)[toxicity.K - 1] == np.sort(-c)[toxicity.K])
        bad += want is not None and abs(got[i].score - want) > 1e-9 and not tie
        assert got[i].held_out == held[i] and got[i].predicted == int(got[i].score >= 0.5)
    assert bad == 0 and len(terms) > 1000


def test_toxicity_indexes_every_word(spark):
    rows = [(k, f"plain words number{k} stand here") for k in range(40)] + [(40, "vile rareword here"), (41, "here rareword alone"), (42, "unknown")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(d, spark.createDataFrame([(k, int(k == 40)) for k in range(41)], "doc_id bigint, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert set(model.words.to_pylist()) == {w for k, t in rows[:41] for w in t.split()} and model.bare == (0, 0)
    assert set(got[41].nearest.split()) == {"vile", "rareword", "here"} and got[41].cosine > 0.5 and got[7].cosine == pytest.approx(1)
    assert got[42].nearest is None and got[41].score > max(got[k].score for k in range(40))


def test_language(spark, docs):
    known = spark.createDataFrame([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = language.fit(known)
    rows = [(1, "the dog and the cat", "en", "com", "a.com", "w.a.com"), (2, "die katze und der hund", None, None, None, None), (3, "12345 !!", "de", "", "", ""), (4, None, None, None, None, None), (5, "漢字" * 30, "en", "com", "a.com", "w.a.com"), (1, "the dog", "de", "com", "a.com", "w.a.com")]
    got = sorted((r.id, r.lang or "") for r in language.identify(spark.createDataFrame(rows, "id bigint, text string, declared string, suffix string, domain string, host string"), model).collect())
    assert got == [(1, "en"), (1, "en"), (2, "de"), (3, ""), (4, ""), (5, "")]
    some = docs.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "spans")
    odd_ids = spark.createDataFrame([(None, "the dog and the cat"), (None, "12345"), (7, "the cat and the dog"), (7, "!!")], "doc_id bigint, text string").selectExpr("*", "'en' as lang", "null as source", "'x' as _row")
    assert sorted((r.doc_id or 0, r.text) for r in language.keep_known(odd_ids, model).collect()) == [(0, "the dog and the cat"), (7, "the cat and the dog")]
    assert language.keep_known(some, model).columns == some.columns
    assert language.identify(spark.createDataFrame(rows, "id bigint, text string, declared string, suffix string, domain string, host string").limit(0), model).count() == 0


def test_language_counts_copies_once(spark):
    r = random.Random(12)
    texts = sorted({rng_text(r, 8) for _ in range(30)})
    once = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    for copied in texts[:3]:
        many = once.unionByName(spark.createDataFrame([(copied, "en")] * 60, once.schema))
        a, b = (language.fit(d, examples=20) for d in (once, many))
        assert a.langs == b.langs and np.array_equal(a.logp, b.logp)
    full = language.fit(many, examples=1000)
    assert np.array_equal(full.logp, language.fit(once, examples=1000).logp)


def test_language_fusion_by_hand(spark, sf_dir):
    """Posteriors from the same text likelihoods, with every level's counts of the other rows added up in turn."""
    model = language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))
    r = random.Random(13)
    texts = [t for _, t in column(sf_dir, "documents", "doc_id", "text") if t][:60]
    rows = [(k, t[: r.choice([12, 20, 400])], r.choice(["en", "de", None]), "com", d := r.choice(["a.com", "b.com"]), f"{r.choice('xyz')}.{d}") for k, t in enumerate(texts)]
    got = {x.id: x for x in language.identify(spark.createDataFrame(rows, "id bigint, text string, declared string, suffix string, domain string, host string"), model).collect()}
    n, logs = len(model.langs), {}
    for k, t, *_ in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        mean, m = model.texts(raw, np.array([0, len(raw)]))
        logs[k] = mean[0] * m[0] / 5
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    p = {k: soft(v) for k, v in logs.items()}
    s = language.STRENGTH
    for k, _, said, suffix, domain, host in rows:
        of = lambda f: sum((p[x[0]] for x in rows if x[0] != k and f(x)), np.zeros(n))
        base = (of(lambda x: True) + 1) / (len(rows) - 1 + n)
        prior = base
        for f in (lambda x: x[3] == suffix, lambda x: x[4] == domain, lambda x: x[5] == host):
            c = of(f)
            prior = (c + s * prior) / (c.sum() + s)
        c = of(lambda x: x[2] == said)
        told = (c + s * base) / (c.sum() + s) / base
        post = soft(logs[k] + np.log(prior) + np.log(told))
        assert got[k].best == model.langs[int(post.argmax())] and abs(got[k].posterior - post.max()) < 2e-6


def test_markup():
    page = "<html data-x=1 LANG = 'de-AT'><script>var a = '<p>';</SCRIPT ><!-- x --><style>p</style>a&amp;b<br>c<script>never closed <b>d"
    assert language.declared_language(page) == "de" and language.visible(page).split() == ["a&b", "c", "never", "closed", "d"]
    began = __import__("time").time()
    for hostile in ("<script>" * 100_000, "<!--" * 200_000, "<html" * 100_000, "<style" * 50_000 + "<!-- -->" * 50_000):
        language.visible(hostile), language.declared_language(hostile)
    assert __import__("time").time() - began < 20


def test_repeated_passages_query(spark, sf_dir):
    out = registry.queries()["op10_suffix_dedup"](spark, sf_dir)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    rows = column(sf_dir, "documents", "doc_id", "text")
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == {i: x for (i, _), x in zip(rows, brute.removed(rows))}
