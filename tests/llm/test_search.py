"""Source divergence, license scans and lexical search against plain versions, on rows with nulls, ties, repeats and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from flockwise.llm import divergence, lexical, license_rules, licenses

CLASH = "k m p q n v c x y a b item term value part rank tagged low base".split()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda Mu nu Xi ÉTÉ 日本 tau2 upsilon".split()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = [(k, " ".join(r.choice(WORDS[: 4 + k % 14]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "é", None])) for k in range(90)]
    out += [out[3], out[3], (4, None, "en", "only"), (5, "", "fr", "x"), (6, "alone", "fr", "y"), (None, "alpha beta", "en", "a"), (7, " ".join(["alpha beta"] * 20000), "en", "b"), (8, "1 2 3", "nl", "z")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", *[f"'x' as {c}" for c in CLASH])


def divergences(rows, least=3, top=200):
    rows = [(t or "", g or "", s or "") for _, t, g, s in rows]
    terms = [Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOW))) for t, _, _ in rows]
    df = Counter((g, t) for (_, g, _), c in zip(rows, terms) for t in c)
    count, groups = defaultdict(Counter), {(g, s) for _, g, s in rows}
    for (_, g, s), c in zip(rows, terms):
        for t, n in c.items():
            if df[g, t] >= least:
                count[g, s][t] += n
                count[g, None][t] += n
    kept = {g: [t for (h, t), n in df.items() if h == g and n >= least] for g, _ in groups}
    p = {(g, s): {t: 1 + 10**9 * (count[g, s][t] + 1) // (sum(count[g, s].values()) + len(kept[g])) for t in kept[g]} for g, s in groups | {(g, None) for g, _ in groups}}
    f = lambda a, b: (a - b) ** 2 // b
    out = set()
    for g, s in groups:
        pairs = [(-sum(f(p[g, s][t], p[g, o][t]) for t in kept[g]), o.encode(), o) for h, o in groups if h == g and o != s]
        best = [(-f(p[g, s][t], p[g, None][t]), t.encode(), t) for t in kept[g] if count[g, s][t] and p[g, s][t] > p[g, None][t]]
        out |= {(g, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)}
        out |= {(g, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(best)[:top], 1)}
    return out


@pytest.mark.parametrize("top", [200, 2])
def test_divergence(docs, rows, top, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 500)
    monkeypatch.setattr(divergence, "HELD", 20)
    got = divergence.audit(docs, top=top).collect()
    assert {tuple(r) for r in got} == divergences(rows, top=top) and len(got) == len(divergences(rows, top=top))
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_of_counts_beyond_64_bits(spark):
    """Ten thousand million occurrences: 10^9 times as many pass 64 bits."""
    from pyspark.sql import functions as F

    got = spark.range(1).select(divergence.share(F.lit(10**10), F.lit(3 * 10**10), F.lit(7)).alias("p")).first().p
    assert got == 1 + 10**9 * (10**10 + 1) // (3 * 10**10 + 7)


LICENSES = [
    (1, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache", "apache,apache-2.0"),
    (2, "This work is licensed under the GNU General Public License, version 3", "gpl", "gpl,gpl-3.0,unknown-license"),
    (3, "// SPDX-License-Identifier: MIT\nint main() {}", "", "mit"),
    (4, "Released under the MIT License", "mit", "mit,unknown-license"),
    (5, "Licensed under CC BY-NC 4.0", "", "cc-by-nc-4.0"),
    (6, "an amit license plate, general public\nlicense", "gpl", "gpl"),
    (7, None, "", ""),
    (8, "", "", ""),
    (9, "no terms here, only words", "", ""),
    (10, "MIT licensE " * 30000, "mit", "mit"),
    (11, "see http://www.apache.org/licenses/LICENSE-2.0 and GPLv2 or later", "", "apache-2.0,gpl-2.0-or-later"),
    (12, "GNU Lesser General Public License v2.1", "gpl", "gpl,lgpl-2.1"),
    (13, "public domain? into the public domain", "", "public-domain"),
]


def test_licenses(spark):
    d = spark.createDataFrame([(k, t) for k, t, _, _ in LICENSES] + [(1, "x")], "doc_id bigint, text string").selectExpr("*", *[f"'x' as {c}" for c in CLASH])
    got = licenses.scan(d).collect()
    assert len(got) == len(LICENSES) + 1 and licenses.scan(d.limit(0)).count() == 0
    of = {r.doc_id: r for r in got if r.n_words != 1}
    for k, text, base, labels in LICENSES:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        places = sorted(i for p in licenses.PHRASES for i in range(len(words)) if words[i : i + p.count(" ") + 1] == p.split())
        r = of[k]
        assert (r.n_words, r.places) == (len(words), places), k
        assert ",".join(sorted(r.base_labels)) == base and ",".join(sorted({x.label for x in r.labels} | set(r.base_labels))) == labels, (k, r.labels)


def test_rules_are_told_apart():
    r = license_rules.rules()
    assert len(r) > 300 and len({x[5] for x in r}) == len(r)
    for _, tier, label, gate, key, pattern in r:
        assert tier in license_rules.CONFIDENCE and re.compile(licenses.tagged_pattern(pattern)) and label and gate and key
    tag = licenses.tagged_pattern("gpl ?v?3(?: 0)?")
    assert [bool(re.fullmatch(tag, " " + " ".join(f"{w}#{i}" for i, w in enumerate(s.split())))) for s in ("gpl v3", "gplv3", "gpl 3 0", "gpl3 1")] == [True, True, True, False]


def ranked(rows, items, top=50):
    terms = [Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(LOW))) for r in rows]
    size = [sum(c.values()) for c in terms]
    n, words = sum(s > 0 for s in size), sum(size)
    df = Counter(t for c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, *_), c, s in zip(rows, terms, size):
            m = 50 + 50 * s * n // words if words else 0
            q = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW)))
            total = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in q if c[t])
            if total > 0:
                scores.append((-total, doc is None, doc or 0, doc))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:top], 1)]
    return out


@pytest.mark.parametrize("leaf,group,block,first", [(64, 4096, 20000, 8), (4, 32, 10, 1), (1, 7, 1, 2)])
def test_search(spark, docs, rows, monkeypatch, leaf, group, block, first):
    monkeypatch.setattr(lexical, "GROUP", group)
    items = [(1, "Alpha mu xi"), (2, None), (3, ""), (4, "nothing of it"), (1, "日本 ÉTÉ tau2"), (None, "beta beta beta"), (9, "upsilon")]
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'x' as rank", "1 as score")
    got = lexical.search(docs, b, leaf=leaf, block=block, first=first, top=5).collect()
    assert Counter(map(tuple, got)) == Counter(ranked(rows, items, 5))
    assert lexical.search(docs.limit(0), b).count() == 0 and lexical.search(docs, b.limit(0)).count() == 0


def test_bisection_brings_kinds_together():
    """Four kinds of documents, shuffled: leaves come out pure."""
    rng = np.random.default_rng(5)
    kind = rng.integers(0, 4, 512)
    doc = np.repeat(np.arange(512), 20)
    term = kind[doc] * 50 + rng.integers(0, 50, len(doc))
    key = np.unique(doc * 1000 + term)
    order = lexical.bisected(key // 1000, key % 1000, 512, 32)
    assert sorted(order) == list(range(512))
    pure = [np.bincount(kind[order[i : i + 32]]).max() / 32 for i in range(0, 512, 32)]
    assert np.mean(pure) > 0.9


def test_many_rows_of_one_turn(spark):
    """32,000 rows without a turn take no more than a few times as long as with turns of their own, and give the same texts."""
    import time

    from pyspark.sql import functions as F

    from flockwise.llm import chat

    took, out = [], []
    for turn in ("id", "cast(null as bigint)"):
        rows = spark.range(32_000).selectExpr("1L as conv_id", f"{turn} as turn", "id as seq", "'message' as event", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text ', id) as text")
        for _ in range(2):  # the first one compiles
            began = time.time()
            out.append(chat.format_chats(rows).select(F.md5("formatted").alias("f"), F.size("loss_spans").alias("n")).first())
        took.append(time.time() - began)
    assert len(set(out)) == 1 and out[0].n == 16_000
    assert took[1] < 3 * took[0] + 2, took


def test_deltas_edits_and_regenerations(spark):
    from flockwise.llm import chat

    r = random.Random(9)
    rows, want = [], {}
    for conv in range(30):
        done = []
        for turn in range(r.randint(1, 6)):
            for seq in range(r.randint(1, 7)):
                event, text = r.choice(["message", "delta", "delta", "edit", "regenerate"]), r.choice(["a", "<|im_end|>", "b\\", ""])
                rows.append((conv, turn, seq, event, "assistant" if turn % 2 else "user", text))
                if event == "message" or not done or done[-1][0] != turn:
                    done.append([turn, rows[-1][4], "" if event == "regenerate" else text])
                elif event in ("edit", "regenerate"):
                    done[-1][2] = text if event == "edit" else ""
                else:
                    done[-1][2] += text
        want[conv] = [(x[1], x[2]) for x in done]
    d = spark.createDataFrame(rows, "conv_id long, turn long, seq long, event string, role string, text string")
    chats = chat.loss_text(chat.format_chats(d, block_turns=2))
    for row in chats.select("conv_id", chat.parse_chats(chats.formatted).alias("turns"), "loss").collect():
        assert [tuple(t) for t in row.turns] == want[row.conv_id] and row.loss == "".join(t for role, t in want[row.conv_id] if role == "assistant")


def test_language_query_on_planted_pages(spark, sf_dir, tmp_path):
    """The registered query, over pages whose language, declaration and host are known: texts decide, odd pages are rejected."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from flockwise.llm import registry

    docs = pq.read_table(f"{sf_dir}/documents.parquet")
    pq.write_table(docs, tmp_path / "documents.parquet")
    pages, want = [], {}
    for lang in ("en", "de", "fr", "es"):
        texts = [t for t, x in zip(docs["text"].to_pylist(), docs["lang"].to_pylist()) if x == lang and t and 400 < len(t) < 3000][:12]
        for k, text in enumerate(texts):
            said = lang if k % 3 else "xx"
            body = f"<!doctype html><HTML Lang='{said}-A1'><script>var a = '<p>';</script><!-- la la --><p>{text.replace('&', '&amp;').replace('<', '&lt;')}</p></html>"
            pages.append((len(pages), f"https://www.Site{k % 2}.example.{lang}/p?q=1#x", body))
            want[pages[-1][0]] = (lang, said, f"www.site{k % 2}.example.{lang}")
    odd = [(900, "http://a.de/x", None), (901, None, ""), (902, "nonsense", "<html lang=de><p>1234 5678</p>"), (None, "http://a.de/y", pages[13][2]), (903, "http://b.fr", "<p>" + "zqxj wvkq xzjq " * 200)]
    names = ["page_id", "url", "html"]
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*(pages + odd))))), schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])), tmp_path / "pages.parquet")
    got = registry.queries()["op3_language_id"](spark, f"file://{tmp_path}").collect()
    of = {r.page_id: r for r in got}
    assert len(got) == len(pages) + len(odd)
    assert [i for i, (lang, said, host) in want.items() if (of[i].lang, of[i].text_lang, of[i].declared, of[i].host) != (lang, lang, said, host)] == []
    assert all(of[i].lang is None for i in (900, 901, 902, 903)) and of[None].lang == want[13][0]
    assert all(0 <= r.posterior <= 1 for r in got)


def test_index_is_held_in_small_row_groups(spark, monkeypatch):
    """A task that writes or reads the index holds a row group of it, whatever its file or split has: few clusters, few bytes."""
    import pyarrow.parquet as pq

    kept, forget = [], lexical.forget
    write = lexical.materialize
    monkeypatch.setattr(lexical, "materialize", lambda *a, **how: kept.append(write(*a, **how)) or kept[-1])
    monkeypatch.setattr(lexical, "forget", lambda df: None)
    texts = spark.range(0, 1500, 1, 1).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 1500), x -> concat('w', (x * 7919 + id * 31) % 100003))) as text")
    some = spark.createDataFrame([(1, "w1 w31 w7919 w15838")], "item_id bigint, text string")
    assert lexical.search(texts, some, leaf=4).count() > 0
    index, part = kept[:2]
    for df, rows in ((index, 375), (part, 1)):
        groups = [m.row_group(k) for f in df.inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for k in range(m.num_row_groups)]
        assert sum(g.num_rows for g in groups) >= rows and max(g.num_rows for g in groups) <= 64 and max(g.total_byte_size for g in groups) < 16 << 20
    for df in kept:
        forget(df)
