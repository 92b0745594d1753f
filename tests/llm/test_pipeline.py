"""The pipeline against brute force on the small tables."""

import pyarrow.parquet as pq
import sentencepiece

import corpus_pipeline
from flockwise.llm import decontaminate, sentencepiece_bpe

from . import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).columns == docs.columns, name


def test_stages_on_odd_rows(spark, sf_dir):
    """Null and repeated ids, nulls in any column, exact repeats and clashing names."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' and length(text) between 300 and 900").orderBy("doc_id").limit(12)
    odd = base.selectExpr("cast(null as bigint) as doc_id", "concat(text, ' mail me at a.b@c.org') as text", "lang", "source", "n_chars").limit(1)
    docs = base.unionAll(base.limit(2)).unionAll(odd).unionAll(base.selectExpr("doc_id", "cast(null as string)", "cast(null as string)", "cast(null as string)", "cast(null as bigint)").limit(1))
    docs = docs.selectExpr("*", *[f"'x' as {c}" for c in ("_row", "d", "row", "spans", "base", "label")])
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        counts.append(docs.count())
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_row", "d", "row", "spans", "base", "label"], name
    rows = docs.collect()
    assert counts[0] == 15 and counts[1] <= 13 and not any("a.b@c.org" in r.text for r in rows) and len({r.text for r in rows}) == len(rows)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_run(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    texts = dict(zip(t["doc_id"], t["text"]))
    near = brute.near_components(texts, 80)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = {r.doc_id for r in decontaminate.contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), bench).collect()}
    items = [x.split() for x in pq.read_table(f"{sf_dir}/benchmark.parquet")["text"].to_pylist()]
    exact = {d for d, text in texts.items() if any(" ".join(i) in " ".join((text or "").split()) for i in items)}
    assert exact <= leaks
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == {d for d in texts if near[d][1] == d} - leaks  # each document is in a known language
    p = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_bpe.model_bytes())
    for d, r in got.items():
        if not brute.base_spans(texts[d]) and "token" not in texts[d].lower():
            assert r.ids == p.encode(texts[d], add_bos=True, add_eos=True)
        assert r.n_tokens == len(r.ids)


def test_near_dedup_moves_texts_once(spark, sf_dir):
    """The rows that stay are read where the stage has dealt their texts out; only keys are shuffled to them."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
