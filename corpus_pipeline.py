"""A corpus pipeline: language, near-duplicates, benchmark leaks, personal data, tokens. Every stage is written and read again.

Rows have a key of their own inside each stage, so null and repeated doc_ids never stand for one another's text. A null or empty text
is rejected by the first stage (it is in no language); very long texts, ties and clashing column names are as in the operators'
docstrings. An empty table gives no rows, with the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockwise.llm import decontaminate, language, minhash, pii, sentencepiece_bpe
from flockwise.llm.common import shared_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; each row is judged by its own text, declared language and source."""
    return language.keep_known(docs, language.fit(docs.select("text", "lang")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates at a similarity of 0.8: that of smallest doc_id (null last); rows without words stay."""
    return minhash.keep_one(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, each row judged by its own text."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced; n_chars follows, and is null with the text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, with begin and end; a null text as an empty one."""
    out = sentencepiece_bpe.encode_texts(docs, sentencepiece_bpe.model_bytes())
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii_removal), ("sentencepiece", tokenize)]
#: SQL can't express the stages; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
