"""The corpus pipeline: language ID, quality rules, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns the columns of documents; the last returns the bins. `run` writes each stage's
rows as Parquet in the shared folder and rereads them. What exchanges texts with Python is
written within the stage, in small batches, so whoever writes a stage's rows needs no more
memory for it.

A doc_id names a document: rows that repeat one share its fate, and go if one of them goes.
Rows with a null doc_id stay. Null and empty texts have no letters, so they go in the first
stage unless their doc_id is null. Further columns are kept up to the last stage. An empty
table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm import langid, minhash, packing, pii, quality
from strandex.llm.storage import written

#: Below this share of letters whose gram its language knows, a text is in no learned language.
LEAST_SCORE = 0.25
#: No SQL for trained filters and packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is among keys, with the columns of docs; rows with a null doc_id stay."""
    named = keys.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(named, F.col("doc_id") == F.col("_gone"), "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in a language that is not learned, go."""
    found = written(langid.predict(docs, langid.learn(docs)), "languages")
    return _only(docs, found.filter((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < LEAST_SCORE)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or a rule whose cutoff the labels allow, go."""
    verdicts = quality.quality_verdicts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _only(docs, verdicts.filter("NOT kept"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays: the one with the smallest doc_id."""
    return _only(docs, minhash.near_duplicates(docs, size=5, percent=80).filter("NOT kept"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose them are replaced; n_chars follows the text."""
    clean = written(pii.sanitise_documents(docs), "clean-documents")
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 tokens without two documents of a source or of a duplicate cluster."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("personal_data", privacy_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
