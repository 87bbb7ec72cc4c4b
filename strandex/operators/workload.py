"""Corpus vocabulary for workloads, hit-count mixes and phase reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import nearest_rank, or_zero, share
from ..functions.text import STOPWORDS, index_tokens


def document_frequency(docs: DataFrame, key: str, words) -> DataFrame:
    """term, df: documents that hold each term. Terms are made distinct in each row, so one shuffle of counts does it."""
    return docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def common_words(docs: DataFrame, text: str, least: int, shortest: int = 4) -> DataFrame:
    words = index_tokens(F.lower(text))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    found = document_frequency(docs, "", F.filter(words, lambda w: (F.length(w) >= shortest) & ~F.array_contains(stop, w)))
    return found.filter(F.col("df") >= least)


def common_pairs(docs: DataFrame, text: str, least: int) -> DataFrame:
    """Pairs of neighbouring words in at least `least` documents."""
    w = index_tokens(F.lower(text))
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return document_frequency(docs, "", pairs).filter(F.col("df") >= least)


def hit_count_mix(results: DataFrame, hits: str = "n_hits") -> DataFrame:
    """Shares of queries with 0, 1, 2 and 3 or more hits, and whether the mix is valid."""
    n = F.col(hits)
    mix = results.agg(share(n == 0).alias("zero"), share(n == 1).alias("one"), share(n == 2).alias("two"), share(n >= 3).alias("many"))
    return mix.withColumn("valid", (F.col("many") >= 0.6) & (F.col("zero") <= 0.1) & (F.col("one") <= 0.1))


def phase_report(samples: DataFrame, stage: str, value: str) -> DataFrame:
    """stage, n, p50, p95, max, queries per second."""
    return samples.groupBy(stage).agg(F.count(value).alias("n"), or_zero(nearest_rank(0.5, value)).alias("p50"), or_zero(nearest_rank(0.95, value)).alias("p95"), or_zero(F.max(value)).alias("max"), F.round(F.count(value) * 1000.0 / F.sum(value), 6).alias("per_second"))
