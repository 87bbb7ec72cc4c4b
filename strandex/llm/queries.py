"""Queries opN_<name> of this subpackage over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_store import store_digests, write_store
from .jpeg import media_features, text_media
from .langid import held_out, learn, predict
from .minhash import near_duplicates
from .packing import pack_documents
from .pii import find_personal_data
from .piece import piece_digests
from .quality import quality_verdicts
from .token_counts import token_budget
from .warc_zip import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_budget(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), budget=1024)


@query
def op8_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media_features(text_media(documents(spark, sf_dir)))
    feature = F.format_string("%dx%d:%s:%s", "width", "height", F.substring("thumb_sha256", 1, 16), "thumb_hash")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


@query
def op5_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = write_store(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return store_digests(spark, store)


@query
def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op6_warc_zip"] = """
WITH own AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT page_id, payload_bytes, hex,
    list_aggregate(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', hex[i])]), 'string_agg', '') AS b
  FROM own),
named AS (
  SELECT page_id, payload_bytes, hex,
    list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
      1 + 16 * (b[5 * i + 1])::INT + 8 * (b[5 * i + 2])::INT + 4 * (b[5 * i + 3])::INT + 2 * (b[5 * i + 4])::INT + (b[5 * i + 5])::INT]), 'string_agg', '') AS payload_digest
  FROM bits)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = min(page_id) OVER (PARTITION BY hex) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = min(page_id) OVER (PARTITION BY hex) THEN NULL ELSE min(page_id) OVER (PARTITION BY hex) END AS refers_to
FROM named"""


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality_verdicts(documents(spark, sf_dir), labels, risk=0.02, level=0.05)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal_data(documents(spark, sf_dir))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=2, percent=80)


ORACLES["op7_minhash"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
classes AS (SELECT list_sort(s) AS c, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY ALL),
items AS (SELECT rep, len(c) AS n, unnest(c) AS x FROM classes),
shared AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS node, rep AS root FROM classes UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(roots.root, sets.doc_id) AS component_id, sets.doc_id = coalesce(roots.root, sets.doc_id) AS kept
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.c LEFT JOIN roots ON roots.node = classes.rep"""


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)
