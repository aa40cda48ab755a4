"""The opN queries: each applies one operator of this subpackage to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstrata.llm import bpe, credentials, extract, langid, mixing, multiset_hash, nbsvm, pii, repetition, simhash
from quillstrata.llm.common import spread, table

Query = Callable[[SparkSession, str], DataFrame]

BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bpe.encode_documents(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, source IS NULL AS s_null, coalesce(source, '') AS s,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
per AS (
  SELECT s_null, s, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY s_null, s) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM sized GROUP BY s_null, s),
lv AS (
  SELECT *, source_size * 2.0::DOUBLE AS lim,
         (sum(source_size) OVER () * 1.5::DOUBLE
           - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / w, s_null, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, s_null, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS lev
  FROM per),
cut AS (SELECT lev AS reached FROM lv WHERE lim > lev * w ORDER BY lim / w, s_null, s LIMIT 1),
tgt AS (
  SELECT s_null, s, source_size,
         CASE WHEN (SELECT count(*) FROM cut) = 0 THEN lim ELSE least(lim, (SELECT reached FROM cut) * w) END AS target
  FROM lv),
placed AS (
  SELECT z.doc_id, z.size, t.source_size, t.target,
         row_number() OVER (PARTITION BY z.s_null, z.s ORDER BY
           CASE WHEN size < 16 THEN size
                ELSE (len(bin(size)) - 1) * 16 + ((size * 16) >> (len(bin(size)) - 1)) END,
           substr(h, 1, 3), h, doc_id, size) AS k
  FROM sized z JOIN tgt t ON z.s_null = t.s_null AND z.s = t.s),
off AS (SELECT ('0x' || substr(md5('mix-42'), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM placed)
SELECT doc_id, size, source_size, target,
       size * (floor(u + rate * k) - floor(u + rate * (k - 1)))::BIGINT AS taken
FROM rated CROSS JOIN off
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_report(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.compare_with_next(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return langid.identify(docs, langid.fit(langid.sample(docs)))


def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return nbsvm.classify(docs, nbsvm.fit(nbsvm.sample(docs, table(spark, sf_dir, "labels"))))


def op5_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_secrets(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_simhash_pivots": op1_simhash_pivots,
    "op2_quality_nbsvm": op2_quality_nbsvm,
    "op3_personal_data": op3_personal_data,
    "op4_main_text": op4_main_text,
    "op5_linked_secrets": op5_linked_secrets,
    "op6_mix_sources": op6_mix_sources,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_multiset_fingerprint": op9_multiset_fingerprint,
    "op10_language": op10_language,
}

ORACLE_SQL: dict[str, str] = {
    "op6_mix_sources": OP6_SQL,
}
