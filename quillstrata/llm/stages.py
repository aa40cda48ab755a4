"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the documents that it keeps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstrata.llm import bpe, credentials, mixing, near_copies, repetition, simhash
from quillstrata.llm.common import spread, work_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts don't. Rows that repeat one another share its fate."""
    return repetition.kept_documents(spread(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of the smallest id. Of null ids
    and of repeated rows one stays as well; null texts are empty ones."""
    return simhash.first_of_each(docs, near_copies.near_copies(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with reported secrets masked and n_chars set to the new length; null and empty texts as they are."""
    return credentials.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of a document that the sample takes; null and empty texts weigh nothing."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: doc_id, n_tokens, hashes and the ids of each document, one row per copy that the mix takes. Null and
    empty texts have no ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(spread(docs.select("doc_id", "text")), path, public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("secret_scans", secrets),
    ("mixing", mixture),
    ("byte_bpe", tokenize),
]


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run_stages(spark: SparkSession, docs: DataFrame, sf_dir: str, stages: Sequence[tuple[str, Stage]]) -> DataFrame:
    """Each stage's rows are written to the shared working folder and read back as the next one's documents.

    A stage's table is removed once the next one's is written; the last one stays, as the result reads it. Nulls, empty
    and very long texts, ties, repeated rows, empty tables and other columns are as each stage's operator has them.
    """
    folder = f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(stages):
            own = f"{folder}/{k}-{name}"
            docs.write.parquet(own)
            docs = spark.read.parquet(own)
            if before:
                _remove(spark, before)
            before = own
    return docs
