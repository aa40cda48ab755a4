"""A pipeline over documents: quality rules, near-duplicate removal, secret redaction, mixing, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstrata.llm import stages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = stages.STAGES

#: Byte-level BPE can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again by the next."""
    return stages.run_stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, STAGES)
