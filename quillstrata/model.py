"""The chunk table: its columns, and how files become its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_COLUMNS = ("id", "repo", "file", "file_name", "extension", "language", "chunk_type", "symbol_name", "signature", "parent_symbol", "parent_signature", "text")
LINE_COLUMNS = ("start_line", "end_line", "chunk_index")
SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in TEXT_COLUMNS] + [T.StructField(c, T.IntegerType()) for c in LINE_COLUMNS] + [T.StructField("vector", T.ArrayType(T.FloatType()))]
)
COLUMNS = tuple(f.name for f in SCHEMA.fields)
#: What a search returns for each chunk.
RESULT_COLUMNS = ("repo", "file", "start_line", "end_line", "text", "symbol_name", "chunk_type", "signature", "parent_symbol", "parent_signature", "language")
KINDS = ("function", "class", "method", "property", "preamble", "config_block", "fallback")


class StoreError(RuntimeError):
    """The chunk table can't answer, or can't take, what it is asked to."""


def conform(chunks: DataFrame) -> DataFrame:
    """All columns of the table in order. What is missing is '', 0, "fallback" or no vector: nothing but a vector is null."""
    filled = []
    for field in SCHEMA.fields:
        have = F.col(field.name) if field.name in chunks.columns else F.lit(None)
        if field.name != "vector":
            have = F.coalesce(have, F.lit("fallback" if field.name == "chunk_type" else "" if isinstance(field.dataType, T.StringType) else 0))
        filled.append(have.cast(field.dataType).alias(field.name))
    return chunks.select(*filled)


def check_dims(chunks: DataFrame, dims: int) -> None:
    """Raises StoreError if a stored vector has another length than ``dims``. Reads one row."""
    other = chunks.where(F.col("vector").isNotNull() & (F.size("vector") != dims)).select(F.size("vector").alias("n")).head()
    if other:
        raise StoreError(f"vectors of {other.n} dimensions are stored, {dims} were given; index this profile in full with one model")
