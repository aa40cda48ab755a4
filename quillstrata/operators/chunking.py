"""Files to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.functions import text as fn
from quillstrata.parsers import MAX_CHARS, chunk_text

_FIELDS = {
    "repo": pa.string(), "file": pa.string(), "extension": pa.string(), "language": pa.string(), "chunk_type": pa.string(),
    "symbol_name": pa.string(), "signature": pa.string(), "parent_symbol": pa.string(), "parent_signature": pa.string(),
    "text": pa.string(), "start_line": pa.int32(), "end_line": pa.int32(), "chunk_index": pa.int32(),
}
_SCHEMA = ", ".join(f"{k} {'string' if v == pa.string() else 'int'}" for k, v in _FIELDS.items())

#: Characters and rows after which a task hands its chunks on.
BATCH_CHARS, BATCH_ROWS = 1 << 20, 4096


def dealt(df: DataFrame) -> DataFrame:
    """Spread over the cores when a table has fewer input files than there are; larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _chunked(batches: Iterator[pa.RecordBatch], *how: int) -> Iterator[pa.RecordBatch]:
    """One file at a time, as a batch as a whole is large; chunks are handed on in small batches, whatever the files' sizes."""
    schema = pa.schema(list(_FIELDS.items()))
    rows: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        columns = [batch.column(c) for c in ("repo", "file", "extension", "text")]
        for i in range(batch.num_rows):
            repo, file, extension, text = (c[i].as_py() for c in columns)
            for k, c in enumerate(chunk_text(text or "", extension, *how)):
                rows.append((repo, file, extension, c.language, c.chunk_type, c.symbol_name, c.signature, c.parent_symbol, c.parent_signature, c.text, c.start_line, c.end_line, k))
                size += len(c.text)
                if size > BATCH_CHARS or len(rows) >= BATCH_ROWS:
                    yield made()
                    rows, size = [], 0
    if rows:
        yield made()


def chunk_files(files: DataFrame, max_chars: int = MAX_CHARS, window: int = 80, overlap: int = 20) -> DataFrame:
    """The chunk table's columns but ``vector`` for files (repo, file, text); the extension is that of the path.

    Files are independent, so nothing is shuffled. Blank files have no chunk; null texts are blank.
    """
    named = files.select("repo", "file", fn.extension_of(F.col("file")).alias("extension"), "text")
    found = named.mapInArrow(lambda batches: _chunked(batches, max_chars, window, overlap), _SCHEMA)
    return found.withColumns({
        "file_name": fn.base_name(F.col("file")),
        "id": fn.chunk_id(F.col("repo"), F.col("file"), F.col("symbol_name"), F.col("chunk_type"), F.col("chunk_index")),
    })
