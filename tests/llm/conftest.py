from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, _h bigint, _doc string, size bigint, spans string, score double, fp bigint, _bucket int"


@pytest.fixture
def table(spark):
    """A documents table with columns whose names operators might use for themselves."""

    def make(texts: list, ids: list | None = None, sources: list | None = None, langs: list | None = None) -> DataFrame:
        ids = list(range(len(texts))) if ids is None else ids
        rows = [
            (i, t, langs[k] if langs else "en", sources[k] if sources else "s", len(t) if t is not None else None, 1, "x", 5, "y", 0.5, 7, 3)
            for k, (i, t) in enumerate(zip(ids, texts, strict=True))
        ]
        return spark.createDataFrame(rows, SHAPE)

    return make


@pytest.fixture
def odd_texts() -> list:
    """Null, empty, blank, repeated, multilingual and long."""
    long = "".join(f"word{i} of many, " for i in range(30_000))
    return [None, "", " \t\n\r\x0b\x0c ", "one", "one", "a b", "The quick brown fox jumps over the lazy dog.\n" * 3, "Größe ÉTÉ 東京 \U0001f600 x y z", long, long + " end", "0 1 2 3"]
