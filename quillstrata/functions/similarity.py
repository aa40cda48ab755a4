"""How much a text changed. Order-aware matching has no built-in twin, so this one is Python, in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def change_ratio(old: str | None, new: str | None) -> float:
    """0 for equal texts, 1 for texts that share nothing or of which one is empty."""
    old, new = old or "", new or ""
    if old == new:
        return 0.0
    return 1.0 - SequenceMatcher(None, old, new).ratio() if old and new else 1.0


def changed(old: Column, new: Column) -> Column:
    @F.arrow_udf("double")
    def run(before: pa.Array, after: pa.Array) -> pa.Array:
        return pa.array([change_ratio(a.as_py(), b.as_py()) for a, b in zip(before, after, strict=True)], pa.float64())

    return run(old, new)
