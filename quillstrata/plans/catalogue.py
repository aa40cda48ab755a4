"""Registered queries: name → (spark, sf_dir) → DataFrame, and the SQL each is checked against."""

from __future__ import annotations

from quillstrata.plans import code, search, stored, structure, text
from quillstrata.plans.base import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "code", "search", "stored", "structure", "text"]

FLAGSHIP = "hybrid_search"
