"""Symbols: tiered matching, listing, and looking one up in a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLACE = ("repo", "file", "start_line")


def symbol_tiers(chunks: DataFrame, name: str, repo: str | None = None, file: str | None = None) -> DataFrame:
    """Chunks whose symbol is ``name`` (score 1), ends in ``.name`` (0.8) or contains it (0.5). One scan for all tiers;
    matching is literal and case-sensitive."""
    symbol = F.col("symbol_name")
    if repo is not None:
        chunks = chunks.where(F.col("repo") == repo)
    if file is not None:
        chunks = chunks.where(F.col("file") == file)
    score = F.when(symbol == name, 1.0).when(symbol.endswith("." + name), 0.8).when(symbol.contains(name), 0.5)
    return chunks.where(symbol.contains(name)).withColumn("score", score)


def symbol_search(chunks: DataFrame, name: str, repo: str | None = None, file: str | None = None, limit: int = 10) -> DataFrame:
    """The best ``limit`` matches, one for each place."""
    found = symbol_tiers(chunks, name, repo, file)
    first = F.row_number().over(W.partitionBy(*PLACE).orderBy(F.desc("score"), "symbol_name", "end_line"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n").orderBy(F.desc("score"), *PLACE).limit(limit)


def list_symbols(chunks: DataFrame, query: str | None = None, repo: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunks that have a symbol, by repo, file and line; ``query`` is a part of the name."""
    found = chunks.where(F.col("symbol_name") != "")
    for column, value in (("repo", repo), ("chunk_type", kind)):
        if value:
            found = found.where(F.col(column) == value)
    if query:
        found = found.where(F.col("symbol_name").contains(query))
    found = found.select("repo", "file", "symbol_name", "chunk_type", "signature", "start_line", "end_line", "language", "parent_symbol")
    return found if limit is None else found.orderBy(*PLACE, "symbol_name").limit(limit)


def resolve_symbol(chunks: DataFrame, symbol: str, repo: str, file: str) -> DataFrame:
    """The best row for a symbol named in a file, with column ``source``; no row if there is none.

    In this order: the last part of a dotted name in the file, if its parent goes with the rest; the name in the file;
    the name in files of the repo whose path ends in ``file``.
    """
    own = chunks.where(F.col("repo") == repo)
    in_file = F.col("file") == file
    sets = []
    if "." in symbol:
        rest, _, last = symbol.rpartition(".")
        parent = F.when(F.col("parent_symbol") != "", F.col("parent_symbol")).otherwise(F.col("symbol_name"))
        sets.append(("file_scoped_dotted", symbol_tiers(own.where(in_file & parent.contains(rest)), last)))
    sets.append(("file_scoped", symbol_tiers(own.where(in_file), symbol)))
    sets.append(("global_fallback", symbol_tiers(own.where(in_file | F.col("file").endswith("/" + file)), symbol)))
    every = None
    for k, (source, rows) in enumerate(sets):
        rows = rows.withColumns({"source": F.lit(source), "_set": F.lit(k)})
        every = rows if every is None else every.unionByName(rows)
    return every.orderBy("_set", F.desc("score"), *PLACE).limit(1).drop("_set")


def suggestions(chunks: DataFrame, repo: str, file: str, limit: int = 8) -> DataFrame:
    """The first symbols of a file, for a message that says what there is."""
    return list_symbols(chunks.where(F.col("file") == file), repo=repo, limit=limit).select("symbol_name")
