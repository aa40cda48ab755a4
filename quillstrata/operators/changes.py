"""What changed between two manifests of a collection, and keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_feed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, path, status, old_path) from manifests (repo, path, hash): A, D, M, and R for a path that left while another
    of the same content came, where both are the only ones of that content."""
    o, n = (x.select("repo", "path", F.col("hash").alias(h)) for x, h in ((old, "oh"), (new, "nh")))
    both = o.join(n, ["repo", "path"], "full_outer")
    status = F.when(F.col("oh").isNull(), "A").when(F.col("nh").isNull(), "D").when(F.col("oh") != F.col("nh"), "M")
    raw = both.select("repo", "path", status.alias("status"), F.coalesce("nh", "oh").alias("hash")).where("status IS NOT NULL")
    # one aggregation by content tells the moves: two numbers and two paths of each, however many paths have it
    n_of = lambda s: F.count_if(F.col("status") == s)
    path_of = lambda s: F.min(F.when(F.col("status") == s, F.col("path")))
    pairs = raw.where("status <> 'M'").groupBy("repo", "hash").agg(n_of("A").alias("a"), n_of("D").alias("d"), path_of("A").alias("to"), path_of("D").alias("from"))
    pairs = pairs.where("a = 1 AND d = 1").select("repo", F.col("hash").alias("hash"), "to", "from")
    joined = raw.join(pairs, ["repo", "hash"], "left")
    moved = F.col("to").isNotNull() & (F.col("status") != "M")
    kept = joined.where(~(moved & (F.col("status") == "D")))
    return kept.select("repo", "path", F.when(moved, "R").otherwise(F.col("status")).alias("status"), F.when(moved, F.col("from")).alias("old_path"))


def change_counts(feed: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).cast("bigint").alias(n) for s, n in (("A", "added"), ("M", "modified"), ("D", "deleted"), ("R", "renamed"))]
    return feed.agg(*counts)


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """``new`` over ``old``: rows of ``old`` whose key is not in ``new``, and all of ``new``."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def without_stale_files(chunks: DataFrame, current: DataFrame) -> DataFrame:
    """Chunks of files (repo, file) that are still there."""
    return chunks.join(current.select("repo", "file").distinct(), ["repo", "file"], "left_semi")


def without_stale_chunks(chunks: DataFrame, modified: DataFrame, valid: DataFrame) -> DataFrame:
    """Chunks but those of the modified files (repo, file) whose id is not among the valid ones (file, id)."""
    touched = chunks.join(modified.select("repo", "file").distinct(), ["repo", "file"], "left_semi")
    stale = touched.join(valid.select("file", "id"), ["file", "id"], "left_anti").select("id")
    return chunks.join(stale, "id", "left_anti")
