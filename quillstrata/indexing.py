"""Indexing: files of a repo to the chunk table, in full or by what changed since the last time."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.catalog import Catalog
from quillstrata.config import IGNORE_FILE, Repo
from quillstrata.operators.chunking import chunk_files, dealt
from quillstrata.operators.embedding import Backend, embed_chunks
from quillstrata.sources import git
from quillstrata.sources.files import ignore_patterns, read_files
from quillstrata.store import ChunkStore


@dataclass(frozen=True)
class IndexResult:
    repo: str
    mode: str  # full, incremental, skipped, error
    chunks: int
    message: str


def decision(full: Column, pending: Column, stored_sha: Column, stored_branch: Column, sha: Column, branch: Column) -> Column:
    """How a repo is indexed: in full if asked to, after an interruption, at first, on another branch or without git
    (null sha); not at all if nothing moved; else by its changes."""
    return (
        F.when(full, "full: forced")
        .when(pending, "full: pending")
        .when(stored_sha.isNull() | (stored_sha == ""), "full: first index")
        .when(sha.isNull(), "full: no git status")
        .when((stored_branch != "") & (stored_branch != branch), "full: branch changed")
        .when(stored_sha == sha, "skipped: up to date")
        .otherwise("incremental")
    )


def decide(full: bool, pending: bool, stored: dict, head: git.Head | None) -> str:
    """The same for one repo, on the driver."""
    if full or pending or not stored["sha"] or head is None:
        return "full: " + ("forced" if full else "pending" if pending else "first index" if not stored["sha"] else "no git status")
    if stored["branch"] and stored["branch"] != head.branch:
        return "full: branch changed"
    return "skipped: up to date" if stored["sha"] == head.sha else "incremental"


def changed_content(results: Iterable[IndexResult]) -> bool:
    return any(r.mode in ("full", "incremental") for r in results)


def _embedded(spark: SparkSession, name: str, root: str, backend: Backend, paths: list[str] | None = None) -> DataFrame:
    files = read_files(spark, name, root, paths, ignore_patterns(root, IGNORE_FILE))
    return embed_chunks(chunk_files(dealt(files) if paths is None else files), backend)


def index_full(spark: SparkSession, store: ChunkStore, catalog: Catalog, name: str, root: str, backend: Backend, head: git.Head | None, profile: str) -> IndexResult:
    """The repo's part of the table is written anew and swapped in; an error before that changes nothing."""
    sha, branch = (head.sha, head.branch) if head else ("unknown", "")
    catalog.set_meta(f"pending:{name}", sha, profile)
    store.replace([name], _embedded(spark, name, root, backend), profile)
    chunks = store.chunks(profile, name).count()
    _stamp(catalog, name, sha, branch, chunks, backend, profile)
    return IndexResult(name, "full", chunks, f"{chunks} chunks")


def _stamp(catalog: Catalog, name: str, sha: str, branch: str, chunks: int, backend: Backend, profile: str) -> None:
    with catalog.transaction():
        catalog.set_meta("embedding_model", backend.model_name(), profile)
        catalog.set_meta("embedding_dims", str(backend.dims()), profile)
        catalog.set_repo_index(name, sha, branch, chunks, profile)
        catalog.set_meta(f"pending:{name}", "", profile)


def index_changes(spark: SparkSession, store: ChunkStore, catalog: Catalog, name: str, root: str, backend: Backend, stored_sha: str, head: git.Head, profile: str) -> IndexResult | None:
    """New and changed files are embedded and put in, then what left or got stale goes. None if the old commit is gone.

    The list of changed paths comes to the driver: git has printed it there.
    """
    feed = git.changed_files(spark, root, stored_sha, head.sha)
    if feed is None:
        return None
    rows = feed.collect()
    if not rows:
        catalog.set_repo_index(name, head.sha, head.branch, catalog.get_repo_index(name, profile)["chunks"], profile)
        return IndexResult(name, "skipped", 0, "no changes")
    counts = {s: sum(r.status == s for r in rows) for s in "AMDR"}
    catalog.set_meta(f"pending:{name}", head.sha, profile)
    new = [r.path for r in rows if r.status in "AMR"]
    if new:
        store.upsert(_embedded(spark, name, root, backend, new), profile)
    gone = [r.path for r in rows if r.status == "D"] + [r.old_path for r in rows if r.status == "R"]
    if gone:
        store.delete_files(name, gone, profile)
    modified = [r.path for r in rows if r.status == "M"]
    if modified:
        touched = spark.createDataFrame([(name, p) for p in modified], "repo string, file string")
        valid = chunk_files(read_files(spark, name, root, modified, ignore_patterns(root, IGNORE_FILE))).select("file", "id")
        store.delete_stale_chunks(name, touched, valid, profile)
    total = store.chunks(profile, name).count()
    _stamp(catalog, name, head.sha, head.branch, total, backend, profile)
    return IndexResult(name, "incremental", total, "+{A} -{D} ~{M} >{R}".format(**counts))


def run_index(spark: SparkSession, store: ChunkStore, catalog: Catalog, backend: Backend, targets: list[Repo], full: bool = False, profile: str = "default", say: Callable[[str], None] = lambda m: None) -> list[IndexResult]:
    """Each repo in its own way. Search indexes are not rebuilt here."""
    results = []
    for repo in targets:
        root = repo.resolved_path()
        if not Path(root).is_dir():
            say(f"Warning: {repo.name}: no such directory: {root}")
            results.append(IndexResult(repo.name, "error", 0, f"path not found: {root}"))
            continue
        catalog.upsert_repo(repo.name, str(root))
        head, stored = git.head(str(root)), catalog.get_repo_index(repo.name, profile)
        how = decide(full, bool(catalog.get_meta(f"pending:{repo.name}", profile)), stored, head)
        if how.startswith("skipped"):
            result = IndexResult(repo.name, "skipped", 0, "up to date")
        else:
            result = index_changes(spark, store, catalog, repo.name, str(root), backend, stored["sha"], head, profile) if how == "incremental" else None
            result = result or index_full(spark, store, catalog, repo.name, str(root), backend, head, profile)
        say(f"  {repo.name}: {result.mode} ({how.partition(': ')[2] or result.message}), {result.message}")
        results.append(result)
    return results
