"""The history command: which files a query is about, their commits, and what those changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.operators import history
from quillstrata.operators.chunking import chunk_files
from quillstrata.operators.embedding import Backend
from quillstrata.operators.symbols import PLACE
from quillstrata.sources import git
from quillstrata.store import ChunkStore

_COMMIT = "repo string, file string, sha string, author string, date string, message string"


def _versions(spark: SparkSession, pairs: list[tuple[str, str, str | None]]) -> DataFrame:
    """Symbols of file versions (key, file, text): the key takes the repo's place."""
    rows = spark.createDataFrame([(k, f, t) for k, f, t in pairs if t is not None], "repo string, file string, text string")
    return history.last_definitions(chunk_files(rows), "repo", "file")


def build_timeline(
    spark: SparkSession, store: ChunkStore, roots: dict[str, str], query: str, since: str | None = "6 months ago", limit: int = 20,
    repo: str | None = None, symbol: str | None = None, backend: Backend | None = None, profile: str = "default",
) -> dict:
    """Entries, latest first, each with what changed by symbol; up to 20 commits are compared with their parents.

    git runs on the driver, where the repos are; contents of at most 20 commits are read.
    """
    term = symbol or query
    found: dict = {"query": query, "scoped_files": [], "scoped_symbols": [], "entries": []}
    order = [F.desc("score"), *map(F.col, PLACE)]
    results = store.search_symbol(term, repo, limit=10, profile=profile)
    scope = history.scope_files(results, order).collect()  # five rows at most
    if not scope and backend is not None:
        results = store.search_vector(backend.embed_query(term), 10, repo, profile)
        scope = history.scope_files(results, [F.col("distance"), *map(F.col, PLACE)]).collect()
    if not scope:
        return found
    found["scoped_files"] = [f"{r.repo}/{r.file}" for r in scope]
    found["scoped_symbols"] = [r.symbol_name for r in scope if r.symbol_name]
    commits = hits = spark.createDataFrame([], _COMMIT)
    for r in scope:
        own = git.file_history(spark, roots[r.repo], r.file, since, limit) if r.repo in roots else None
        if own is not None:
            commits = commits.unionByName(own.withColumns({"repo": F.lit(r.repo), "file": F.lit(r.file)}))
    for name, root in roots.items():
        if repo is None or name == repo:
            hits = hits.unionByName(git.pickaxe_log(spark, root, term, since, limit).withColumns({"repo": F.lit(name), "file": F.lit("")}))
    scoped = spark.createDataFrame([(r.repo, r.file) for r in scope], "repo string, file string")
    entries = history.timeline(commits, scoped, hits, 2 * limit).collect()
    old, new = [], []
    compared = [e for e in entries if e.file][: history.MAX_DIFFS]
    parents, contents = {}, {}
    for name in {e.repo for e in compared}:  # two git processes for each repo
        own = [e for e in compared if e.repo == name]
        up = git.parents_of(roots[name], [e.sha for e in own])
        parents |= {(name, sha): parent for sha, parent in up.items()}
        wanted = [(sha, e.file) for e in own for sha in (e.sha, up.get(e.sha)) if sha]
        contents |= {(name, *key): text for key, text in git.contents_at(roots[name], wanted).items()}
    for e in compared:
        parent = parents.get((e.repo, e.sha))
        before, after = contents.get((e.repo, parent, e.file)), contents.get((e.repo, e.sha, e.file))
        if parent and before is None and after is not None:
            continue  # the file has come from somewhere: all of it would look new
        key = f"{e.repo}\0{e.sha}"
        old.append((key, e.file, before))
        new.append((key, e.file, after))
    changed: dict[tuple[str, str], list[dict]] = {}
    if old:
        diff = history.structural_diff(_versions(spark, old), _versions(spark, new), "repo", "file")
        for c in diff.orderBy("repo", "file", "symbol_name").collect():
            one = {"symbol": c.symbol_name, "change_type": c.change_type, "significance": c.significance, "old_signature": c.old_signature, "new_signature": c.new_signature}
            changed.setdefault((c.repo, c.file), []).append(one)
    for e in entries[:limit]:
        shown = {k: e[k] for k in ("sha", "author", "date", "message", "repo", "file", "relevance")}
        found["entries"].append(shown | {"changes": changed.get((f"{e.repo}\0{e.sha}", e.file), [])})
    return found
