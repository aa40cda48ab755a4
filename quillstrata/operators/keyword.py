"""Keyword search over lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directories and lock files that no search looks into.
SKIP_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "env", "vendor", "dist", "build", ".next", ".nuxt",
    "target", ".idea", ".vscode", ".cursor", "coverage", ".tox", "egg-info", ".server", ".cache", ".npm", ".yarn",
    "site-packages", "lib", "lib64",
)
SKIP_FILENAMES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock")


def _quoted(word: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "_/" else c for c in word)


def excluded(path: Column, dirs: Iterable[str] = SKIP_DIRS, names: Iterable[str] = SKIP_FILENAMES) -> Column:
    """Whether a path lies in one of the directories or ends in one of the file names."""
    inside = "(^|/)(" + "|".join(map(_quoted, dirs)) + ")/"
    named = "(^|/)(" + "|".join(map(_quoted, names)) + ")$"
    return path.rlike(inside) | path.rlike(named)


def keyword_lines(files: DataFrame, query: str, regex: bool = False, repo: str | None = None, max_columns: int | None = None, skip: bool = False) -> DataFrame:
    """(repo, file, line, text) of each line of ``files`` (repo, file, text) that contains the query.

    A cheap test of the whole text goes first, so only files with a hit are taken apart. ``max_columns`` leaves out longer
    lines; ``skip`` leaves out the directories and files that ``excluded`` names.
    """
    if not query:
        return files.select("repo", "file", F.lit(0).cast("bigint").alias("line"), "text").limit(0)
    if repo is not None:
        files = files.where(F.col("repo") == repo)
    if skip:
        files = files.where(~excluded(F.col("file")))
    hit = (lambda c: c.rlike(query)) if regex else (lambda c: c.contains(query))
    if not regex and "\n" not in query:
        files = files.where(hit(F.col("text")))
    found = files.select("repo", "file", F.posexplode(F.split("text", "\n", -1)).alias("at", "text")).where(hit(F.col("text")))
    found = found.select("repo", "file", (F.col("at") + 1).cast("bigint").alias("line"), F.regexp_replace("text", r"\r\z", "").alias("text"))
    return found if max_columns is None else found.where(F.octet_length("text") <= max_columns)


def keyword_search(files: DataFrame, query: str, limit: int = 50, **how) -> DataFrame:
    """The first ``limit`` hits by repo, file and line: the same ones on every run."""
    return keyword_lines(files, query, **how).orderBy("repo", "file", "line").limit(max(0, limit))


def scanner_events(events: DataFrame, roots: dict[str, str] | None = None) -> DataFrame:
    """(repo, file, line, text) from a line scanner's JSON events, one a row in column ``value``.

    Only well-formed events of type "match" count. ``roots`` names each repo's root directory.
    """
    from quillstrata.operators.structure import split_path

    shape = "struct<type: string, data: struct<path: struct<text: string>, lines: struct<text: string>, line_number: bigint>>"
    parsed = events.select(F.from_json("value", shape, {"mode": "PERMISSIVE"}).alias("e")).where(F.col("e.type") == "match")
    hits = parsed.select(F.col("e.data.path.text").alias("path"), F.col("e.data.line_number").alias("line"), F.regexp_replace("e.data.lines.text", r"\s+\z", "").alias("text"))
    repo, file = split_path(F.col("path"), roots or {})
    return hits.where(F.col("path").isNotNull() & F.col("line").isNotNull()).select(repo.alias("repo"), file.alias("file"), "line", "text")
