"""History from git, as rows. Commands run on the driver; what they print is parsed by Spark."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: sha, author, ISO date and subject, separated by NUL.
FORMAT = "%H%x00%an%x00%aI%x00%s"


def _run(root: str, *arguments: str, given: bytes = b"", timeout: int = 30) -> bytes | None:
    try:
        done = subprocess.run(["git", *arguments], cwd=root, input=given, capture_output=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired, ValueError):
        return None
    return done.stdout if done.returncode == 0 else None


def _git(root: str, *arguments: str, timeout: int = 30) -> str | None:
    out = _run(root, *arguments, timeout=timeout)
    return None if out is None else out.decode("utf-8", "replace")


@dataclass(frozen=True)
class Head:
    sha: str
    branch: str


def head(root: str) -> Head | None:
    sha, branch = _git(root, "rev-parse", "HEAD"), _git(root, "rev-parse", "--abbrev-ref", "HEAD")
    return Head(sha.strip(), branch.strip()) if sha and branch is not None else None


def parse_log(lines: DataFrame) -> DataFrame:
    """(sha, author, date, message) from log lines in FORMAT in column ``value``; lines of fewer fields are passed over."""
    parts = lines.select(F.split("value", "\0", 4).alias("p")).where(F.size("p") == 4)
    return parts.select(*(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("sha", "author", "date", "message"))))


def parse_name_status(lines: DataFrame) -> DataFrame:
    """(status, path, old_path) from tab-separated lines of a name-status diff in column ``value``: a rename is R with its
    old path, a copy counts as an addition, a change of type as a modification; other lines are passed over."""
    p = F.split("value", "\t")
    kind = F.substring(F.get(p, F.lit(0)), 1, 1)
    one, two = F.get(p, F.lit(1)), F.get(p, F.lit(2))
    moved = kind.isin("R", "C")
    rows = lines.where(F.size(p) > F.when(moved, 2).otherwise(1))
    status = F.when(kind == "C", "A").when(kind == "T", "M").otherwise(kind)
    return rows.where(kind.isin("A", "M", "D", "R", "C", "T")).select(status.alias("status"), F.when(moved, two).otherwise(one).alias("path"), F.when(kind == "R", one).alias("old_path"))


def _rows(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in text.splitlines() if x], "value string")


def file_history(spark: SparkSession, root: str, file: str, since: str | None = None, limit: int = 20) -> DataFrame | None:
    """Commits of a file across renames; None where git can't say."""
    options = [f"--since={since}"] if since else []
    text = _git(root, "log", "--follow", f"--format={FORMAT}", f"-{limit}", *options, "--", file)
    return None if text is None else parse_log(_rows(spark, text))


def pickaxe_log(spark: SparkSession, root: str, word: str, since: str | None = None, limit: int = 20) -> DataFrame:
    """Commits that change how often a word occurs."""
    options = [f"--since={since}"] if since else []
    return parse_log(_rows(spark, _git(root, "log", f"-S{word}", f"--format={FORMAT}", f"-{limit}", *options, "--") or ""))


def changed_files(spark: SparkSession, root: str, old: str, new: str) -> DataFrame | None:
    """The change feed between two commits; None if the old one is not known any more."""
    if _git(root, "rev-parse", "--verify", "--end-of-options", f"{old}^{{commit}}") is None:
        return None
    text = _git(root, "diff", "--name-status", f"{old}..{new}")
    return None if text is None else parse_name_status(_rows(spark, text))


def contents_at(root: str, wanted: list[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """Contents of files (sha, path) that are there, from one git process."""
    named = [w for w in wanted if "\n" not in w[1]]
    out = _run(root, "cat-file", "--batch", given="".join(f"{sha}:{path}\n" for sha, path in named).encode()) or b""
    found, at = {}, 0
    for key in named:
        end = out.find(b"\n", at)
        if end < 0:
            break
        head = out[at:end].rsplit(b" ", 2)
        at = end + 1
        if len(head) == 3 and head[1] == b"blob":
            size = int(head[2])
            found[key] = out[at : at + size].decode("utf-8", "replace")
            at += size + 1
        elif len(head) == 3 and head[2].isdigit():
            at += int(head[2]) + 1
    return found


def parents_of(root: str, shas: list[str]) -> dict[str, str]:
    """The first parent of each commit that has one, from one git process."""
    lines = (_git(root, "rev-list", "--no-walk=unsorted", "--parents", "--end-of-options", *shas) or "").splitlines() if shas else []
    return {p[0]: p[1] for p in map(str.split, lines) if len(p) > 1}


def content_at(root: str, sha: str, file: str) -> str | None:
    return contents_at(root, [(sha, file)]).get((sha, file))


def parent_of(root: str, sha: str) -> str | None:
    return next(iter(parents_of(root, [sha]).values()), None)
