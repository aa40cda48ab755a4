"""Files as rows: listing, admission and ignore patterns."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.functions import text as fn
from quillstrata.operators.keyword import SKIP_DIRS, SKIP_FILENAMES

# What is taken up by extension or by name, and the largest size.
EXTENSIONS = (
    ".py", ".ts", ".js", ".tsx", ".jsx", ".go", ".rs", ".java", ".kt", ".c", ".cpp", ".h", ".hpp", ".rb", ".php",
    ".cs", ".swift", ".yaml", ".yml", ".toml", ".json", ".sh", ".bash", ".sql", ".graphql", ".proto", ".tf", ".hcl",
    ".md", ".txt", ".rst",
)
FILENAMES = ("Dockerfile", "Makefile", "Jenkinsfile", "Vagrantfile")
MAX_BYTES = 512 * 1024


def admitted(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of ``files`` (path, length, text, ...) that are taken up: known extension or name, no lock file, not empty,
    not too long, not blank. The tests of path and length come first, so they reach the scan."""
    name = fn.base_name(F.col("path"))
    known = fn.extension_of(F.col("path")).isin(*EXTENSIONS) | name.isin(*FILENAMES)
    rows = files.where(F.col("length").between(1, max_bytes) & known & ~name.isin(*SKIP_FILENAMES))
    return rows.where(F.col("text").rlike(r"\S"))


def git_tracked(root: str) -> list[str] | None:
    """Paths that git tracks under a root; None where git can't say."""
    try:
        done = subprocess.run(["git", "ls-files", "-z"], cwd=root, capture_output=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return [p for p in done.stdout.decode("utf-8", "surrogateescape").split("\0") if p] if done.returncode == 0 else None


def walked(root: str) -> list[str]:
    """Relative paths of all files under a root, without the directories that are always skipped."""
    found = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in SKIP_DIRS)
        found += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in sorted(names)]
    return found


def ignore_patterns(root: str, name: str) -> list[str]:
    """Patterns of an ignore file, without blank lines and notes."""
    path = Path(root, name)
    if not path.exists():
        return []
    return [x for line in path.read_text(encoding="utf-8", errors="ignore").splitlines() if (x := line.strip()) and not x.startswith("#")]


def _glob(pattern: str) -> str:
    """A regular expression for one ignore pattern, in the syntax of git's ignore files."""
    only_dir = pattern.endswith("/")
    body = pattern.strip("/")
    anchored = "/" in pattern.rstrip("/")
    out, at = "", 0
    while at < len(body):
        c = body[at]
        if body.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
            continue
        if body.startswith("**", at):
            out, at = out + ".*", at + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := body.find("]", at + 2)) > 0:
            out += "[" + body[at + 1 : end].replace("!", "^", 1 if body[at + 1] == "!" else 0).replace("\\", "\\\\") + "]"
            at = end
        elif c == "\\" and at + 1 < len(body):
            at += 1
            out += "\\" + body[at] if not body[at].isalnum() else body[at]
        else:
            out += c if c.isalnum() or c in "_/" or ord(c) > 127 else "\\" + c
        at += 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if only_dir else "(?:/|$)")


def pattern_regex(patterns: list[str]) -> Callable[[Column], Column]:
    """Whether a path is ignored: the last pattern that matches decides, and one with ``!`` takes it up again."""

    def test(path: Column) -> Column:
        ignored = F.lit(False)
        for p in patterns:
            if p.strip() and not p.startswith("#"):
                keep = p.startswith("!")
                ignored = F.when(path.rlike(_glob(p[1:] if keep else p)), not keep).otherwise(ignored)
        return ignored

    return test


def read_files(spark: SparkSession, repo: str, root: str, paths: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """(repo, file, path, length, text) of the admitted files of one repo. Bytes that aren't UTF-8 are left out.

    The listing is git's, else a walk; contents are read by the executors, from a file system that they share.
    """
    listed = paths if paths is not None else git_tracked(root)
    listed = walked(root) if listed is None else listed
    names = spark.createDataFrame([(repo, p) for p in listed], "repo string, path string")
    wanted = names.where(~pattern_regex(ignore or [])(F.col("path")))
    base = str(root).rstrip("/")

    @F.arrow_udf("struct<length: bigint, text: string>")
    def load(relative: pa.Array) -> pa.Array:
        sizes, texts = [], []
        for p in relative.to_pylist():
            try:
                full = os.path.join(base, p)
                size = os.path.getsize(full)
                data = Path(full).read_bytes() if 0 < size <= MAX_BYTES and os.path.isfile(full) else b""
            except OSError:
                size, data = 0, b""
            sizes.append(size)
            texts.append(data.decode("utf-8", "ignore"))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(texts, pa.string())], ["length", "text"])

    loaded = wanted.withColumn("_f", load(F.col("path"))).select("repo", F.col("path").alias("file"), "path", "_f.length", "_f.text")
    return admitted(loaded)


def files_in(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """The same columns for a directory in any store that Spark reads, listed and read by Spark itself."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.substring_index("path", root.rstrip("/").rsplit(":", 1)[-1] + "/", -1), "^/+", "")
    skipped = path.rlike("(^|/)(" + "|".join(d.replace(".", "\\.") for d in SKIP_DIRS) + ")/")
    small = raw.where(F.col("length").between(1, MAX_BYTES)).where(~skipped)

    @F.arrow_udf("string")
    def decoded(data: pa.Array) -> pa.Array:
        return pa.array([b.as_py().decode("utf-8", "ignore") for b in data], pa.string())

    return admitted(small.select(F.lit(repo).alias("repo"), path.alias("file"), path.alias("path"), "length", decoded(F.col("content")).alias("text")))
