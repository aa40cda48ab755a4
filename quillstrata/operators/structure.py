"""Structure of a collection: counts, the map of each repo, and paths to repos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repo_stats(chunks: DataFrame) -> DataFrame:
    """(repo, chunks) for each repo, and the total under a null repo."""
    return chunks.rollup("repo").agg(F.count("*").cast("bigint").alias("chunks"))


def class_methods(chunks: DataFrame) -> DataFrame:
    """(repo, class_name, methods): names of the methods of each class name, in the order of file and line."""
    name = F.col("symbol_name")
    is_method = (F.col("chunk_type") == "method") | ((F.col("chunk_type") == "function") & (F.col("parent_symbol") != ""))
    owner = F.when((F.col("chunk_type") == "function") & (F.col("parent_symbol") != ""), F.col("parent_symbol")).otherwise(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1))
    rows = chunks.where(is_method & (name != "")).select("repo", owner.alias("class_name"), F.struct("file", "start_line", F.substring_index("symbol_name", ".", -1).alias("name")).alias("m"))
    listed = rows.where("class_name <> ''").groupBy("repo", "class_name").agg(F.sort_array(F.collect_list("m")).alias("m"))
    return listed.select("repo", "class_name", F.transform("m", lambda x: x["name"]).alias("methods"))


def file_counts(chunks: DataFrame) -> DataFrame:
    """(repo, files): distinct files of each repo."""
    return chunks.groupBy("repo").agg(F.countDistinct("file").cast("bigint").alias("files"))


def language_counts(chunks: DataFrame) -> DataFrame:
    """(repo, language, n): chunks of each language."""
    return chunks.where("language <> ''").groupBy("repo", "language").agg(F.count("*").cast("bigint").alias("n"))


def functions(chunks: DataFrame) -> DataFrame:
    """(repo, file, line, name, signature) of each function that is in no class."""
    rows = chunks.where("symbol_name <> '' AND chunk_type = 'function' AND parent_symbol = ''")
    return rows.select("repo", "file", F.col("start_line").alias("line"), F.col("symbol_name").alias("name"), "signature")


def classes(chunks: DataFrame) -> DataFrame:
    """(repo, file, line, name, methods) of each class."""
    rows = chunks.where("symbol_name <> '' AND chunk_type = 'class'").select("repo", F.col("symbol_name").alias("class_name"), "file", F.col("start_line").alias("line"))
    joined = rows.join(class_methods(chunks), ["repo", "class_name"], "left")
    return joined.select("repo", "file", "line", F.col("class_name").alias("name"), F.coalesce("methods", F.array().cast("array<string>")).alias("methods"))


def repo_map(chunks: DataFrame) -> DataFrame:
    """One row per repo: name, files, languages (chunks by language), classes with their methods, functions.

    A row of the result lists all symbols of a repo: it is a report for reading. At the scale where that is too much,
    ``file_counts``, ``language_counts``, ``classes`` and ``functions`` give the same as rows.
    """
    languages = language_counts(chunks).groupBy("repo").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("languages"))
    listed = lambda rows, last: rows.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("file", "line", "name", last))).alias("x"))
    every = file_counts(chunks).join(languages, "repo", "left")
    every = every.join(listed(classes(chunks), "methods").withColumnRenamed("x", "classes"), "repo", "left")
    every = every.join(listed(functions(chunks), "signature").withColumnRenamed("x", "functions"), "repo", "left")
    return every.select(
        F.col("repo").alias("name"),
        "files",
        F.coalesce("languages", F.create_map().cast("map<string,bigint>")).alias("languages"),
        F.coalesce("classes", F.array().cast(listed_type("methods array<string>"))).alias("classes"),
        F.coalesce("functions", F.array().cast(listed_type("signature string"))).alias("functions"),
    )


def listed_type(last: str) -> str:
    name, _, kind = last.partition(" ")
    return f"array<struct<file: string, line: int, name: string, {name}: {kind}>>"


def split_path(path: Column, roots: dict[str, str]) -> tuple[Column, Column]:
    """(repo, path within it) for absolute paths, by the longest root that holds it; repo '' and the path itself if none.

    For the roots of a configuration, which are few: a chain of conditions, without a join.
    """
    repo, rest = None, None
    for name, root in sorted(roots.items(), key=lambda x: (-len(x[1].rstrip("/")), x[0])):
        prefix = root.rstrip("/") + "/"
        inside = path.startswith(prefix)
        cut = F.expr("1").cast("int") * (len(prefix) + 1)
        repo = F.when(inside, name) if repo is None else repo.when(inside, name)
        part = F.substr(path, cut)
        rest = F.when(inside, part) if rest is None else rest.when(inside, part)
    return (F.lit(""), path) if repo is None else (repo.otherwise(""), rest.otherwise(path))


def longest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``paths`` (column path, ...) with repo and file, for a table of roots (repo, root) of any size.

    Each path is listed under its directories, which join the roots on equality; the longest wins.
    """
    parts = F.split("path", "/")
    levels = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    keyed = paths.withColumn("_path", F.monotonically_increasing_id()) if "_path" not in paths.columns else paths
    dirs = paths.select("path").distinct().select("path", F.explode(levels).alias("root"))
    known = roots.select("repo", F.regexp_replace("root", "/+$", "").alias("root"))
    best = dirs.join(known, "root").groupBy("path").agg(F.max(F.struct(F.length("root").alias("n"), F.col("repo"))).alias("b"))
    joined = keyed.join(best, "path", "left").drop("_path")
    inside = F.col("b").isNotNull()
    file = F.when(inside, F.substr(F.col("path"), F.col("b.n") + 2)).otherwise(F.col("path"))
    return joined.select(*paths.columns, F.when(inside, F.col("b.repo")).otherwise("").alias("repo"), file.alias("file"))
