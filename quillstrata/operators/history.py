"""History: versions of files compared by symbol, occurrences that come and go, and the timeline of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstrata.functions import text as fn
from quillstrata.functions.similarity import changed

REFACTOR = 0.2
MAX_FILES, MAX_DIFFS = 5, 20


def last_definitions(chunks: DataFrame, *key: str) -> DataFrame:
    """The last chunk of each symbol by place in the file: (key, symbol_name, signature, text)."""
    last = F.max_by(F.struct("signature", "text"), F.col("chunk_index")).alias("x")
    return chunks.where("symbol_name <> ''").groupBy(*key, "symbol_name").agg(last).select(*key, "symbol_name", "x.*")


def structural_diff(old: DataFrame, new: DataFrame, *key: str, ratio: bool = True) -> DataFrame:
    """Changed symbols between two versions (key, symbol_name, signature, text): one full outer join on their names.

    A new or missing symbol, or another signature, is major; another body is a refactor if over 0.2 of it changed and
    else minor. ``ratio=False`` leaves the measuring out: a changed body is then minor.
    """
    a = old.select(*key, "symbol_name", F.struct("signature", "text").alias("o"))
    b = new.select(*key, "symbol_name", F.struct("signature", "text").alias("n"))
    both = a.join(b, [*key, "symbol_name"], "full_outer")
    kind = (
        F.when(F.col("o").isNull(), "added")
        .when(F.col("n").isNull(), "removed")
        .when(F.col("o.signature") != F.col("n.signature"), "signature_changed")
        .when(F.col("o.text") != F.col("n.text"), "body_changed")
    )
    found = both.withColumn("change_type", kind).where("change_type IS NOT NULL")
    sigs = [F.coalesce(f"{x}.signature", F.lit("")).alias(f"{name}_signature") for x, name in (("o", "old"), ("n", "new"))]
    body = F.col("change_type") == "body_changed"
    if not ratio:
        return found.select(*key, "symbol_name", "change_type", *sigs, F.when(body, "minor").otherwise("major").alias("significance"))
    # only changed bodies carry their texts to Python
    share = changed(F.when(body, F.col("o.text")), F.when(body, F.col("n.text")))
    measured = found.select(*key, "symbol_name", "change_type", *sigs, share.alias("_share"))
    weight = F.when(F.col("change_type") != "body_changed", "major").when(F.col("_share") > REFACTOR, "refactor").otherwise("minor")
    return measured.withColumn("significance", weight).drop("_share")


def previous_version(versions: DataFrame, key: list[str], order: list[str], column: str = "text") -> DataFrame:
    """``versions`` with the column's value in the version before, for linear histories."""
    return versions.withColumn(f"previous_{column}", F.lag(column).over(W.partitionBy(*key).orderBy(*order)))


def occurrences(text: Column, word: str) -> Column:
    """How often a literal occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("bigint")


def pickaxe(versions: DataFrame, word: str, key: list[str], order: list[str], column: str = "text") -> DataFrame:
    """Versions in which the number of occurrences of ``word`` differs from the version before (0 before the first)."""
    counted = versions.withColumn("occurrences", occurrences(F.coalesce(column, F.lit("")), word))
    before = F.coalesce(F.lag("occurrences").over(W.partitionBy(*key).orderBy(*order)), F.lit(0).cast("bigint"))
    return counted.withColumn("previous", before).where("occurrences <> previous")


def scope_files(results: DataFrame, order: list[Column], most: int = MAX_FILES) -> DataFrame:
    """The first ``most`` distinct (repo, file) of ranked search results, with their best symbol."""
    first = F.row_number().over(W.partitionBy("repo", "file").orderBy(*order))
    return results.withColumn("_n", first).where("_n = 1").orderBy(*order).limit(most).select("repo", "file", "symbol_name")


def timeline(commits: DataFrame, scope: DataFrame, hits: DataFrame, limit: int = 20) -> DataFrame:
    """Entries, latest first: commits (repo, sha, author, date, message, file) of the scoped files are direct, commits
    that ``hits`` (the same columns) adds are related and of no file. Keyed by (repo, sha, file).

    Dates are compared as instants, so that offsets don't mislead.
    """
    direct = commits.join(scope.select("repo", "file").distinct(), ["repo", "file"], "left_semi").withColumn("relevance", F.lit("direct"))
    related = hits.withColumns({"file": F.lit(""), "relevance": F.lit("related")}).dropDuplicates(["repo", "sha"])
    columns = ["repo", "sha", "file", "author", "date", "message", "relevance"]
    every = direct.select(*columns).unionByName(related.select(*columns)).dropDuplicates(["repo", "sha", "file"])
    return every.withColumn("at", F.to_timestamp("date")).orderBy(F.desc("at"), "repo", "sha", "file").limit(limit)


def short(commits: DataFrame) -> DataFrame:
    return commits.withColumns({"sha": fn.short_sha(F.col("sha")), "date": fn.short_date(F.col("date"))})
