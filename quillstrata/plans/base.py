"""How queries are registered, and the tables and SQL parts that they share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows where there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where none is set, a folder of this machine serves
    a local session; on a cluster that is an error, as other machines could not read it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillstrata-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """Computed once, into the shared working folder."""
    work_folder(df.sparkSession)
    return df.checkpoint()


def big(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: their source is the repo, their id the path."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("repo"), path.alias("file"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


FILES = "f AS (SELECT doc_id, coalesce(source, '') AS repo, 'doc/' || doc_id || '.txt' AS file, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents)"

#: Tokens of a column ``text``.
TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


def windows(size: int, overlap: int, source: str = "f") -> str:
    """CTEs l, w and c: line windows of ``source`` (repo, file, text). To be used under WITH RECURSIVE."""
    end = (
        f"CASE WHEN len(x) <= {size} OR {{s}} + {size} >= len(x) THEN len(x) ELSE coalesce(1 + list_max(list_filter(range({{s}} + {size // 2 + 1}, {{s}} + {size + 1}), "
        f"lambda i: regexp_full_match(x[i + 1], '\\s*'))), {{s}} + {size}) END"
    )
    step = f"greatest(e - {overlap}, s + 1)"
    return rf"""
l AS (
  SELECT repo, file, text, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[1:len(string_split(text, chr(10))) - 1] ELSE string_split(text, chr(10)) END AS x
  FROM {source} WHERE NOT regexp_full_match(text, '\s*')),
w AS (
  SELECT repo, file, text, x, 0::BIGINT AS s, ({end.format(s="0")})::BIGINT AS e FROM l
  UNION ALL
  SELECT repo, file, text, x, ({step})::BIGINT, ({end.format(s=step)})::BIGINT FROM w WHERE e < len(x)),
c AS (
  SELECT repo, file, s + 1 AS start_line, e AS end_line,
         CASE WHEN len(x) <= {size} THEN text ELSE regexp_replace(array_to_string(x[s + 1:e], chr(10)), '\s+$', '') END AS text,
         row_number() OVER (PARTITION BY repo, file ORDER BY s) - 1 AS chunk_index
  FROM w)"""


def bm25_sql(source: str, terms: list[str], phrases: list[str] = [], key: str = "repo, file, start_line") -> str:  # noqa: B006
    """CTEs tok, st and scored (key, score) over ``source`` with the columns of the key and text."""
    tf = ", ".join(f"len(list_filter(t, lambda z: z = '{w}'))::DOUBLE AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0)::DOUBLE AS df{i}" for i in range(len(terms)))
    parts = " + ".join(
        f"CASE WHEN tf{i} > 0 THEN ln(1.0::DOUBLE + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ELSE 0.0::DOUBLE END"
        for i in range(len(terms))
    )
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    whole = "".join(f" AND contains(' ' || array_to_string(t, ' ') || ' ', ' {p} ')" for p in phrases)
    return f"""
tok0 AS (SELECT {key}, {TOKENS} AS t FROM {source}),
tok AS (SELECT {key}, t, len(t)::DOUBLE AS dl, {tf} FROM tok0),
st AS (SELECT count(*)::DOUBLE AS n, sum(dl) / count(*) AS avgdl, {df} FROM tok),
scored AS (SELECT {key}, {parts} AS score FROM tok CROSS JOIN st WHERE ({some}){whole})"""
