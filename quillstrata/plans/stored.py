"""Chunk tables in a store: the one that searches are served from, and queries over what a store does."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.fs import FileSystem
from quillstrata.functions import text as fn
from quillstrata.model import conform
from quillstrata.operators.chunking import chunk_files, dealt
from quillstrata.plans.base import FILES, big, files, query, table, windows, work_folder
from quillstrata.store import ChunkStore

WHOLE = 1 << 30


def _repos(rows: DataFrame) -> list[str]:
    return sorted(r.repo for r in rows.select("repo").distinct().collect())  # one name for each repo


def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line windows of the documents whose first word is their symbol, so that the symbol leg has something to find."""
    found = chunk_files(dealt(files(spark, sf_dir)), WHOLE)
    return conform(found.withColumn("symbol_name", F.regexp_extract("text", "^[A-Za-z]+", 0)))


def whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk; its line is its id."""
    rows = files(spark, sf_dir).withColumns({"id": F.col("doc_id").cast("string"), "start_line": F.col("doc_id"), "end_line": F.col("doc_id")})
    return conform(rows)


def served(spark: SparkSession, sf_dir: str, profile: str = "default", text: bool = True) -> ChunkStore:
    """The store of the documents at ``sf_dir``, in the shared working folder: profile "default" holds line windows, profile
    "whole" whole documents. The profile asked for, and with ``text`` its text index, are made on first use and served from
    then on, as long as the documents' files are the same."""
    marks = FileSystem(spark).marks(f"{sf_dir}/documents.parquet")
    root = f"{work_folder(spark)}/served-{hashlib.md5(repr((sf_dir, marks)).encode()).hexdigest()}"
    store = ChunkStore(spark, root)
    if not store.exists(profile):
        made = {"default": window_chunks, "whole": whole_chunks}[profile]
        store.replace(_repos(files(spark, sf_dir)), made(spark, sf_dir), profile)
    if text and not store.has_text_index(profile):
        store.build_text_index(profile)
    return store


def _fresh(spark: SparkSession, sf_dir: str) -> ChunkStore:
    """A store of its own with each document as one chunk, to be changed."""
    store = ChunkStore(spark, f"{work_folder(spark)}/store-{uuid.uuid4().hex}")
    rows = whole_chunks(spark, sf_dir)
    store.replace(_repos(rows), rows)
    return store


def _held(store: ChunkStore) -> DataFrame:
    return store.chunks().select("id", "repo", "file", F.md5("text").alias("text_md5"))


_ROWS = "doc_id::VARCHAR AS id, repo, file, md5(text) AS text_md5"


@query(f"WITH {FILES} SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 6 = 0 THEN 'moved' ELSE repo END AS repo, file, md5(CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE text END) AS text_md5 FROM f")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents come again with a new text, every third of them under the same id in another repo."""
    store = _fresh(spark, sf_dir)
    new = whole_chunks(spark, sf_dir).where("start_line % 2 = 0").withColumn("text", F.lit("new"))
    store.upsert(new.withColumn("repo", F.when(F.col("start_line") % 3 == 0, "moved").otherwise(F.col("repo"))))
    return _held(store)


@query(f"WITH {FILES} SELECT {_ROWS} FROM f WHERE repo <> (SELECT min(repo) FROM f)")
def store_delete_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _fresh(spark, sf_dir)
    store.delete_repo(_repos(store.chunks())[0])
    return _held(store)


@query(f"WITH {FILES}, r AS (SELECT max(repo) AS x FROM f), g AS (SELECT file FROM f, r WHERE repo = x ORDER BY doc_id LIMIT 20) SELECT {_ROWS} FROM f, r WHERE NOT (repo = x AND file IN (SELECT file FROM g))")
def store_delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _fresh(spark, sf_dir)
    repo = _repos(store.chunks())[-1]
    store.delete_files(repo, [r.file for r in store.chunks(repo=repo).orderBy("start_line").select("file").limit(20).collect()])
    return _held(store)


@query(f"WITH {FILES}, r AS (SELECT max(repo) AS x FROM f) SELECT {_ROWS} FROM f, r WHERE repo <> x OR doc_id IN (SELECT doc_id FROM labels)")
def store_delete_stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _fresh(spark, sf_dir)
    repo = _repos(store.chunks())[-1]
    current = files(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("repo", "file")
    store.delete_stale_files(repo, current)
    return _held(store)


@query(f"WITH {FILES}, r AS (SELECT max(repo) AS x FROM f) SELECT {_ROWS} FROM f, r WHERE repo <> x OR doc_id % 5 >= 2 OR doc_id IN (SELECT doc_id FROM labels)")
def store_delete_stale_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _fresh(spark, sf_dir)
    repo = _repos(store.chunks())[-1]
    rows = files(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string"))
    valid = rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("file", "id")
    store.delete_stale_chunks(repo, rows.where("doc_id % 5 < 2").select("repo", "file"), valid)
    return _held(store)


@query(f"WITH {FILES} SELECT {_ROWS} FROM f WHERE repo <> (SELECT min(repo) FROM f)")
def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction after a deletion leaves the table's rows as they are, and nothing that no pointer names."""
    store = _fresh(spark, sf_dir)
    store.delete_repo(_repos(store.chunks())[0])
    store.build_text_index()
    store.compact()
    return _held(store)


@query(f"WITH {FILES} SELECT repo, count(*)::BIGINT AS chunks FROM f GROUP BY repo UNION ALL SELECT NULL, count(*)::BIGINT FROM f")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _fresh(spark, sf_dir).stats()
    return spark.createDataFrame([*stats["repos"].items(), (None, stats["total"])], "repo string, chunks bigint")


@query(f"""
WITH RECURSIVE {FILES}, {windows(80, 20)}, m AS (SELECT repo, file FROM c GROUP BY repo, file ORDER BY count(*) DESC, repo, file LIMIT 1)
SELECT start_line, end_line, md5(c.text) AS text_md5 FROM c JOIN m USING (repo, file)
""")
def store_chunks_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the file that has most of them."""
    store = served(spark, sf_dir, text=False)
    most = store.chunks().groupBy("repo", "file").count().orderBy(F.desc("count"), "repo", "file").head()
    return store.chunks_of_file(most.repo, most.file).select(big("start_line").alias("start_line"), big("end_line").alias("end_line"), F.md5("text").alias("text_md5"))


@query(f"WITH {FILES}, o AS (SELECT min(repo) AS x FROM f) SELECT {_ROWS} FROM f, o WHERE repo = x")
def store_one_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the folder of the repo asked for is read."""
    store = served(spark, sf_dir, "whole", text=False)
    rows = store.chunks("whole", _repos(store.chunks("whole"))[0])
    return rows.select("id", "repo", "file", F.md5("text").alias("text_md5"))


@query(f"WITH {FILES}, o AS (SELECT arg_max(repo, doc_id) AS r, arg_max(file, doc_id) AS p, max(doc_id) AS d FROM f) SELECT {_ROWS} FROM f, o WHERE repo = r AND file = p AND doc_id = d")
def store_find_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = served(spark, sf_dir, "whole", text=False)
    last = store.chunks("whole").orderBy(F.desc("start_line")).select("repo", "file", "start_line").head()
    found = store.find_chunk(last.repo, last.file, last.start_line, "whole")
    return found.select("id", "repo", "file", F.md5("text").alias("text_md5"))


@query(r"""
WITH h AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.') AS p FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE p[1] || ': ' || p[-1] END AS context FROM h
""")
def parent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.split(fn.host_of(F.col("url")), r"\.")
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.element_at(host, 1)).alias("p"), F.element_at(host, -1).alias("s"))
    return rows.select("page_id", fn.parent_context(F.col("p"), F.col("s")).alias("context"))
