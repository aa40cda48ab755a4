"""Files that arrive as a stream, into the chunk table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstrata.operators.chunking import chunk_files
from quillstrata.operators.embedding import Backend, embed_chunks
from quillstrata.store import ChunkStore

SCHEMA = "repo string, file string, text string, deleted boolean, seq bigint"


def changes(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream of changes (repo, file, text, deleted, seq) from Parquet files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)


def latest(batch: DataFrame) -> DataFrame:
    """The last change of each file in a batch, by ``seq``: (repo, file, text, deleted, seq)."""
    last = F.max_by(F.struct("text", "deleted", "seq"), F.col("seq")).alias("x")
    return batch.groupBy("repo", "file").agg(last).select("repo", "file", "x.*")


def applied(store: ChunkStore, profile: str = "default") -> DataFrame:
    """(repo, file, seq): the number of the last change of each file that is in the table, deletions included."""
    path = f"{store.root}/stream-{profile}"
    now = store.fs.read(f"{path}/current")
    return store.spark.read.schema("repo string, file string, seq bigint").parquet(f"{path}/{now}") if now else store.spark.createDataFrame([], "repo string, file string, seq bigint")


def apply_changes(store: ChunkStore, batch: DataFrame, backend: Backend, profile: str = "default") -> None:
    """A batch put into the table; once more gives the same table, so a repeated batch does no harm.

    A change that is older than what the table has of its file is passed over, in whichever batch it comes. Every other
    changed file's old chunks go, and the new ones come, in one version; then the numbers are kept.
    """
    known = applied(store, profile)
    last = latest(batch).join(known.withColumnRenamed("seq", "had"), ["repo", "file"], "left").where("had IS NULL OR seq >= had").drop("had")
    if not last.isEmpty():
        store.exchange(last, embed_chunks(chunk_files(last.where("NOT coalesce(deleted, false)")), backend), profile)
        path, name = f"{store.root}/stream-{profile}", uuid.uuid4().hex
        numbers = known.unionByName(last.select("repo", "file", "seq")).groupBy("repo", "file").agg(F.max("seq").alias("seq"))
        numbers.write.parquet(f"{path}/{name}")
        old = store.fs.read(f"{path}/current")
        store.fs.replace(f"{path}/current", name)
        if old:
            store.fs.delete(f"{path}/{old}")


def ingest(stream: DataFrame, store: ChunkStore, backend: Backend, checkpoint: str, profile: str = "default") -> StreamingQuery:
    """Runs until what is there now has been taken in."""
    return (
        stream.writeStream.foreachBatch(lambda batch, number: apply_changes(store, batch, backend, profile))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
