"""Shared pieces of the corpus operators: tokens, batches, folds and scratch storage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; ``bytes.split`` cuts at exactly the six characters WORD leaves out."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def sliced(texts: Iterable[str | None], most: int = 1 << 22) -> Iterator[list[str | None]]:
    """Runs of texts of about ``most`` characters together, so that scratch arrays stay small for long texts."""
    run: list[str | None] = []
    held = 0
    for text in texts:
        run.append(text)
        held += len(text or "")
        if held >= most or len(run) >= 512:
            yield run
            run, held = [], 0
    if run:
        yield run


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out when a table has fewer files than there are cores; else leave the scan's partitions alone.

    One file of one row group is one task. Tables of many files never pay for this shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if len(df.inputFiles()) < cores else df


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null ids go to fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


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


def truncate_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()``: the rows are read back from the shared folder, whichever executors are lost."""
    work_folder(df.sparkSession)
    return df.checkpoint()


def join_named(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns that ``named`` (key, copies, others; one row a key) has of each key, copies left out.

    Keys of many rows, more than one in 10,000 of all and 1,000 at least, would each fall to one task: as there are fewer
    than 10,000 of them, they are broadcast, and their rows stay where they are. All others meet by shuffle.
    """
    hot = F.col("copies") > max(1000, rows.count() // 10_000)
    few = named.where(hot).drop("copies").withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(few), key, "left")
    met = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot IS NULL").select(*rows.columns).join(named.where(~hot).drop("copies"), key)
    return met.unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
