"""Nearest vectors: exact by default, or through a coarse index whose cells are probed."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstrata.functions import text as fn
from quillstrata.model import StoreError

METRICS = ("cosine", "l2")


def _distances(vectors: pa.Array, q: np.ndarray, metric: str) -> pa.Array:
    """Distances of one Arrow batch; null for null vectors, other lengths, null components and, under cosine, zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), len(q)), False)
    x = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "l2":
            value = np.square(x - q).sum(axis=1)
        else:
            value = 1.0 - (x @ q) / (np.sqrt(np.square(x).sum(axis=1)) * np.sqrt(q @ q))
    out = np.full(len(vectors), np.nan)
    out[fits.to_numpy(zero_copy_only=False)] = value
    return pa.array(out, pa.float64(), mask=~np.isfinite(out))


def distance(vector: Column, query: list[float], metric: str = "cosine") -> Column:
    """Cosine distance, or squared Euclidean distance, of an array column to a query; null where there is none.

    Spark's array functions are interpreted element by element; numpy takes a whole Arrow batch at once.
    """
    if metric not in METRICS:
        raise StoreError(f"no such metric: {metric}")
    q = np.array(query, np.float64)
    if q.ndim != 1 or not len(q) or not np.isfinite(q).all():
        raise StoreError("a query vector must have finite components")

    @F.arrow_udf("double")
    def run(vectors: pa.Array) -> pa.Array:
        return _distances(vectors, q, metric)

    return run(vector)


def vector_search(chunks: DataFrame, query: list[float], limit: int = 30, repo: str | None = None, metric: str = "cosine", by: tuple[str, ...] = ("repo", "file", "start_line")) -> DataFrame:
    """The ``limit`` nearest rows with columns distance and score, nearest first; ties in the order of ``by``.

    Rows without a vector, or with one of another length, are not found.
    """
    if repo is not None:
        chunks = chunks.where(F.col("repo") == repo)
    scored = chunks.withColumn("distance", distance(F.col("vector"), query, metric)).where("distance IS NOT NULL")
    return scored.withColumn("score", fn.distance_score(F.col("distance"))).orderBy(F.round("distance", 6), *by).limit(limit)


def n_cells(rows: int, fit_rows: int = 200_000) -> int:
    """How many cells a coarse index has: the square root of the rows, 16 at least, and no more than the rows that the
    centres are fitted on can tell apart (50 for each)."""
    return max(16, min(fit_rows // 50, int(sqrt(rows))))


def build_cells(chunks: DataFrame, rows: int, seed: int = 42, fit_rows: int = 200_000) -> tuple[DataFrame, list[list[float]]]:
    """(chunks with column ``cell``, centres). Every row is indexed; k-means is fitted on about ``fit_rows`` of them, by
    a hash of the id. Vectors are scaled to unit length, so that Euclidean cells serve the cosine metric."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.when(norm > 0, F.transform("vector", lambda x: x.cast("double") / norm)).otherwise(F.transform("vector", lambda x: x.cast("double")))
    ready = chunks.withColumn("_unit", array_to_vector(unit))
    some = ready if rows <= fit_rows else ready.where(F.pmod(F.xxhash64("id"), F.lit(rows)) < fit_rows)
    model = KMeans(k=n_cells(rows, fit_rows), seed=seed, featuresCol="_unit", predictionCol="cell", maxIter=10).fit(some.select("_unit"))
    return model.transform(ready).drop("_unit"), [c.tolist() for c in model.clusterCenters()]


def n_probes(cells: int) -> int:
    """How many cells a search reads: two thirds, as recall falls when a fixed number is read of more cells."""
    return ceil(2 * cells / 3)


def _near(centres: list[list[float]], query: list[float], probes: int | None) -> np.ndarray:
    q = np.array(query, float)
    q /= np.sqrt(q @ q) or 1.0
    return np.argsort(((np.array(centres) - q) ** 2).sum(axis=1))[: probes or n_probes(len(centres))]


def cell_search(indexed: DataFrame, centres: list[list[float]], query: list[float], limit: int = 30, probes: int | None = None, **how) -> DataFrame:
    """``vector_search`` among the ``probes`` cells whose centres are nearest to the query. Where the table is
    partitioned by cell, only these are read."""
    near = _near(centres, query, probes)
    return vector_search(indexed.where(F.col("cell").isin([int(c) for c in near])), query, limit, **how)


def cell_search_all(indexed: DataFrame, centres: list[list[float]], queries: list[tuple[int, list[float]]], limit: int = 30, metric: str = "cosine") -> DataFrame:
    """``cell_search`` for each of the queries (id, vector) in one pass: query_id, vec_id, distance. A batch gives each
    query no more than its nearest rows, so the ranking sees those only."""
    asked = [(i, np.array(q, np.float64), _near(centres, q, None)) for i, q in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            for i, q, near in asked:
                some = batch.filter(pa.array(np.isin(cell, near)))
                d = _distances(some.column("vector"), q, metric).to_numpy(zero_copy_only=False).astype(np.float64)
                if not (known := d[~np.isnan(d)]).size:
                    continue
                most = np.partition(known, limit - 1)[limit - 1] if len(known) > limit else known.max()
                take = np.flatnonzero(d <= most + 1e-6)  # ties of rounded distances too
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), i, np.int64)), some.column("vec_id").take(pa.array(take)), pa.array(d[take])], names=["query_id", "vec_id", "distance"])

    found = indexed.select("vec_id", "vector", "cell").mapInArrow(run, "query_id bigint, vec_id bigint, distance double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("distance", 6), "vec_id"))
    return found.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
