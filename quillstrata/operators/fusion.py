"""Hybrid search: ranked legs are merged by weighted reciprocal ranks (Cormack, Clarke and Büttcher, 2009)."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from functools import cache

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstrata.functions import text as fn
from quillstrata.model import RESULT_COLUMNS
from quillstrata.operators.bm25 import bm25
from quillstrata.operators.keyword import keyword_search
from quillstrata.operators.symbols import symbol_search
from quillstrata.operators.vector import vector_search

KEY = ("repo", "file", "start_line")
#: Legs in the order in which they supply a result's columns and in which their shares are added.
LEGS = ("semantic", "symbol", "fts", "ripgrep")
# Weight of each leg by class of query, the constant of the ranks, and the legs' limits.
WEIGHTS = {
    "identifier": {"ripgrep": 1.5, "symbol": 2.0, "semantic": 0.5, "fts": 1.0},
    "mixed": {"ripgrep": 1.0, "symbol": 1.0, "semantic": 1.0, "fts": 1.0},
    "natural_language": {"ripgrep": 0.5, "symbol": 0.3, "semantic": 2.0, "fts": 0.8},
}
RRF_K = 60
LIMITS = {"ripgrep": 50, "semantic": 30, "fts": 30, "symbol": 10}
#: Seconds that a leg may take.
TIMES = {"ripgrep": 15.0, "semantic": 20.0, "fts": 20.0, "symbol": 20.0}
RERANKED = 30


def classify(query: str) -> str:
    """The class of one query, on the driver; ``functions.text.query_class`` is the same for a column."""
    words = query.split()

    def like(t: str, pascal: str) -> bool:
        return bool(re.search("[a-z][A-Z]", t)) or "_" in t or "." in t or bool(re.match(pascal, t))

    if len(words) == 1:
        one = words[0]
        return "identifier" if like(one, "[A-Z][a-z]") or len(one) > 1 and one.isalpha() and one.isupper() else "natural_language"
    return "mixed" if any(like(t, "[A-Z][a-z].") for t in words) else "natural_language"


def lines_to_chunks(hits: DataFrame, chunks: DataFrame, bin_lines: int = 64) -> DataFrame:
    """Each hit (repo, file, line, ...) with the smallest chunk that holds its line, null columns if none does.

    Chunks are listed under each bin of ``bin_lines`` lines that they reach into, so the join is on equal (repo, file,
    bin) and a long file is no hot key. Of chunks of one size the first wins. Hits keep their columns; of the chunk come
    the result columns as a struct ``chunk``.
    """
    bins = F.sequence(F.floor(F.col("start_line") / bin_lines), F.floor(F.greatest("end_line", "start_line") / bin_lines))
    placed = chunks.select("repo", "file", F.explode(bins).alias("_bin"), F.struct(*RESULT_COLUMNS).alias("chunk"))
    marked = hits.withColumn("_bin", F.floor(F.col("line") / bin_lines))
    holds = F.col("line").between(F.col("chunk.start_line"), F.col("chunk.end_line"))
    h, c = marked.alias("h"), placed.alias("c")
    on = (F.col("h.repo") == F.col("c.repo")) & (F.col("h.file") == F.col("c.file")) & (F.col("h._bin") == F.col("c._bin")) & holds
    joined = h.join(c, on, "left").select("h.*", "chunk")
    size = F.col("chunk.end_line") - F.col("chunk.start_line")
    order = F.struct(size, F.col("chunk.start_line"), F.col("chunk.symbol_name"))
    # a file has one line of a number; a hit without a chunk has one row
    best = joined.groupBy("repo", "file", "line").agg(F.min_by(F.struct("chunk"), order).alias("b"), *(F.first(c).alias(c) for c in hits.columns if c not in ("repo", "file", "line")))
    return best.select(*hits.columns, F.col("b.chunk").alias("chunk"))


def as_results(hits: DataFrame) -> DataFrame:
    """Keyword hits that have met their chunk, as results; a hit without one stands for its own line."""
    alone = {
        "repo": F.col("repo"), "file": F.col("file"), "start_line": F.col("line").cast("int"), "end_line": F.col("line").cast("int"), "text": F.col("text"),
    }
    lost = F.col("chunk").isNull()
    columns = [F.when(lost, alone.get(c, F.lit(""))).otherwise(F.col(f"chunk.{c}")).alias(c) for c in RESULT_COLUMNS]
    return hits.select(*columns, F.struct("repo", "file", "line").alias("_order"))


def ranked(rows: DataFrame, leg: str, order: list[Column], limit: int | None = None) -> DataFrame:
    """A leg: its results, one for each key (the first), with their place in it. Legs are short: ``limit`` rows at most."""
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    first = F.row_number().over(W.partitionBy(*KEY).orderBy(*order))
    placed = rows.withColumns({"_o": F.struct(*order) if all(not _desc(o) for o in order) else F.lit(None), "_n": first})
    placed = placed.where("_n = 1").withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return placed.select(*RESULT_COLUMNS, "rank", F.lit(leg).alias("leg"))


def _desc(order: Column) -> bool:
    return "DESC" in str(order).upper()


def fuse(legs: list[DataFrame], weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """One row for each key of any leg: columns of the first leg that has it, sources, match_type, rrf_score, and the
    place (leg, rank) that breaks ties. A union and one aggregation; shares are added in the order of LEGS."""
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionByName(leg)
    number = F.array_position(F.array(*map(F.lit, LEGS)), F.col("leg")).cast("int")
    every = every.withColumn("_leg", number)
    meta = [c for c in RESULT_COLUMNS if c not in KEY]
    place = F.struct(F.col("_leg"), F.col("rank"))
    ranks = [F.min(F.when(F.col("leg") == leg, F.col("rank"))).alias(f"_r_{leg}") for leg in LEGS]
    merged = every.groupBy(*KEY).agg(F.min_by(F.struct(*meta), place).alias("_meta"), F.min(place).alias("_place"), F.sort_array(F.collect_set("leg")).alias("sources"), *ranks)
    score = F.lit(0.0)
    for leg in LEGS:
        score = score + F.coalesce(weights[leg] / (float(k) + F.col(f"_r_{leg}")), F.lit(0.0))
    merged = merged.select(*KEY, "_meta.*", "sources", score.alias("rrf_score"), "_place")
    return merged.withColumns({"match_type": fn.match_type(F.col("sources")), "rerank_score": F.lit(0.0)})


def in_order(fused: DataFrame, limit: int | None = None) -> DataFrame:
    rows = fused.orderBy(F.desc(F.round("rrf_score", 12)), "_place", *KEY)
    return rows if limit is None else rows.limit(limit)


def overlap_scorer(query: str) -> Callable[[Column], Column]:
    """A reranker without a model: the share of the query's terms that the text has."""
    words = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    have = lambda text: F.size(F.array_intersect(fn.tokens(text), F.array(*map(F.lit, words)))) if words else F.lit(0)
    return lambda text: have(text).cast("double") / float(max(1, len(words)))


def rerank(fused: DataFrame, scorer: Callable[[Column], Column], top: int = RERANKED) -> DataFrame:
    """Results with ``place``: the first ``top`` in the order of the scorer, then the others as they were.

    The window runs over fused results, at most as many as the legs' limits allow.
    """
    placed = fused.withColumn("_at", F.row_number().over(W.orderBy(F.desc(F.round("rrf_score", 12)), "_place", *KEY)))
    score = F.when(F.col("_at") <= top, scorer(F.col("text"))).otherwise(0.0)
    placed = placed.withColumn("rerank_score", score)
    order = [F.col("_at") > top, F.desc(F.when(F.col("_at") <= top, F.round("rerank_score", 12)).otherwise(0.0)), F.col("_at")]
    return placed.withColumn("place", F.row_number().over(W.orderBy(*order))).drop("_at")


def full_text_leg(rows: DataFrame) -> DataFrame:
    return ranked(rows, "fts", [F.desc(F.round("score", 6)), *map(F.col, KEY)], LIMITS["fts"])


def legs_of(
    chunks: DataFrame,
    files: DataFrame,
    query: str,
    query_vector: list[float] | None = None,
    repo: str | None = None,
    regex: bool = False,
    semantic: DataFrame | None = None,
    full_text: DataFrame | None = None,
) -> dict[str, Callable[[], DataFrame]]:
    """The legs of a query, each made when it is called for.

    The semantic leg is there where there is a query vector (or ``semantic``, results with a ``distance`` made elsewhere),
    the symbol leg for queries that look like code. ``full_text``: results with a ``score`` from a stored index, in place
    of a scan of the chunks. A repo filter holds for every leg.
    """
    if repo is not None:
        chunks, files = chunks.where(F.col("repo") == repo), files.where(F.col("repo") == repo)
    keys = list(map(F.col, KEY))

    def nearest() -> DataFrame:
        rows = vector_search(chunks, query_vector, LIMITS["semantic"]) if semantic is None else semantic
        return ranked(rows, "semantic", [F.round("distance", 6), *keys], LIMITS["semantic"])

    def named() -> DataFrame:
        return ranked(symbol_search(chunks, query.strip(), limit=LIMITS["symbol"]), "symbol", [F.desc("score"), *keys])

    def worded() -> DataFrame:
        return full_text_leg(bm25(chunks, query) if full_text is None else full_text)

    def literal() -> DataFrame:
        lines = keyword_search(files, query, LIMITS["ripgrep"], regex=regex)
        # the lines' files are few (the limit bounds them), so only their chunks meet them
        near = chunks.join(F.broadcast(lines.select("repo", "file").distinct()), ["repo", "file"], "left_semi")
        return ranked(as_results(lines_to_chunks(lines, near)), "ripgrep", [F.col("_order")])

    legs = {"semantic": nearest} if semantic is not None or query_vector is not None else {}
    if classify(query) != "natural_language":
        legs["symbol"] = named
    return legs | {"fts": worded, "ripgrep": literal}


def hybrid_search(
    chunks: DataFrame,
    files: DataFrame,
    query: str,
    query_vector: list[float] | None = None,
    limit: int | None = 10,
    repo: str | None = None,
    regex: bool = False,
    scorer: Callable[[Column], Column] | None = None,
    semantic: DataFrame | None = None,
    full_text: DataFrame | None = None,
) -> DataFrame:
    """Fused results of up to four legs (``legs_of``), best first, as one lazy plan. ``scorer`` reranks the first 30."""
    legs = legs_of(chunks, files, query, query_vector, repo, regex, semantic, full_text)
    return _fused([leg() for leg in legs.values()], query, limit, scorer)


def _fused(legs: list[DataFrame], query: str, limit: int | None, scorer: Callable[[Column], Column] | None) -> DataFrame:
    fused = fuse(legs, WEIGHTS[classify(query)])
    if scorer is not None:
        done = rerank(fused, scorer).orderBy("place")
        return done if limit is None else done.limit(limit)
    return in_order(fused, limit)


def run_apart(
    spark: SparkSession,
    legs: dict[str, Callable[[], DataFrame]],
    query: str,
    limit: int | None = 10,
    scorer: Callable[[Column], Column] | None = None,
    seconds: dict[str, float] | None = None,
    say: Callable[[str], None] = lambda m: None,
) -> DataFrame:
    """Fused results of legs that run side by side. One that fails, or takes longer than its time, is told to ``say`` and
    left out; if all do, the last error is raised. What comes to the driver are the legs' rows, at most LIMITS of each."""
    waits = TIMES if seconds is None else seconds
    found: dict[str, list] = {}
    errors: dict[str, BaseException] = {}

    def run(name: str, group: str) -> None:
        try:
            spark.sparkContext.setJobGroup(group, f"leg {name}", interruptOnCancel=True)
            found[name] = [tuple(r) for r in legs[name]().collect()]
        except Exception as e:  # noqa: BLE001: any failure of a leg leaves the others
            errors[name] = e

    group = uuid.uuid4().hex
    threads = {name: InheritableThread(target=run, args=(name, f"{group}-{name}"), daemon=True) for name in legs}
    start = time.monotonic()
    for t in threads.values():
        t.start()
    for name, t in threads.items():
        t.join(max(0.0, waits.get(name, max(waits.values())) - (time.monotonic() - start)))
        if t.is_alive():
            spark.sparkContext.cancelJobGroup(f"{group}-{name}")
            errors[name] = TimeoutError(f"no answer within {waits.get(name)} s")
    good = [name for name in legs if name in found and name not in errors]
    for name, e in errors.items():
        say(f"leg {name} left out: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
    if not good:
        raise next(reversed(errors.values()))
    shape = ", ".join(f"{c} {'int' if c in ('start_line', 'end_line') else 'string'}" for c in RESULT_COLUMNS) + ", rank int, leg string"
    rows = [row for name in good for row in found[name]]
    return _fused([spark.createDataFrame(rows, shape).coalesce(1)], query, limit, scorer)


def reranked(rows: list[dict], query: str, score: Callable[[list[tuple[str, str]]], list[float]], top: int = RERANKED, say: Callable[[str], None] = lambda m: None) -> list[dict]:
    """Results of a search, the first ``top`` by a model's score of (query, text) pairs; as they were if the model fails."""
    head = rows[:top]
    try:
        scores = [float(s) for s in score([(query, r["text"]) for r in head])]
        if len(scores) != len(head):
            raise ValueError(f"{len(scores)} scores for {len(head)} texts")
    except Exception as e:  # noqa: BLE001: whatever the model does, the results stay
        say(f"reranking left out: {e}")
        return rows
    order = sorted(range(len(head)), key=lambda i: (-round(scores[i], 12), i))
    return [head[i] | {"rerank_score": scores[i], "reranked": True} for i in order] + rows[top:]


@cache
def cross_encoder(model: str) -> Callable[[list[tuple[str, str]]], list[float]]:
    """A cross-encoder of the sentence-transformers package, loaded once. ImportError if the package is not there."""
    from sentence_transformers import CrossEncoder

    return CrossEncoder(model).predict
