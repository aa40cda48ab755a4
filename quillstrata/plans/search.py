"""Queries over ranked legs and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.functions import text as fn
from quillstrata.model import conform
from quillstrata.operators import fusion
from quillstrata.operators.bm25 import bm25, corpus_stats, phrase_positions, postings
from quillstrata.operators.chunking import chunk_files, dealt
from quillstrata.operators.embedding import HashBackend, embed_column
from quillstrata.operators.keyword import keyword_lines
from quillstrata.operators.symbols import list_symbols, resolve_symbol, suggestions, symbol_search, symbol_tiers
from quillstrata.operators.vector import build_cells, cell_search_all, distance, vector_search
from quillstrata.plans.base import FILES, TOKENS, big, bm25_sql, files, query, table, windows
from quillstrata.plans.stored import served

WHOLE = 1 << 30


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(files(spark, sf_dir))


# full-text search


@query(f"WITH {FILES} SELECT count(*)::BIGINT AS n_docs, round(sum(n)::DOUBLE / count(*), 6) AS avg_len FROM (SELECT len({TOKENS}) AS n FROM f)")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats(_documents(spark, sf_dir)).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def _top(rows: DataFrame, column: str, down: bool, limit: int, *by: str) -> DataFrame:
    rounded = rows.withColumn(column, F.round(column, 6))
    return rounded.orderBy(F.desc(column) if down else F.asc(column), *by).limit(limit)


@query(f"WITH {FILES}, {bm25_sql('f', ['the', 'heretion', 'of'], key='doc_id, repo, file')} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, repo, file LIMIT 30")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the stored postings; only the results' texts are read."""
    found = served(spark, sf_dir, "whole").search_text("the heretion, of", 30, profile="whole")
    return found.select(big("start_line").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {FILES}, {bm25_sql('f', ['the', 'heretion', 'of'], key='doc_id')} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, doc_id LIMIT 30")
def bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking without an index: two scans of the texts."""
    return _top(bm25(_documents(spark, sf_dir), "the heretion, of"), "score", True, 30, "doc_id").select("doc_id", "score")


@query(f"WITH {FILES}, {bm25_sql('f', ['of', 'the', 'and'], ['of the'], key='doc_id')} SELECT doc_id, round(score, 6) AS score FROM scored")
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks with the phrase, by the stored postings' positions."""
    found = served(spark, sf_dir, "whole").ranked_text('"of the" and', None, profile="whole")
    return found.select(big("start_line").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""
WITH {FILES}, p AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS k, t FROM (SELECT doc_id, {TOKENS} AS t FROM f))
SELECT doc_id, (k - 1)::BIGINT AS at FROM p WHERE t[k] = 'of' AND k < len(t) AND t[k + 1] = 'the'
""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).withColumn("id", F.col("doc_id"))
    return phrase_positions(rows, ["of", "the"]).select(F.col("id").alias("doc_id"), big("at").alias("at"))


@query(f"""
WITH {FILES}, t AS (SELECT doc_id, {TOKENS} AS t FROM f)
SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS tf, min(first)::BIGINT AS first
FROM (SELECT doc_id, term, count(*) AS tf, min(k) - 1 AS first FROM (SELECT doc_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS k FROM t) GROUP BY doc_id, term) GROUP BY term
""")
def postings_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = postings(_documents(spark, sf_dir).withColumn("id", F.col("doc_id")))
    first = F.array_min("positions")
    return index.groupBy("term").agg(big(F.count("*")).alias("df"), big(F.sum("tf")).alias("tf"), big(F.min(first)).alias("first"))


# vectors


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    first = rows.where("vec_id = 0").select("vector").head()
    return rows, [float(x) for x in first.vector]


_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query(f"WITH {_Q} SELECT vec_id, round(list_cosine_distance(v, q), 6) AS distance FROM e, q ORDER BY round(list_cosine_distance(v, q), 6), vec_id LIMIT 30")
def vector_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = _vectors(spark, sf_dir)
    return vector_search(rows, q, 30, by=("vec_id",)).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_Q} SELECT vec_id, round(list_distance(v, q) ** 2, 6) AS distance FROM e, q ORDER BY round(list_distance(v, q) ** 2, 6), vec_id LIMIT 30")
def vector_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = _vectors(spark, sf_dir)
    return vector_search(rows, q, 30, metric="l2", by=("vec_id",)).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_Q} SELECT vec_id, round(list_cosine_distance(v, q), 6) AS distance FROM e, q WHERE label = 3 ORDER BY round(list_cosine_distance(v, q), 6), vec_id LIMIT 10")
def vector_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = _vectors(spark, sf_dir)
    return vector_search(rows.where("label = 3"), q, 10, by=("vec_id",)).select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT len(embedding)::BIGINT AS dims, count(*)::BIGINT AS n FROM embeddings GROUP BY len(embedding)")
def vector_dims_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(big(F.size("embedding")).alias("dims")).agg(big(F.count("*")).alias("n"))


@query(f"WITH {_Q} SELECT vec_id, round(1 / (1 + list_distance(v, q) ** 2), 6) AS score FROM e, q")
def similarity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = _vectors(spark, sf_dir)
    return rows.select("vec_id", F.round(fn.distance_score(distance(F.col("vector"), q, "l2")), 6).alias("score"))


@query()
def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate search through a coarse index of all vectors, for each vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    indexed, centres = build_cells(rows.withColumn("id", F.col("vec_id").cast("string")), rows.count())
    asked = rows.where((F.col("vec_id") % 100 == 0) & (F.size("vector") == len(centres[0]))).orderBy("vec_id").select("vec_id", "vector").collect()
    return cell_search_all(indexed, centres, [tuple(r) for r in asked], 30).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query()
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _documents(spark, sf_dir).select("doc_id", embed_column(F.col("text"), HashBackend(64)).alias("vector"))
    return vectors.select("doc_id", big(F.size("vector")).alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 4).alias("norm"))


# symbols: hosts of pages, whose parts are joined by dots


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = fn.host_of(F.col("url"))
    return pages.select(
        "page_id", F.substring_index(host, ".", -1).alias("repo"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("file"), host.alias("symbol_name"),
        F.when(F.col("page_id") % 2 == 0, "class").otherwise("function").alias("chunk_type"), F.substring_index(host, ".", 1).alias("parent_symbol"), F.lit("").alias("signature"),
        F.lit("").alias("parent_signature"), F.lit("html").alias("language"), F.col("page_id").cast("int").alias("start_line"), F.col("page_id").cast("int").alias("end_line"), F.lit("").alias("text"),
    )


_HOSTS = r"""h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS symbol_name, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS file FROM pages),
g AS (SELECT page_id, string_split(symbol_name, '.')[-1] AS repo, file, symbol_name, string_split(symbol_name, '.')[1] AS parent, CASE WHEN page_id % 2 = 0 THEN 'class' ELSE 'function' END AS chunk_type FROM h)"""
_TIER = "CASE WHEN symbol_name = {q} THEN 1.0::DOUBLE WHEN ends_with(symbol_name, '.' || {q}) THEN 0.8::DOUBLE WHEN contains(symbol_name, {q}) THEN 0.5::DOUBLE END"


def _first_host(spark: SparkSession, sf_dir: str) -> str:
    return _hosts(spark, sf_dir).agg(F.min("symbol_name").alias("s")).head().s


@query(f"WITH {_HOSTS} SELECT page_id, symbol_name FROM g WHERE symbol_name = (SELECT min(symbol_name) FROM g)")
def symbol_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_tiers(_hosts(spark, sf_dir), _first_host(spark, sf_dir)).where("score = 1.0").select("page_id", "symbol_name")


@query(f"WITH {_HOSTS} SELECT page_id, symbol_name FROM g WHERE ends_with(symbol_name, '.example.net')")
def symbol_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_tiers(_hosts(spark, sf_dir), "example.net").where("score = 0.8").select("page_id", "symbol_name")


@query(f"WITH {_HOSTS} SELECT page_id, symbol_name FROM g WHERE contains(symbol_name, 'the') AND NOT ends_with(symbol_name, '.the') AND symbol_name <> 'the'")
def symbol_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_tiers(_hosts(spark, sf_dir), "the").where("score = 0.5").select("page_id", "symbol_name")


@query(f"WITH {_HOSTS}, m AS (SELECT min(symbol_name) AS q FROM g WHERE len(string_split(symbol_name, '.')) = 3) SELECT page_id, symbol_name, {_TIER.format(q='q')} AS score FROM g, m WHERE contains(symbol_name, q) ORDER BY score DESC, repo, file, page_id LIMIT 40")
def symbol_tiers_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _hosts(spark, sf_dir)
    name = hosts.where(F.size(F.split("symbol_name", r"\.")) == 3).agg(F.min("symbol_name").alias("s")).head().s
    return symbol_search(hosts, name, limit=40).select("page_id", "symbol_name", "score")


@query(f"WITH {_HOSTS} SELECT page_id, symbol_name, chunk_type FROM g WHERE symbol_name <> '' AND repo = 'net' AND chunk_type = 'class' AND contains(symbol_name, 'th') ORDER BY repo, file, page_id LIMIT 50")
def symbol_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_symbols(_hosts(spark, sf_dir), "th", "net", "class", 50).select(big("start_line").alias("page_id"), "symbol_name", "chunk_type")


@query(f"""
WITH {_HOSTS}, t AS (SELECT repo, file, symbol_name FROM g WHERE len(string_split(symbol_name, '.')) = 4 ORDER BY page_id LIMIT 1),
k AS (SELECT g.*, parent AS owner, t.file AS want, t.symbol_name AS q, array_to_string(string_split(t.symbol_name, '.')[:len(string_split(t.symbol_name, '.')) - 1], '.') AS rest, string_split(t.symbol_name, '.')[-1] AS last FROM g JOIN t ON g.repo = t.repo),
s AS (SELECT 0 AS n, 'file_scoped_dotted' AS source, page_id, symbol_name, file, repo, {_TIER.format(q="last")} AS score FROM k WHERE file = want AND contains(CASE WHEN owner <> '' THEN owner ELSE symbol_name END, rest) AND contains(symbol_name, last)
  UNION ALL SELECT 1, 'file_scoped', page_id, symbol_name, file, repo, {_TIER.format(q="q")} FROM k WHERE file = want AND contains(symbol_name, q)
  UNION ALL SELECT 2, 'global_fallback', page_id, symbol_name, file, repo, {_TIER.format(q="q")} FROM k WHERE (file = want OR ends_with(file, '/' || want)) AND contains(symbol_name, q))
SELECT source, page_id, symbol_name, score FROM s ORDER BY n, score DESC, repo, file, page_id LIMIT 1
""")
def symbol_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _hosts(spark, sf_dir)
    t = hosts.where(F.size(F.split("symbol_name", r"\.")) == 4).orderBy("page_id").select("repo", "file", "symbol_name").head()
    return resolve_symbol(hosts, t.symbol_name, t.repo, t.file).select("source", "page_id", "symbol_name", "score")


@query(f"WITH {_HOSTS}, t AS (SELECT repo, file FROM g GROUP BY repo, file ORDER BY count(*) DESC, repo, file LIMIT 1) SELECT symbol_name FROM g JOIN t USING (repo, file) WHERE symbol_name <> '' ORDER BY page_id, symbol_name LIMIT 8")
def symbol_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _hosts(spark, sf_dir)
    t = hosts.groupBy("repo", "file").count().orderBy(F.desc("count"), "repo", "file").head()
    return suggestions(hosts, t.repo, t.file)


# lines and chunks


_LINES = "hits AS (SELECT repo, file, i AS line FROM (SELECT repo, file, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT repo, file, string_split(text, chr(10)) AS x FROM f)) WHERE contains(x[i], '{q}'))"


def _small_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(chunk_files(_documents(spark, sf_dir), WHOLE, window=8, overlap=2))


@query(f"""
WITH RECURSIVE {FILES}, {windows(8, 2)}, {_LINES.format(q='the')}
SELECT repo, file, line, start_line, end_line FROM (
  SELECT h.repo, h.file, h.line, c.start_line, c.end_line, row_number() OVER (PARTITION BY h.repo, h.file, h.line ORDER BY c.end_line - c.start_line, c.start_line) AS n
  FROM hits h LEFT JOIN c ON h.repo = c.repo AND h.file = c.file AND h.line BETWEEN c.start_line AND c.end_line) WHERE n = 1
""")
def line_to_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = keyword_lines(_documents(spark, sf_dir), "the")
    found = fusion.lines_to_chunks(hits, _small_windows(spark, sf_dir))
    return found.select("repo", "file", "line", big("chunk.start_line").alias("start_line"), big("chunk.end_line").alias("end_line"))


@query(f"""
WITH RECURSIVE {FILES}, {windows(8, 2)}
SELECT repo, file, start_line, end_line FROM (SELECT *, row_number() OVER (PARTITION BY repo, file ORDER BY end_line - start_line, start_line) AS n FROM c WHERE 7 BETWEEN start_line AND end_line) WHERE n = 1
""")
def chunk_containing_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _small_windows(spark, sf_dir).where(F.lit(7).between(F.col("start_line"), F.col("end_line")))
    best = chunks.groupBy("repo", "file").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("n"), "start_line", "end_line")).alias("b"))
    return best.select("repo", "file", big("b.start_line").alias("start_line"), big("b.end_line").alias("end_line"))


# fusion


def _semantic(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """Chunks of the documents whose ids the nearest vectors have."""
    rows, q = _vectors(spark, sf_dir)
    near = vector_search(rows, q, 30, by=("vec_id",)).select(F.concat(F.lit("doc/"), F.col("vec_id"), F.lit(".txt")).alias("file"), "distance")
    return chunks.drop("vector").join(F.broadcast(near), "file")  # 30 rows


def _hybrid(spark: SparkSession, sf_dir: str, text: str, limit: int | None = 20, scorer=None) -> DataFrame:
    """One lazy plan over the stored chunks; the full-text leg is served from the postings. The keyword leg reads the texts
    where they lie: to deal them out takes the same scan, and a shuffle of every text with a hit."""
    store = served(spark, sf_dir)
    chunks = store.chunks()
    return fusion.hybrid_search(chunks, files(spark, sf_dir), text, limit=limit, semantic=_semantic(spark, sf_dir, chunks), scorer=scorer, full_text=store.search_text(text, fusion.LIMITS["fts"]))


def _apart(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The same with legs that run side by side, as the command line searches."""
    store = served(spark, sf_dir)
    chunks = store.chunks()
    legs = fusion.legs_of(chunks, files(spark, sf_dir), text, semantic=_semantic(spark, sf_dir, chunks))
    legs["fts"] = lambda: fusion.full_text_leg(store.search_text(text, fusion.LIMITS["fts"]))
    return fusion.run_apart(spark, legs, text, 20, seconds=dict.fromkeys(legs, 3600.0))


def _legs_sql(text: str, terms: list[str]) -> str:
    kind = fusion.classify(text)
    weights = fusion.WEIGHTS[kind]
    symbol = "SELECT * FROM sym" if kind != "natural_language" else "SELECT * FROM sym WHERE false"
    share = " + ".join(f"coalesce({weights[leg]}::DOUBLE / (60 + min(CASE WHEN leg = '{leg}' THEN rank END)), 0.0::DOUBLE)" for leg in fusion.LEGS)
    return f"""
WITH RECURSIVE {FILES}, {windows(80, 20)},
k AS (SELECT *, regexp_extract(text, '^[A-Za-z]+') AS symbol_name FROM c), {_Q},
near AS (SELECT 'doc/' || vec_id || '.txt' AS file, round(list_cosine_distance(v, q), 6) AS d FROM e, q ORDER BY d, vec_id LIMIT 30),
sem AS (SELECT repo, file, start_line, row_number() OVER (ORDER BY d, repo, file, start_line) AS rank, 'semantic' AS leg, 1 AS n FROM (SELECT * FROM k JOIN near USING (file) ORDER BY d, repo, file, start_line LIMIT 30)),
sym AS (SELECT repo, file, start_line, row_number() OVER (ORDER BY s DESC, repo, file, start_line) AS rank, 'symbol' AS leg, 2 AS n FROM (
  SELECT *, {_TIER.format(q=f"'{text}'")} AS s FROM k WHERE contains(symbol_name, '{text}') ORDER BY s DESC, repo, file, start_line LIMIT 10)),
{bm25_sql('k', terms)},
fts AS (SELECT repo, file, start_line, row_number() OVER (ORDER BY round(score, 6) DESC, repo, file, start_line) AS rank, 'fts' AS leg, 3 AS n FROM (SELECT * FROM scored ORDER BY round(score, 6) DESC, repo, file, start_line LIMIT 30)),
{_LINES.format(q=text)},
few AS (SELECT * FROM hits ORDER BY repo, file, line LIMIT 50),
mapped AS (SELECT repo, file, line, coalesce(start_line, line) AS start_line FROM (
  SELECT h.repo, h.file, h.line, k.start_line, row_number() OVER (PARTITION BY h.repo, h.file, h.line ORDER BY k.end_line - k.start_line, k.start_line) AS z
  FROM few h LEFT JOIN k ON h.repo = k.repo AND h.file = k.file AND h.line BETWEEN k.start_line AND k.end_line) WHERE z = 1),
rg AS (SELECT repo, file, start_line, row_number() OVER (ORDER BY repo, file, min(line)) AS rank, 'ripgrep' AS leg, 4 AS n FROM mapped GROUP BY repo, file, start_line),
legs AS (SELECT * FROM sem UNION ALL {symbol} UNION ALL SELECT * FROM fts UNION ALL SELECT * FROM rg),
fused AS (SELECT repo, file, start_line, array_to_string(list_sort(list(DISTINCT leg)), ',') AS sources, count(DISTINCT leg) AS n_legs, {share} AS rrf_score, min(n * 1000 + rank) AS place
  FROM legs GROUP BY repo, file, start_line)"""


_FUSED = "repo, file, start_line, sources, CASE WHEN n_legs > 1 THEN 'combined' ELSE sources END AS match_type, round(rrf_score, 6) AS rrf_score"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("repo", "file", big("start_line").alias("start_line"), F.array_join("sources", ",").alias("sources"), "match_type", F.round("rrf_score", 6).alias("rrf_score"))


@query(_legs_sql("The", ["the"]) + f" SELECT {_FUSED} FROM fused ORDER BY round(fused.rrf_score, 12) DESC, place LIMIT 20")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_apart(spark, sf_dir, "The"))


@query(_legs_sql("of the", ["of", "the"]) + f" SELECT {_FUSED} FROM fused ORDER BY round(fused.rrf_score, 12) DESC, place LIMIT 20")
def hybrid_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_apart(spark, sf_dir, "of the"))


@query(_legs_sql("the St.", ["the", "st"]) + f" SELECT {_FUSED} FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_hybrid(spark, sf_dir, "the St.", None))


@query(_legs_sql("The", ["the"]) + " SELECT sources, count(*)::BIGINT AS n FROM fused GROUP BY sources")
def fusion_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, "The", None).groupBy(F.array_join("sources", ",").alias("sources")).agg(big(F.count("*")).alias("n"))


@query(
    _legs_sql("of the", ["of", "the"])
    + f""", g AS (SELECT repo, file, start_line, row_number() OVER (ORDER BY round(rrf_score, 12) DESC, place) AS spot FROM fused),
s AS (SELECT g.*, len(list_filter(['of', 'the'], lambda w: list_contains({TOKENS}, w)))::DOUBLE / 2 AS score FROM g JOIN k USING (repo, file, start_line))
SELECT repo, file, start_line, row_number() OVER (ORDER BY spot > 30, CASE WHEN spot <= 30 THEN score ELSE 0 END DESC, spot)::BIGINT AS place FROM s"""
)
def rerank_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _hybrid(spark, sf_dir, "of the", None, scorer=fusion.overlap_scorer("of the"))
    return done.select("repo", "file", big("start_line").alias("start_line"), big("place").alias("place"))
