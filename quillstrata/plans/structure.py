"""Queries over the structure of a collection, its storage and its history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstrata.functions import text as fn
from quillstrata.functions.similarity import changed
from quillstrata.operators import changes, history, structure
from quillstrata.plans.base import FILES, big, files, query, table
from quillstrata.sources.git import parse_log, parse_name_status

# structure


@query(f"WITH {FILES} SELECT repo, count(*)::BIGINT AS chunks FROM f GROUP BY ROLLUP (repo)")
def repo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repo_stats(files(spark, sf_dir))


@query(f"WITH {FILES} SELECT repo, lang AS language, count(*)::BIGINT AS n FROM f WHERE lang <> '' GROUP BY repo, lang")
def repo_map_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.language_counts(_symbols(spark, sf_dir, files(spark, sf_dir)))


@query(f"WITH {FILES} SELECT repo, count(DISTINCT file)::BIGINT AS files FROM f GROUP BY repo")
def repo_map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.file_counts(_symbols(spark, sf_dir, files(spark, sf_dir)))


def _symbols(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return rows.select("repo", "file", F.col("lang").alias("language"), F.lit("").alias("symbol_name"), F.lit("fallback").alias("chunk_type"), F.lit("").alias("signature"), F.lit("").alias("parent_symbol"), F.lit(1).alias("start_line"))


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as classes, nations as their methods, and suppliers as functions of each nation's file."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    shape = ["repo", "file", "language", "symbol_name", "chunk_type", "signature", "parent_symbol", "start_line"]
    named = lambda df, file, name, kind, line: df.select(
        F.lit("world").alias("repo"), file.alias("file"), F.lit("geo").alias("language"), name.alias("symbol_name"), F.lit(kind).alias("chunk_type"), F.lit("").alias("signature"), F.lit("").alias("parent_symbol"), line.cast("int").alias("start_line")
    )
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    classes = named(region, F.lit("region.geo"), F.col("r_name"), "class", F.col("r_regionkey"))
    methods = named(n, F.lit("nation.geo"), F.concat_ws(".", "r_name", "n_name"), "method", F.col("n_nationkey"))
    functions = named(supplier, F.concat(F.lit("s"), F.col("s_nationkey")), F.col("s_name"), "function", F.col("s_suppkey"))
    return classes.unionByName(methods).unionByName(functions).select(*shape)


@query("""
SELECT r_name AS class_name, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS methods
FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name
""")
def class_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.classes(_geography(spark, sf_dir)).select(F.col("name").alias("class_name"), F.array_join("methods", ",").alias("methods"))


@query("SELECT 'world' AS repo, 's' || s_nationkey AS file, s_name AS name, s_suppkey::BIGINT AS line FROM supplier")
def repo_map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.functions(_geography(spark, sf_dir)).select("repo", "file", "name", big("line").alias("line"))


@query("""
SELECT 'world' AS name, (SELECT count(*) FROM region WHERE r_regionkey >= 0)::BIGINT AS classes, (SELECT count(DISTINCT 's' || s_nationkey) FROM supplier)::BIGINT + 2 AS files,
  (SELECT string_agg(r_name || ':' || n, ',' ORDER BY r_regionkey) FROM (SELECT r_regionkey, r_name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL)) AS methods
""")
def repo_map_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of one repo, whose lists are those of the fixed tables region and nation; functions are left out."""
    chunks = _geography(spark, sf_dir).withColumn("symbol_name", F.when(F.col("chunk_type") == "function", "").otherwise(F.col("symbol_name")))
    rows = structure.repo_map(chunks)
    methods = F.array_join(F.transform(F.sort_array(F.transform("classes", lambda c: F.struct(c["line"], c["name"], F.size(c["methods"]).alias("n")))), lambda c: F.concat_ws(":", c["name"], c["n"])), ",")
    return rows.select("name", big(F.size("classes")).alias("classes"), "files", methods.alias("methods"))


_ROOTS = """r AS (SELECT DISTINCT 'site' AS repo, regexp_extract(url, '^[a-z]+://[^/?#]+') AS root FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT DISTINCT 'lang', regexp_extract(url, '^[a-z]+://[^/?#]+/[^/?#]+') FROM pages WHERE page_id % 3 = 0 AND regexp_extract(url, '^[a-z]+://[^/?#]+/[^/?#]+') <> '')"""


@query(f"""
WITH {_ROOTS}, m AS (SELECT page_id, url, arg_max(r.repo, len(root)) AS repo, max(len(root)) AS n FROM pages LEFT JOIN r ON starts_with(url, root || '/') GROUP BY page_id, url)
SELECT page_id, coalesce(repo, '') AS repo, CASE WHEN repo IS NULL THEN url ELSE substr(url, n + 2) END AS file FROM m
""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    site = F.regexp_extract("path", "^[a-z]+://[^/?#]+", 0)
    lang = F.regexp_extract("path", "^[a-z]+://[^/?#]+/[^/?#]+", 0)
    roots = pages.where("page_id % 2 = 0").select(F.lit("site").alias("repo"), site.alias("root")).distinct()
    roots = roots.unionByName(pages.where("page_id % 3 = 0").select(F.lit("lang").alias("repo"), lang.alias("root")).where("root <> ''").distinct())
    return structure.longest_root(pages, roots).select("page_id", "repo", "file")


@query(r"""
SELECT page_id, CASE WHEN starts_with(url, 'https://www.') THEN 'www' WHEN starts_with(url, 'https:/') THEN 'secure' ELSE '' END AS repo FROM pages
""")
def path_to_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace("url", "^https://www[.]", "https://www./")
    repo, _ = structure.split_path(url, {"secure": "https:", "www": "https://www."})
    return table(spark, sf_dir, "pages").select("page_id", repo.alias("repo"))


@query("""
WITH c AS (SELECT c_nationkey AS k, count(*)::BIGINT AS chunks FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey),
d AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'sha' || n_nationkey END AS sha FROM nation WHERE n_nationkey < 20)
SELECT n_name AS repo, CASE WHEN n_nationkey % 7 = 0 THEN 'path missing' WHEN sha IS NOT NULL THEN 'indexed' ELSE 'not indexed' END AS status, coalesce(chunks, 0)::BIGINT AS chunks, coalesce(sha, '') AS sha
FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN d ON d.k = n_nationkey
""")
def repo_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    repos = nation.select("n_nationkey", F.col("n_name").alias("repo"), (F.col("n_nationkey") % 7 != 0).alias("path_ok"))
    catalog = nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("sha"), F.col("n_nationkey"))).alias("sha"))
    counts = customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("j")).agg(F.count("*").alias("chunks"))
    rows = repos.join(catalog, F.col("n_nationkey") == F.col("k"), "left").join(counts, F.col("n_nationkey") == F.col("j"), "left")
    status = F.when(~F.col("path_ok"), "path missing").when(F.col("sha").isNotNull(), "indexed").otherwise("not indexed")
    return rows.select("repo", status.alias("status"), big(F.coalesce("chunks", F.lit(0))).alias("chunks"), F.coalesce("sha", F.lit("")).alias("sha"))


# storage


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = files(spark, sf_dir).select("doc_id", "repo", "file", "text")
    return rows.where("doc_id % 3 <> 0"), rows.where("doc_id % 2 = 0 OR doc_id % 3 = 0").withColumn("text", F.upper(F.lit("new")))


@query(f"WITH {FILES}, o AS (SELECT doc_id, text FROM f WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, 'NEW' AS text FROM f WHERE doc_id % 2 = 0 OR doc_id % 3 = 0) SELECT doc_id, md5(text) AS text_md5 FROM (SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n)")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return changes.upsert(old, new, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query(f"WITH {FILES} SELECT doc_id FROM f WHERE doc_id IN (SELECT doc_id FROM labels)")
def delete_stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    current = rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return changes.without_stale_files(rows, current).select("doc_id")


@query(f"WITH {FILES} SELECT doc_id FROM f WHERE NOT (doc_id % 5 < 2 AND doc_id NOT IN (SELECT doc_id FROM labels))")
def delete_stale_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "doc_id", "repo", "file")
    valid = rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return changes.without_stale_chunks(rows, rows.where("doc_id % 5 < 2"), valid).select("doc_id")


_FEED = f"""WITH {FILES}, o AS (SELECT repo, file AS path, sha256(text) AS h FROM f WHERE doc_id % 5 <> 0),
n AS (SELECT repo, CASE WHEN doc_id % 11 = 0 THEN file || '.moved' ELSE file END AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM f WHERE doc_id % 4 <> 0),
b AS (SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.path, n.path) AS path, o.h AS oh, n.h AS nh FROM o FULL JOIN n ON o.repo = n.repo AND o.path = n.path),
s AS (SELECT repo, path, coalesce(nh, oh) AS h, CASE WHEN oh IS NULL THEN 'A' WHEN nh IS NULL THEN 'D' ELSE 'M' END AS status FROM b WHERE oh IS NULL OR nh IS NULL OR oh <> nh),
a1 AS (SELECT repo, h, min(path) AS path FROM s WHERE status = 'A' GROUP BY repo, h HAVING count(*) = 1),
d1 AS (SELECT repo, h, min(path) AS path FROM s WHERE status = 'D' GROUP BY repo, h HAVING count(*) = 1),
r AS (SELECT a1.repo, a1.path, 'R' AS status, d1.path AS old_path FROM a1 JOIN d1 ON a1.repo = d1.repo AND a1.h = d1.h),
feed AS (SELECT repo, path, status, NULL::VARCHAR AS old_path FROM s WHERE (repo, path) NOT IN (SELECT (repo, path) FROM r) AND (repo, path) NOT IN (SELECT (repo, old_path) FROM r) UNION ALL SELECT * FROM r)"""


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    old = rows.where("doc_id % 5 <> 0").select("repo", F.col("file").alias("path"), F.sha2("text", 256).alias("hash"))
    path = F.when(F.col("doc_id") % 11 == 0, F.concat("file", F.lit(".moved"))).otherwise(F.col("file"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return changes.change_feed(old, rows.where("doc_id % 4 <> 0").select("repo", path.alias("path"), F.sha2(text, 256).alias("hash")))


@query(_FEED + " SELECT repo, path, status, old_path FROM feed")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir)


@query(_FEED + " SELECT count(*) FILTER (status = 'A')::BIGINT AS added, count(*) FILTER (status = 'M')::BIGINT AS modified, count(*) FILTER (status = 'D')::BIGINT AS deleted, count(*) FILTER (status = 'R')::BIGINT AS renamed FROM feed")
def incremental_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.change_counts(_feed(spark, sf_dir))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'full: forced' WHEN o_orderkey % 7 = 0 THEN 'full: pending' WHEN o_orderkey % 5 = 0 THEN 'full: first index'
  WHEN o_orderstatus <> 'F' AND o_orderkey % 3 = 0 THEN 'full: branch changed' WHEN o_orderkey % 2 = 0 THEN 'skipped: up to date' ELSE 'incremental' END AS mode FROM orders
""")
def staleness_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstrata.indexing import decision

    k = F.col("o_orderkey")
    stored_sha = F.when(k % 5 != 0, F.lit("a"))
    branch = F.when((F.col("o_orderstatus") != "F") & (k % 3 == 0), F.lit("dev")).otherwise("main")
    mode: Column = decision(full=k % 10 == 0, pending=k % 7 == 0, stored_sha=stored_sha, stored_branch=F.lit("main"), sha=F.when(k % 2 == 0, F.lit("a")).otherwise("b"), branch=branch)
    return table(spark, sf_dir, "orders").select("o_orderkey", mode.alias("mode"))


# history


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query("SELECT conv_id, role, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations GROUP BY conv_id, role")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _turns(spark, sf_dir).select("conv_id", F.col("role").alias("symbol_name"), F.col("turn").cast("string").alias("signature"), "text", F.col("turn").alias("chunk_index"))
    last = history.last_definitions(chunks, "conv_id")
    return last.select("conv_id", F.col("symbol_name").alias("role"), "text", big("signature").alias("turn"))


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each turn of a conversation as a file's version, before and after: words are symbols, the number of times they occur
    is the signature. Versions are keyed by the turn that comes after; the last turn is no one's predecessor."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.explode(fn.tokens(F.col("text"))).alias("symbol_name"))
    counted = rows.groupBy("conv_id", "turn", "symbol_name").agg(F.count("*").alias("n"))
    shaped = counted.select("conv_id", "turn", "symbol_name", (F.col("n") > 1).cast("string").alias("signature"), F.col("n").cast("string").alias("text"))
    return _neighbours(spark, sf_dir, shaped)


def _neighbours(spark: SparkSession, sf_dir: str, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old, new) of versions by turn, where old ones have the number of the next turn, for each two turns in a row."""
    turns = _turns(spark, sf_dir).select("conv_id", "turn").distinct()
    pairs = turns.join(turns.select("conv_id", (F.col("turn") + 1).alias("turn")), ["conv_id", "turn"], "left_semi")
    old = versions.withColumn("turn", F.col("turn") + 1)
    return old.join(pairs, ["conv_id", "turn"], "left_semi"), versions.join(pairs, ["conv_id", "turn"], "left_semi")


@query(r"""
WITH t AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda z: z <> '')) AS w FROM conversations),
v AS (SELECT conv_id, turn, w, count(*) AS n FROM t GROUP BY conv_id, turn, w),
k AS (SELECT DISTINCT a.conv_id, a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
o AS (SELECT v.conv_id, v.turn + 1 AS turn, w, n FROM v JOIN k ON v.conv_id = k.conv_id AND v.turn + 1 = k.turn), p AS (SELECT v.* FROM v JOIN k USING (conv_id, turn))
SELECT coalesce(o.conv_id, p.conv_id) AS conv_id, coalesce(o.turn, p.turn)::BIGINT AS turn, coalesce(o.w, p.w) AS symbol_name,
  CASE WHEN o.n IS NULL THEN 'added' WHEN p.n IS NULL THEN 'removed' WHEN (o.n > 1) <> (p.n > 1) THEN 'signature_changed' ELSE 'body_changed' END AS change_type,
  CASE WHEN o.n IS NULL OR p.n IS NULL OR (o.n > 1) <> (p.n > 1) THEN 'major' ELSE 'minor' END AS significance
FROM o FULL JOIN p ON o.conv_id = p.conv_id AND o.turn = p.turn AND o.w = p.w WHERE o.n IS NULL OR p.n IS NULL OR o.n <> p.n
""")
def structural_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two(spark, sf_dir)
    return history.structural_diff(old, new, "conv_id", "turn", ratio=False).select("conv_id", big("turn").alias("turn"), "symbol_name", "change_type", "significance")


@query()
def structural_diff_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the share of each body that changed, which SQL can't compute."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.lit("said").alias("symbol_name"), F.lit("").alias("signature"), "text")
    old, new = _neighbours(spark, sf_dir, rows)
    return history.structural_diff(old, new, "conv_id", "turn").select("conv_id", big("turn").alias("turn"), "change_type", "significance")


@query()
def change_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.previous_version(_turns(spark, sf_dir), ["conv_id"], ["turn"])
    return rows.select("conv_id", "turn", F.round(changed(F.col("previous_text"), F.col("text")), 6).alias("ratio"))


@query("SELECT conv_id, turn, md5(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS previous_md5 FROM conversations")
def prev_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.previous_version(_turns(spark, sf_dir), ["conv_id"], ["turn"])
    return rows.select("conv_id", "turn", F.md5("previous_text").alias("previous_md5"))


@query("""
WITH n AS (SELECT conv_id, turn, ((len(text) - len(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM conversations),
p AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY conv_id ORDER BY turn), 0)::BIGINT AS previous FROM n)
SELECT conv_id, turn, n AS occurrences, previous FROM p WHERE n <> previous
""")
def pickaxe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.pickaxe(_turns(spark, sf_dir), "the", ["conv_id"], ["turn"]).select("conv_id", "turn", "occurrences", "previous")


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("r"), F.col("user_id") % 3).alias("repo"), F.concat(F.lit("f"), F.col("user_id") % 50).alias("file"), F.concat(F.lit("sha"), F.col("event_id")).alias("sha"),
        F.concat(F.lit("u"), F.col("user_id")).alias("author"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("date"), F.col("event_type").alias("message"), "value",
    )


_COMMITS = "e AS (SELECT 'r' || (user_id % 3) AS repo, 'f' || (user_id % 50) AS file, 'sha' || event_id AS sha, date_trunc('second', ts) AS moment, event_type, value FROM events)"
_SCOPE = "s AS (SELECT repo, file FROM (SELECT repo, file, min(value) AS v FROM e GROUP BY repo, file) ORDER BY v, repo, file LIMIT 5)"


@query(f"WITH {_COMMITS}, {_SCOPE} SELECT repo, file FROM s")
def timeline_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _commits(spark, sf_dir).withColumn("symbol_name", F.lit(""))
    return history.scope_files(found, [F.col("value"), F.col("repo"), F.col("file")]).select("repo", "file")


@query(f"""
WITH {_COMMITS}, {_SCOPE}, h AS (
  SELECT e.repo, e.file, sha, moment, 'direct' AS relevance FROM e JOIN s ON e.repo = s.repo AND e.file = s.file
  UNION ALL SELECT repo, '', sha, moment, 'related' FROM e WHERE event_type = 'purchase')
SELECT repo, file, sha, relevance, strftime(moment, '%Y-%m-%d') AS day FROM h ORDER BY moment DESC, repo, sha, file LIMIT 40
""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _commits(spark, sf_dir)
    scope = history.scope_files(commits.withColumn("symbol_name", F.lit("")), [F.col("value"), F.col("repo"), F.col("file")])
    found = history.timeline(commits, scope, commits.where("message = 'purchase'"), 40)
    return found.select("repo", "file", "sha", "relevance", fn.short_date(F.col("date")).alias("day"))


@query("SELECT substr('c' || event_id || 'abcdefgh', 1, 7) AS sha, 'u|' || user_id AS author, event_type || ' x' AS message FROM events")
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    line = F.concat_ws("\0", F.concat(F.lit("c"), F.col("event_id"), F.lit("abcdefgh")), F.concat(F.lit("u|"), F.col("user_id")), F.lit("2024-01-01T00:00:00+00:00"), F.concat("event_type", F.lit(" x")))
    return history.short(parse_log(e.select(line.alias("value")))).select("sha", "author", "message")


@query("SELECT CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' WHEN 3 THEN 'R' ELSE 'A' END AS status, 'n' || event_id AS path, CASE WHEN event_id % 5 = 3 THEN 'o' || event_id END AS old_path FROM events")
def name_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    new = F.concat(F.lit("n"), k)
    old = F.concat(F.lit("o"), k)
    line = F.when(k % 5 == 0, F.concat(F.lit("A\t"), new)).when(k % 5 == 1, F.concat(F.lit("M\t"), new)).when(k % 5 == 2, F.concat(F.lit("D\t"), new)).when(k % 5 == 3, F.concat(F.lit("R087\t"), old, F.lit("\t"), new)).otherwise(F.concat(F.lit("C100\t"), old, F.lit("\t"), new))
    rows = table(spark, sf_dir, "events").select(F.explode(F.array(line, F.lit(""), F.lit("broken"))).alias("value"))
    return parse_name_status(rows)


@query("""
WITH t AS (SELECT vec_id, label, (vec_id % 7) / 4.0::DOUBLE AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 100)
SELECT vec_id, to_json({'rank': row_number() OVER (ORDER BY score DESC, vec_id)::BIGINT, 'label': label::BIGINT, 'score': round(score, 4)})::VARCHAR AS json FROM t
""")
def render_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of the best 100 rows, which its limit bounds before it is numbered."""
    score = (F.col("vec_id") % 7) / F.lit(4.0)
    best = table(spark, sf_dir, "embeddings").select("vec_id", "label", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(100)
    ranked = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "vec_id")))
    return ranked.select("vec_id", F.to_json(F.struct(big("rank").alias("rank"), big("label").alias("label"), F.bround("score", 4).alias("score"))).alias("json"))
