from __future__ import annotations

import hashlib
import json
import re
import time
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstrata.functions import text as fn
from quillstrata.functions.similarity import change_ratio
from quillstrata.model import RESULT_COLUMNS, StoreError, conform
from quillstrata.operators import bm25, changes, embedding, fusion, history, keyword, structure, symbols, vector
from quillstrata.operators.embedding import HashBackend, HttpBackend, create_backend, embed_chunks
from quillstrata.plans import catalogue
from quillstrata.sources.files import pattern_regex
from quillstrata.sources.git import parse_name_status

QUERIES = {
    "getUser": "identifier", "get_user": "identifier", "User": "identifier", "a.b": "identifier", "HTTP": "identifier", "ÄÖ": "identifier", "user": "natural_language", "U": "natural_language",
    "123": "natural_language", "": "natural_language", "how does auth work": "natural_language", "how does getUser work": "mixed", "call User now": "mixed", "In the end": "natural_language",
    "Use the end": "mixed", "the end.": "mixed", "the HTTP call": "natural_language",
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_query_classes(spark):
    rows = spark.createDataFrame([(q,) for q in QUERIES], "q string").select("q", fn.query_class(F.col("q")).alias("c")).collect()
    assert {r.q: r.c for r in rows} == QUERIES
    assert {q: fusion.classify(q) for q in QUERIES} == QUERIES


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\nb", "a\r\nb\r", "\n\n", "a\x0bb\x85c d\x1ce", "x\n\r\ny"])
def test_lines_are_those_of_splitlines(spark, text):
    assert one(spark, fn.lines(F.lit(text))) == text.splitlines()


@pytest.mark.parametrize(("text", "want"), [("", [""]), ("\n", [""]), ("a\n\n", ["a", ""]), ("a\rb\r\nc\x85d", ["a\rb\r", "c\x85d"]), ("a\nb\nc\nd\n", ["a", "b", "c", "d"])])
def test_fed_lines_are_those_of_sql(spark, tmp_path, text, want):
    assert one(spark, fn.fed_lines(F.lit(text))) == want
    spark.createDataFrame([(1, text, "en", "s"), (2, None, None, None)], "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: (r.part, r.n_lines) for r in catalogue.QUERIES["cat_lines"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows == {i: (p, n) for i, p, n in con.execute(f"SELECT doc_id, part, n_lines FROM ({catalogue.ORACLE_SQL['cat_lines']})").fetchall()}


def test_text_functions(spark):
    assert one(spark, fn.signature(F.lit("def f():  \n  x"))) == "def f():" and len(one(spark, fn.signature(F.lit("y" * 300)))) == 203
    assert one(spark, fn.preview(F.lit("a\nb"), 2)) == "a ..." and one(spark, fn.preview(F.lit("a\nb"))) == "a b"
    assert one(spark, fn.line_slice(F.lit("a\nb\nc\nd"), 2, 3)) == "b\nc" and one(spark, fn.line_slice(F.lit("\n".join(map(str, range(100)))), 1)).count("\n") == 50
    assert [one(spark, fn.extension_of(F.lit(p))) for p in ("a/b.PY", "Makefile", ".bashrc", "a.b/c", "x.tar.gz", "d/.a.b")] == [".py", "", "", "", ".gz", ".b"]
    assert one(spark, fn.distance_score(F.lit(None).cast("double"))) == 1.0 and one(spark, fn.distance_score(F.lit(1.0))) == 0.5
    assert one(spark, fn.match_type(F.array().cast("array<string>"))) == "" and one(spark, fn.match_type(F.array(F.lit("a"), F.lit("b")))) == "combined"
    assert one(spark, fn.parent_context(F.lit("A"), F.lit("class A"))) == "A: class A"


def test_change_ratio():
    assert change_ratio("", "") == change_ratio(None, "") == 0.0 and change_ratio("a", "") == 1.0
    assert 0 < change_ratio("abcd", "abce") < 0.5


@pytest.fixture
def files(spark):
    rows = [("r1", "a.py", "alpha beta\nC++ code\nalpha\n"), ("r1", "lib/b.py", "alpha 100%\r\n"), ("r2", "it's.md", "beta alpha foo-bar"), ("r2", "yarn.lock", "alpha"), ("r2", "n", None)]
    return spark.createDataFrame(rows, "repo string, file string, text string")


def test_keyword(files):
    hits = lambda *a, **k: [(r.repo, r.file, r.line, r.text) for r in keyword.keyword_search(files, *a, **k).collect()]
    assert hits("alpha") == [("r1", "a.py", 1, "alpha beta"), ("r1", "a.py", 3, "alpha"), ("r1", "lib/b.py", 1, "alpha 100%"), ("r2", "it's.md", 1, "beta alpha foo-bar"), ("r2", "yarn.lock", 1, "alpha")]
    assert hits("C++") == [("r1", "a.py", 2, "C++ code")] and hits("100%")[0][1] == "lib/b.py" and hits("") == [] and hits("alpha", 0) == []
    assert [h[1] for h in hits("alpha", skip=True)] == ["a.py", "a.py", "it's.md"]
    assert [h[2] for h in hits("^alpha$", regex=True, repo="r1")] == [3]
    assert hits("alpha", max_columns=5) == [("r1", "a.py", 3, "alpha"), ("r2", "yarn.lock", 1, "alpha")]


def test_scanner_events(spark):
    good = json.dumps({"type": "match", "data": {"path": {"text": "/home/x/src/a.py"}, "lines": {"text": "hit\n"}, "line_number": 7}})
    events = spark.createDataFrame([(good,), ('{"type": "begin"}',), ("not json",), ('{"type": "match", "data": {}}',)], "value string")
    rows = keyword.scanner_events(events, {"home": "/home/x", "src": "/home/x/src/"}).collect()
    assert [tuple(r) for r in rows] == [("src", "a.py", 7, "hit")]
    assert keyword.scanner_events(events).head().file == "/home/x/src/a.py"


def chunk_rows(spark, rows):
    return conform(spark.createDataFrame(rows, "id string, repo string, file string, start_line int, end_line int, symbol_name string, text string"))


@pytest.fixture
def chunks(spark):
    return chunk_rows(spark, [
        ("1", "r", "a.py", 1, 10, "Service.process", "red green red"), ("2", "r", "a.py", 3, 5, "preprocessor", "green blue C++"), ("3", "r", "b.py", 1, 4, "process", "blue foo-bar baz"),
        ("4", "it's", "c.py", 1, 2, "__init__", "red"), ("5", "it's", "c.py", 4, 9, "xinita", ""), ("6", "r", "d.py", 1, 2, "calc_100%", "the red blue green"),
    ])


def test_bm25(chunks):
    ids = lambda q: [r.id for r in bm25.bm25(chunks, q).orderBy(F.desc("score"), "id").collect()]
    assert set(ids("red")) == {"1", "4", "6"} and ids("") == ids("!!") == [] and ids("C++") == ["2"] and set(ids("foo-bar")) == {"3"}
    assert ids('"green red"') == ["1"] and set(ids('"red blue" foo')) == {"6"} and ids('"blue red"') == []
    n, avg, df = 6, (3 + 3 + 4 + 1 + 0 + 4) / 6, 3
    want = np.log(1 + (n - df + 0.5) / (df + 0.5)) * 1 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / avg))
    assert bm25.bm25(chunks, "red").where("id = '4'").head().score == pytest.approx(want)


def test_postings_and_phrases(chunks):
    index = bm25.postings(chunks)
    rows = {(r.id, r.term): (r.tf, r.positions, r.len) for r in index.collect()}
    assert rows["1", "red"] == (2, [0, 2], 3) and ("5", "") not in rows
    assert [(r.id, r.at) for r in bm25.phrase_positions(chunks, ["red", "blue", "green"]).collect()] == [("6", 1)]


def test_symbol_tiers(chunks):
    found = [(r.symbol_name, r.score) for r in symbols.symbol_search(chunks, "process").collect()]
    assert found == [("process", 1.0), ("Service.process", 0.8), ("preprocessor", 0.5)]
    assert [r.symbol_name for r in symbols.symbol_search(chunks, "_init_").collect()] == ["__init__"]
    assert [r.symbol_name for r in symbols.symbol_search(chunks, "100%").collect()] == ["calc_100%"]
    assert [r.id for r in symbols.symbol_search(chunks, "__init__", repo="it's").collect()] == ["4"]
    assert symbols.symbol_search(chunks, "process", limit=2).count() == 2
    assert [r.symbol_name for r in symbols.list_symbols(chunks, "pro", "r", limit=2).collect()] == ["Service.process", "preprocessor"]


def test_resolve_symbol(spark):
    rows = chunk_rows(spark, [("1", "r", "src/a.py", 1, 2, "A.run", ""), ("2", "r", "src/a.py", 3, 4, "B.run", ""), ("3", "r", "src/b.py", 1, 2, "go", "")])
    told = lambda s, f: [(r.id, r.source) for r in symbols.resolve_symbol(rows, s, "r", f).collect()]
    assert told("B.run", "src/a.py") == [("2", "file_scoped_dotted")] and told("run", "src/a.py") == [("1", "file_scoped")]
    assert told("go", "b.py") == [("3", "global_fallback")] and told("go", "src/a.py") == []


def test_vector(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0]), (102, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id int, vector array<float>")
    q = rng.normal(size=8)
    for metric, want in (("cosine", 1 - x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))), ("l2", ((x - q) ** 2).sum(axis=1))):
        found = vector.vector_search(df.where("id < 102"), q.tolist(), 5, metric=metric, by=("id",)).collect()
        assert [r.id for r in found] == np.argsort(want)[:5].tolist()
        assert found[0].distance == pytest.approx(want.min(), rel=1e-6) and found[0].score == pytest.approx(1 / (1 + want.min()))
    assert vector.vector_search(df, q.tolist(), 100, by=("id",)).count() == 50
    for bad in ([], [float("nan")] * 8):
        with pytest.raises(StoreError):
            vector.distance(F.col("vector"), bad)
    assert [vector.n_cells(n) for n in (10, 10_000, 10**9)] == [16, 100, 4000]


def test_cells_have_high_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("cast(vec_id AS string) AS id", "embedding AS vector").persist()
    indexed, centres = vector.build_cells(df, df.count())
    assert indexed.count() == df.count()
    hit = n = 0
    for q in df.where("cast(id AS int) % 100 = 0").collect():
        exact = {r.id for r in vector.vector_search(df, q.vector, 10, by=("id",)).collect()}
        hit += len(exact & {r.id for r in vector.cell_search(indexed, centres, q.vector, 10, probes=8, by=("id",)).collect()})
        n += len(exact)
    assert hit / n >= 0.9
    df.unpersist()


def leg(spark, name, rows):
    full = [dict.fromkeys(RESULT_COLUMNS, "") | {"repo": r, "file": f, "start_line": s, "end_line": s + 5, "symbol_name": name} for r, f, s in rows]
    df = spark.createDataFrame([tuple(d[c] for c in RESULT_COLUMNS) + (k,) for k, d in enumerate(full)], ", ".join(f"{c} {'int' if c.endswith('line') else 'string'}" for c in RESULT_COLUMNS) + ", k int")
    return fusion.ranked(df, name, [F.col("k")])


def test_fusion(spark):
    legs = [leg(spark, "semantic", [("r", "a", 1), ("r", "b", 1), ("r", "a", 1)]), leg(spark, "fts", [("r", "b", 1), ("r", "c", 9)]), leg(spark, "ripgrep", [("r", "c", 9)])]
    w = fusion.WEIGHTS["mixed"]
    rows = fusion.in_order(fusion.fuse(legs, w)).collect()
    assert [(r.file, r.sources, r.match_type) for r in rows] == [("b", ["fts", "semantic"], "combined"), ("c", ["fts", "ripgrep"], "combined"), ("a", ["semantic"], "semantic")]
    assert rows[0].rrf_score == pytest.approx(1 / 62 + 1 / 61) and rows[2].rrf_score == pytest.approx(1 / 61)
    assert rows[0].symbol_name == "semantic" and rows[1].symbol_name == "fts"
    done = fusion.rerank(fusion.fuse(legs, w), lambda text: F.when(F.col("file") == "a", 1.0).otherwise(0.0), top=3).orderBy("place").collect()
    assert [r.file for r in done] == ["a", "b", "c"]
    assert [r.file for r in fusion.rerank(fusion.fuse(legs, w), lambda t: F.when(F.col("file") == "a", 1.0).otherwise(0.0), top=2).orderBy("place").collect()] == ["b", "c", "a"]


def test_lines_to_chunks(spark, chunks):
    hits = spark.createDataFrame([("r", "a.py", 4, "x"), ("r", "a.py", 8, "y"), ("r", "a.py", 11, "z"), ("r", "zz", 1, "w")], "repo string, file string, line bigint, text string")
    rows = {r.text: r.chunk and r.chunk.symbol_name for r in fusion.lines_to_chunks(hits, chunks, bin_lines=4).collect()}
    assert rows == {"x": "preprocessor", "y": "Service.process", "z": None, "w": None}
    lost = [r for r in fusion.as_results(fusion.lines_to_chunks(hits, chunks)).collect() if r.text == "z"][0]
    assert (lost.start_line, lost.end_line, lost.symbol_name) == (11, 11, "")


def test_hybrid(spark, chunks):
    files = chunks.select("repo", "file", F.lit("Service.process\nred").alias("text")).distinct()
    backend = HashBackend(32)
    with_vectors = embed_chunks(chunks.drop("vector"), backend)
    rows = fusion.hybrid_search(conform(with_vectors), files, "Service.process", backend.embed_query("red green"), 5).collect()
    assert rows[0].match_type == "combined" and {s for r in rows for s in r.sources} >= {"semantic", "symbol", "ripgrep"}
    assert {r.repo for r in fusion.hybrid_search(chunks, files, "red green", repo="it's").collect()} == {"it's"}
    assert fusion.hybrid_search(chunks.limit(0), files.limit(0), "nothing").collect() == []
    assert fusion.hybrid_search(chunks, files, "red", scorer=fusion.overlap_scorer("red")).count() > 0


def test_structure(spark):
    rows = [("r", "a.py", "class", "Box", "", 1, "python"), ("r", "a.py", "method", "Box.b", "Box", 9, "python"), ("r", "a.py", "function", "Box.a", "Box", 3, "python"), ("r", "b.go", "function", "Go", "", 2, "go"), ("r", "b.go", "preamble", "", "", 1, ""), ("s", "x", "fallback", "", "", 1, "md")]
    df = conform(spark.createDataFrame(rows, "repo string, file string, chunk_type string, symbol_name string, parent_symbol string, start_line int, language string"))
    r, s = structure.repo_map(df).orderBy("name").collect()
    assert (r.files, r.languages) == (2, {"python": 3, "go": 1}) and [(c.name, c.methods) for c in r.classes] == [("Box", ["a", "b"])] and [f.name for f in r.functions] == ["Go"]
    assert (s.name, s.classes, s.functions) == ("s", [], [])
    assert {x.repo: x.chunks for x in structure.repo_stats(df).collect()} == {"r": 5, "s": 1, None: 6}


def test_paths(spark):
    paths = spark.createDataFrame([("/a/b/c.py",), ("/a/x",), ("/ab/x",), ("rel",)], "path string")
    roots = {"a": "/a", "b": "/a/b/"}
    repo, file = structure.split_path(F.col("path"), roots)
    want = {("b", "c.py"), ("a", "x"), ("", "/ab/x"), ("", "rel")}
    assert {tuple(r) for r in paths.select(repo, file).collect()} == want
    table = spark.createDataFrame(list(roots.items()), "repo string, root string")
    assert {(r.repo, r.file) for r in structure.longest_root(paths, table).collect()} == want


def test_ignore_patterns(spark):
    cases = {"*.log": ["a.log", "d/a.log"], "/top": ["top", "top/x"], "dir/": ["dir/x", "a/dir/x"], "a/**/b": ["a/b", "a/x/y/b"], "doc/*.md": ["doc/a.md"], "f?o": ["foo"], "[ab].c": ["a.c"]}
    others = ["b.txt", "x/top", "dirx", "a/bb", "doc/x/a.md", "fooo", "c.c"]
    for pattern, inside in cases.items():
        df = spark.createDataFrame([(p,) for p in inside + others], "p string")
        assert {r.p for r in df.where(pattern_regex([pattern])(F.col("p"))).collect()} == set(inside), pattern
    df = spark.createDataFrame([("a.log",), ("keep.log",)], "p string")
    assert [r.p for r in df.where(pattern_regex(["*.log", "!keep.log"])(F.col("p"))).collect()] == ["a.log"]


def test_changes(spark):
    shape = "repo string, path string, hash string"
    old = spark.createDataFrame([("r", "same", "1"), ("r", "mod", "2"), ("r", "gone", "3"), ("r", "from", "4"), ("r", "c1", "5"), ("r", "c2", "5")], shape)
    new = spark.createDataFrame([("r", "same", "1"), ("r", "mod", "9"), ("r", "came", "8"), ("r", "to", "4"), ("r", "c3", "5")], shape)
    feed = {(r.path, r.status, r.old_path) for r in changes.change_feed(old, new).collect()}
    assert feed == {("mod", "M", None), ("gone", "D", None), ("came", "A", None), ("to", "R", "from"), ("c1", "D", None), ("c2", "D", None), ("c3", "A", None)}
    lines = spark.createDataFrame([("A\ta",), ("R100\to\tn",), ("C75\to\tc",), ("T\tt",), ("X",), ("",)], "value string")
    assert [tuple(r) for r in parse_name_status(lines).collect()] == [("A", "a", None), ("R", "n", "o"), ("A", "c", None), ("M", "t", None)]


def test_structural_diff(spark):
    shape = "k int, symbol_name string, signature string, text string"
    old = spark.createDataFrame([(1, "same", "s", "t"), (1, "gone", "s", "t"), (1, "sig", "a", "t"), (1, "small", "s", "x" * 100), (1, "large", "s", "abc")], shape)
    new = spark.createDataFrame([(1, "same", "s", "t"), (1, "new", "n", "t"), (1, "sig", "b", "t"), (1, "small", "s", "x" * 99 + "y"), (1, "large", "s", "xyz")], shape)
    rows = {r.symbol_name: (r.change_type, r.significance, r.old_signature, r.new_signature) for r in history.structural_diff(old, new, "k").collect()}
    assert rows == {
        "gone": ("removed", "major", "s", ""), "new": ("added", "major", "", "n"), "sig": ("signature_changed", "major", "a", "b"),
        "small": ("body_changed", "minor", "s", "s"), "large": ("body_changed", "refactor", "s", "s"),
    }


class Refuses:
    def __init__(self, bad: str, times: int = 99):
        self.bad, self.times, self.calls = bad, times, []

    def __call__(self, texts):
        import urllib.error

        self.calls.append(len(texts))
        if any(self.bad in t for t in texts) and self.times:
            self.times -= 1
            raise urllib.error.HTTPError("u", 500, "no", {}, None)
        return [[float(len(t))] for t in texts]


def test_http_backend_recovers():
    waits: list = []
    make = lambda post: HttpBackend("m", post=post, wait=waits.append, check=False)
    assert make(Refuses("b", 1)).embed_documents(["a", "bb"]) == [[1.0], [2.0]] and waits == [1]
    long = "bad" + "x" * 3000
    post = Refuses("x" * 2500)
    assert make(post).embed_documents(["a", "b", long, "ccc"]) == [[1.0], [1.0], [2000.0], [3.0]]
    import urllib.error

    with pytest.raises(urllib.error.HTTPError):
        make(Refuses("a")).embed_documents(["a"])

    def late(texts):
        raise TimeoutError

    waits.clear()
    with pytest.raises(TimeoutError):
        make(late).embed_query("a")
    assert waits == []

    def down(texts):
        raise ConnectionError

    with pytest.raises(ConnectionError):
        make(down).embed_query("a")
    assert waits == [1, 2]
    assert HttpBackend("nomic-embed-text", post=lambda t: [[float(t[0].startswith("search_query: "))]], check=False).embed_query("q") == [1.0]


def test_backends(spark):
    b = create_backend("hash", "64")
    assert b.dims() == 64 and b.model_name() == "hash-64" and b.embed_query("a b") == b.embed_documents(["a b"])[0]
    near, far = np.dot(b.embed_query("red green"), b.embed_query("green red x")), np.dot(b.embed_query("red green"), b.embed_query("other words"))
    assert near > far and sum(b.embed_query("")) == 0
    with pytest.raises(ValueError):
        create_backend("nothing")
    rows = embed_chunks(spark.createDataFrame([(str(i), f"text {i}") for i in range(100)], "id string, text string"), b).collect()
    assert all(np.allclose(r.vector, b.embed_query(r.text), atol=1e-6) for r in rows)


def test_http_backend_checks_the_answer():
    backend = HttpBackend("m", post=lambda texts: [[1.0]] * (len(texts) - 1), wait=lambda s: None, check=False)
    with pytest.raises(ValueError, match="1 vectors for 2 texts"):
        backend.embed_documents(["a", "b"])


def test_legs_that_fail_or_hang_are_left_out(spark, chunks):
    rows = conform(chunks)
    files = rows.select("repo", "file", "text")
    legs = fusion.legs_of(rows, files, "red")
    said: list[str] = []
    want = [tuple(r) for r in fusion.run_apart(spark, legs, "red", say=said.append).collect()]
    assert want and not said
    lazy = [r.start_line for r in fusion.hybrid_search(rows, files, "red").collect()]
    assert [r.start_line for r in fusion.run_apart(spark, legs, "red").collect()] == lazy

    def broken():
        raise ValueError("no index")

    def slow():
        time.sleep(30)
        return legs["fts"]()

    some = fusion.run_apart(spark, {**legs, "semantic": broken, "fts": slow}, "red", seconds={"fts": 0.2, "ripgrep": 60.0, "semantic": 60.0}, say=said.append).collect()
    assert some and len(said) == 2 and "semantic" in " ".join(said) and "fts" in " ".join(said)
    assert all("fts" not in r.sources for r in some)
    with pytest.raises(ValueError):
        fusion.run_apart(spark, {"semantic": broken}, "red")


def test_reranking_by_a_model_leaves_results_alone_if_it_fails():
    rows = [{"text": t, "rerank_score": 0.0} for t in ("a", "bbb", "cc")]
    assert [r["text"] for r in fusion.reranked(rows, "q", lambda pairs: [len(t) for _, t in pairs], top=2)] == ["bbb", "a", "cc"]
    said: list[str] = []
    assert fusion.reranked(rows, "q", lambda pairs: [1.0], say=said.append) == rows and said
    assert fusion.reranked(rows, "q", lambda pairs: 1 / 0, say=said.append) == rows and len(said) == 2


def test_postings_in_pieces(monkeypatch):
    words = "red green blue grey red red".split()
    rows = [(f"i{k // 2 if k < 8 else k}", "r", None if k == 5 else [words[(k * j) % 6] for j in range(k % 7)]) for k in range(30)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("id", "repo", "_t"), r, strict=True)) for r in rows[a:b]], pa.schema([("id", pa.string()), ("repo", pa.string()), ("_t", pa.list_(pa.string()))])) for a, b in ((0, 3), (3, 3), (3, 20), (20, 30))]
    want: dict = {}
    for i, repo, toks in rows:
        for at, t in enumerate(toks or []):
            want.setdefault((t, i, repo), []).append(at)
    for run in (1, 7, 1 << 21):  # rows of one key (i0 to i3) stay in one piece
        monkeypatch.setattr(bm25, "RUN", run)
        pieces = list(bm25._cut(iter(batches), ["id", "repo"]))
        assert sum(p.num_rows for p in pieces) == 30 and (len(pieces) == 1) == (run > 1000)
        lists = [[r for b in bm25._listed(p, ["repo"]) for r in b.to_pylist()] for p in pieces]
        assert all([r["term"] for r in x] == sorted(r["term"] for r in x) for x in lists)
        found = [((r["term"], r["id"], r["repo"]), r["positions"]) for x in lists for r in x]
        assert len(found) == len(want) and dict(found) == {k: sorted(v) for k, v in want.items()}
        assert all(r["tf"] == len(r["positions"]) for x in lists for r in x)
    assert list(bm25._cut(iter([]), ["id"])) == []


def test_hash_backend_hashes_a_repeated_word_once(monkeypatch):
    asked = []
    own = lambda data, digest_size: asked.append(data) or hashlib.blake2b(data, digest_size=digest_size)
    monkeypatch.setattr(embedding, "hashlib", SimpleNamespace(blake2b=own))
    text = "Zqxj zqxj_É " * 500 + "the" + "\ud800"
    found = HashBackend(16).embed_query(text)
    assert len(asked) < 30
    out = np.zeros(16)
    for word in re.findall(r"\w+", text.lower()):
        for weight, part in ((1.0, f"<{word}>"), *((0.25, f"<{word}>"[i : i + 3]) for i in range(len(word)))):
            h = int.from_bytes(hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            out[h % 16] += weight if h >> 63 else -weight
    assert found == (out / np.sqrt(out @ out)).tolist() and HashBackend(16).embed_query(" ") == [0.0] * 16
