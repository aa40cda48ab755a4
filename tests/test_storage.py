"""The table on disk, the catalog, indexing of git repos, the command line and the stream."""

from __future__ import annotations

import json
import os
import shutil
import subprocess

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstrata import cli, config, indexing
from quillstrata.catalog import Catalog
from quillstrata.model import StoreError, conform
from quillstrata.operators import bm25
from quillstrata.operators.chunking import chunk_files
from quillstrata.operators.embedding import HashBackend, embed_chunks
from quillstrata.plans import catalogue, stored
from quillstrata.sources import files as sources
from quillstrata.sources import git
from quillstrata.store import BUCKETS, ChunkStore
from quillstrata.streaming import ingest
from quillstrata.streaming.ingest import SCHEMA, apply_changes


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, tmp_path / "store")


def chunked(spark, rows, dims=16):
    return embed_chunks(chunk_files(spark.createDataFrame(rows, "repo string, file string, text string")), HashBackend(dims))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


CODE = "def one():\n    return 1\n\ndef two():\n    return 2\n"


def test_store(spark, store):
    assert store.chunks().count() == 0 and store.search_symbol("x").collect() == [] and store.build_text_index() is None and store.list_profiles() == []
    a = chunked(spark, [("r", "a.py", CODE), ("it's", "b'c.py", CODE)])
    store.upsert(a)
    before = ids(store.chunks())
    store.upsert(a)
    assert ids(store.chunks()) == before and len(before) == 4
    assert store.stats() == {"total": 4, "repos": {"r": 2, "it's": 2}}
    assert [r.symbol_name for r in store.search_symbol("one", "it's").collect()] == ["one"]
    assert store.find_chunk("r", "a.py", 5).head().symbol_name == "two" and store.find_chunk("r", "a.py", 99).head() is None
    assert [r.start_line for r in store.chunks_of_file("r", "a.py").collect()] == [1, 4]
    with pytest.raises(StoreError):
        store.upsert(chunked(spark, [("r", "a.py", CODE)], 8))
    with pytest.raises(StoreError):
        store.search_vector([1.0] * 8)
    assert store.search_vector(HashBackend(16).embed_query("return 1"), 3, "r").count() == 2
    assert store.build_text_index() == "3" and store.postings_of(["one", "zzz"]).count() == 2 and store.build_vector_index() is None
    store.delete_files("r", ["a.py"])
    assert store.stats()["repos"] == {"it's": 2} and store.postings_of(["one"]) is None
    store.compact()
    store.delete_repo("it's")
    assert store.chunks().count() == 0
    store.drop("default")
    assert store.list_profiles() == []


def test_stale_rows_and_profiles(spark, store):
    rows = chunked(spark, [("r", "a.py", CODE), ("r", "b.py", CODE)])
    store.upsert(rows)
    store.upsert(chunked(spark, [("r", "z.py", CODE)], 8), "other")
    valid = store.chunks().where("symbol_name = 'one'").select("file", "id")
    store.delete_stale_chunks("r", spark.createDataFrame([("r", "a.py")], "repo string, file string"), valid)
    assert sorted((r.file, r.symbol_name) for r in store.chunks().collect()) == [("a.py", "one"), ("b.py", "one"), ("b.py", "two")]
    store.delete_stale_files("r", spark.createDataFrame([("r", "b.py")], "repo string, file string"))
    assert {r.file for r in store.chunks().collect()} == {"b.py"}
    assert store.list_profiles() == ["default", "other"] and store.chunks("other").count() == 2
    for bad in ("A", "a__b", "", "-a"):
        with pytest.raises(ValueError):
            store.chunks(bad)


def test_a_failed_write_changes_nothing(spark, store):
    store.upsert(chunked(spark, [("r", "a.py", CODE)]))
    bad = chunked(spark, [("r", "b.py", CODE)]).withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.upsert(bad)
    assert {r.file for r in store.chunks().collect()} == {"a.py"}


def test_catalog(tmp_path):
    c = Catalog(tmp_path / "c.json")
    c.upsert_repo("a", "/a")
    c.set_repo_index("a", "s1", "main", 3)
    c.set_repo_index("a", "s2", "dev", 4, "other")
    c.set_meta("pending:a", "x")
    c.set_meta("idx_sha:ab", "keep")
    again = Catalog(tmp_path / "c.json")
    assert again.get_repo_index("a")["sha"] == "s1" and again.get_repo_index("a", "other")["chunks"] == 4 and again.get_repo("a")["last_indexed_sha"] == "s1"
    with pytest.raises(RuntimeError), again.transaction():
        again.set_meta("k", "v")
        raise RuntimeError
    assert again.get_meta("k") is None and Catalog(tmp_path / "c.json").get_meta("k") is None
    again.clear_repo("a")
    assert again.get_meta("pending:a") is None and again.get_meta("idx_sha:ab") == "keep" and again.get_repo_index("a", "other")["sha"] is None
    again.delete_repo("a")
    assert again.list_repos() == [] and again.get_repo("a") is None
    again.clear_all()
    assert again.get_meta("idx_sha:ab") is None


def run(root, *arguments):
    env = os.environ | {"GIT_AUTHOR_NAME": "A|B", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@b"}
    return subprocess.run(["git", "-c", "init.defaultBranch=main", *arguments], cwd=root, check=True, capture_output=True, text=True, env=env).stdout.strip()


def commit(root, message, **content):
    for name, text in content.items():
        path = root / name.replace("__", "/").replace("_py", ".py")
        if text is None:
            path.unlink()
        else:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    run(root, "add", "-A")
    run(root, "commit", "-qm", message)
    return run(root, "rev-parse", "HEAD")


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "code"
    root.mkdir()
    run(root, "init", "-q")
    commit(root, "first", a_py=CODE, b_py="def gone():\n    pass\n", src__c_py="class Box:\n    def open(self):\n        return 'needle'\n")
    return root


def test_git_sources(spark, repo):
    first = git.head(str(repo))
    assert first.branch == "main" and sorted(sources.git_tracked(str(repo))) == ["a.py", "b.py", "src/c.py"] and sources.git_tracked(str(repo.parent)) is None
    run(repo, "mv", "b.py", "moved.py")
    second = commit(repo, "second", a_py=CODE.replace("return 1", "return 'needle'"))
    feed = {(r.status, r.path, r.old_path) for r in git.changed_files(spark, str(repo), first.sha, second).collect()}
    assert feed == {("M", "a.py", None), ("R", "moved.py", "b.py")}
    assert git.changed_files(spark, str(repo), "0" * 40, second) is None
    log = git.file_history(spark, str(repo), "moved.py").collect()
    assert [r.message for r in log] == ["second", "first"] and log[0].author == "A|B"
    assert [r.message for r in git.pickaxe_log(spark, str(repo), "needle").collect()] == ["second", "first"]
    assert git.pickaxe_log(spark, str(repo), "--all").collect() == []
    assert git.content_at(str(repo), first.sha, "a.py") == CODE and git.content_at(str(repo), first.sha, "no") is None
    assert git.parent_of(str(repo), second) == first.sha and git.parent_of(str(repo), first.sha) is None and git.head(str(repo.parent)) is None


def test_files(spark, repo):
    (repo / "big.py").write_text("x" * (sources.MAX_BYTES + 1))
    (repo / "blank.md").write_text(" \n")
    (repo / "bad.txt").write_bytes(b"ok \xff\xfe end")
    (repo / "yarn.lock").write_text("x")
    (repo / "node_modules").mkdir()
    (repo / "node_modules" / "x.js").write_text("y")
    (repo / ".ignored").write_text("# note\n\nsrc/\n")
    read = lambda *a: {r.file: r.text for r in sources.read_files(spark, "r", str(repo), *a).collect()}
    assert set(read()) == {"a.py", "b.py", "src/c.py"}
    assert set(read(sources.walked(str(repo)), sources.ignore_patterns(str(repo), ".ignored"))) == {"a.py", "b.py", "bad.txt"}
    assert read(["bad.txt", "missing.py"]) == {"bad.txt": "ok  end"}
    assert {r.file for r in sources.files_in(spark, str(repo), "r").collect()} == {"a.py", "b.py", "src/c.py", "bad.txt"}


def test_index_in_full_and_by_changes(spark, store, repo, tmp_path):
    catalog, backend = Catalog(tmp_path / "c.json"), HashBackend(16)
    target = [config.Repo("code", str(repo))]
    go = lambda **k: indexing.run_index(spark, store, catalog, backend, target, **k)[0]
    names = lambda: sorted(r.symbol_name for r in store.chunks().collect())
    assert (go().mode, names()) == ("full", ["Box", "gone", "one", "two"]) and go().mode == "skipped"
    commit(repo, "second", a_py="def two():\n    return 3\n", b_py=None, d_py="def new():\n    pass\n")
    result = go()
    assert (result.mode, result.message, names()) == ("incremental", "+1 -1 ~1 >0", ["Box", "new", "two"]) and not catalog.get_meta("pending:code")
    catalog.set_meta("pending:code", "x")
    assert go().mode == "full" and go(full=True).mode == "full"
    run(repo, "checkout", "-qb", "other")
    assert go().mode == "full" and indexing.run_index(spark, store, catalog, backend, [config.Repo("no", "/no/such")])[0].mode == "error"

    class Broken(HashBackend):
        def embed_documents(self, texts):
            raise ConnectionError("down")

    commit(repo, "third", a_py="def other():\n    pass\n")
    with pytest.raises(Exception, match="down"):
        indexing.run_index(spark, store, catalog, Broken(16), target)
    assert names() == ["Box", "new", "two"] and catalog.get_meta("pending:code")
    assert go().mode == "full" and names() == ["Box", "new", "other"]


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    monkeypatch.setenv("QUILLSTRATA_MODEL", "64")
    assert config.load(path).profile.model == "64"
    config.write_default(path)
    with pytest.raises(FileExistsError):
        config.write_default(path)
    own = config.add_repo(str(tmp_path), "me", path)
    with pytest.raises(ValueError):
        config.add_repo(str(tmp_path), "me", path)
    with pytest.raises(FileNotFoundError):
        config.add_repo(str(tmp_path / "no"), None, path)
    config.write_default(path, force=True)
    assert config.load(path).repos == [own]
    assert config.parse({"embedding": {"profiles": {"x": {"model": 8}}}}).active == "x" and config.parse({"repos": None}).repos == []
    for bad in ({"profiles": {"x": {}, "y": {}}}, {"profiles": {"x": {}}, "active": "z"}, {"profiles": {"X": {}}}, {"profiles": {"a__b": {}}}):
        with pytest.raises(ValueError):
            config.parse({"embedding": bad})
    path.write_text("a: [")
    with pytest.raises(ValueError):
        config.load(path)
    config.write_default(path, force=True)
    assert (tmp_path / "c.yaml.bak").read_text() == "a: [" and not config.remove_repo("me", path)


def test_find_file(tmp_path):
    (tmp_path / "in").mkdir()
    outer, inner = config.Repo("o", str(tmp_path)), config.Repo("i", str(tmp_path / "in"))
    assert config.find_file(str(tmp_path / "in/x.py"), [outer, inner]).repo is inner
    assert config.find_file("o/a/b.py", [outer, inner]).file == "a/b.py" and config.find_file("x.py", [outer], "o").file == "x.py"
    for name, repo in (("../x", "o"), ("zzz/x", None), ("x", "no")):
        with pytest.raises(ValueError):
            config.find_file(name, [outer, inner], repo)


def test_command_line(spark, repo, tmp_path, capsys):
    path = str(tmp_path / "config.yaml")
    (tmp_path / "config.yaml").write_text(f"data_dir: {tmp_path}/data\nembedding:\n  backend: hash\n  model: '32'\n")

    def said(*arguments, code=0):
        capsys.readouterr()
        if code:
            with pytest.raises(SystemExit) as e:
                cli.main(["--config", path, *arguments])
            assert e.value.code == code
            return capsys.readouterr().err
        cli.main(["--config", path, *arguments])
        return capsys.readouterr().out

    assert "no repos" in said("index", code=1)
    assert "Added: code" in said("repos", "add", str(repo)) and str(repo) in said("repos", "paths")
    assert "full - 3 supported files" in said("index", "--dry-run") and "not indexed" in said("repos", "list")
    assert "Done." in said("index") and "up to date" in said("index", "--dry-run")
    assert "4 total chunks" in said("status") and "All checks passed." in said("doctor")
    for mode in ("hybrid", "semantic", "keyword", "symbol"):
        found = json.loads(said("search", "Box", "--mode", mode, "--format", "json"))
        assert found["mode"] == mode and found["results"][0]["file"] == "src/c.py", mode
        assert "src/c.py" in said("search", "Box", "--mode", mode)
    assert "No results" in said("search", "zzzqqq", "--mode", "keyword")
    assert json.loads(said("map", "--format", "json"))["repos"][0]["classes"][0]["name"] == "Box" and "Languages: python" in said("map")
    assert [s["symbol_name"] for s in json.loads(said("symbols", "--type", "function", "--format", "json"))["symbols"]] == ["one", "two", "gone"]
    assert said("cat", "code/a.py", "--lines", "4-5") == "   4  def two():\n   5      return 2\n" and json.loads(said("cat", "a.py", "--repo", "code", "--symbol", "one", "--format", "json"))["end_line"] == 2
    assert "no symbol" in said("cat", "code/a.py", "--symbol", "nope", code=1) and "not a line range" in said("cat", "code/a.py", "--lines", "x", code=1)
    commit(repo, "second", a_py=CODE.replace("two()", "two(x)"))
    said("index")
    told = json.loads(said("history", "two", "--format", "json"))
    assert told["scoped_files"] == ["code/a.py"] and told["entries"][0]["changes"][0]["change_type"] == "signature_changed" and told["entries"][0]["relevance"] == "direct"
    assert "~ two (signature_changed, major)" in said("history", "two")
    assert "Removed" in said("repos", "remove", "code", "--yes") and "0 total" not in said("repos", "list")
    assert "say what" in said("reset", "--yes", code=1) and "Reset" in said("reset", "--all", "--yes")


def test_stream(spark, store, tmp_path):
    inbox = tmp_path / "in"
    put = lambda rows: spark.createDataFrame(rows, ingest.SCHEMA).coalesce(1).write.mode("append").parquet(str(inbox))
    take = lambda: ingest.ingest(ingest.changes(spark, str(inbox)), store, HashBackend(16), str(tmp_path / "cp")).awaitTermination()
    put([("r", "a.py", "def old():\n  pass\n", False, 1), ("r", "a.py", CODE, False, 2), ("r", "b.py", CODE, False, 1)])
    take()
    assert sorted((r.file, r.symbol_name) for r in store.chunks().collect()) == [("a.py", "one"), ("a.py", "two"), ("b.py", "one"), ("b.py", "two")]
    put([("r", "a.py", "def three():\n  pass\n", False, 3), ("r", "b.py", None, True, 4), ("s", "c.md", "text", False, 5)])
    take()
    take()
    assert sorted((r.repo, r.file, r.symbol_name) for r in store.chunks().collect()) == [("r", "a.py", "three"), ("s", "c.md", "")]


def test_full_text_search_from_the_index_is_that_of_the_scan(spark, tmp_path):
    words = ["red", "green", "blue", "grey"]
    rows = [("r%d" % (k % 3), f"f{k % 7}.py", " ".join(words[(k * j) % 4] for j in range(1, 2 + k % 9))) for k in range(60)]
    made = conform(spark.createDataFrame([(f"i{k}", r, f, t, k, k) for k, (r, f, t) in enumerate(rows)], "id string, repo string, file string, text string, start_line int, end_line int"))
    store = ChunkStore(spark, tmp_path / "s")
    store.replace(["r0", "r1", "r2"], made)
    for query in ("red", "green blue grey", '"red green" blue', '"grey grey"', "missing red", "missing", ""):
        for repo in (None, "r1"):
            scanned = [(r.id, round(r.score, 6)) for r in store.search_text(query, 10, repo).collect()]
            store.build_text_index()
            served = [(r.id, round(r.score, 6)) for r in store.search_text(query, 10, repo).collect()]
            assert served == scanned
            state = store._pointer("default")
            store._point("default", {**state, "indexes": {}})
    store.build_text_index()
    best = store.ranked_text("red grey", 5)
    text = best._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "text:string" not in text and "PartitionFilters: [bucket" in text


def test_late_changes_of_a_stream_do_not_win(spark, tmp_path):
    store, backend = ChunkStore(spark, tmp_path / "s"), HashBackend(8)
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    apply_changes(store, batch(("r", "a.txt", "new", False, 5), ("r", "b.txt", "gone", True, 7)), backend)
    apply_changes(store, batch(("r", "a.txt", "old", False, 3), ("r", "b.txt", "back", False, 6), ("r", "c.txt", "third", False, 1)), backend)
    assert sorted(r.text for r in store.chunks().collect()) == ["new", "third"]
    apply_changes(store, batch(("r", "a.txt", "newer", False, 6)), backend)
    assert sorted(r.text for r in store.chunks().collect()) == ["newer", "third"]


def test_changes_write_only_the_parts_they_touch(spark, tmp_path, monkeypatch):
    import quillstrata.store as module

    monkeypatch.setattr(module, "PART_CHUNKS", 10)
    store = ChunkStore(spark, tmp_path / "s")
    made = conform(spark.createDataFrame([(f"i{k}", "r", f"f{k}.py", "x", k) for k in range(60)], "id string, repo string, file string, text string, start_line int"))
    store.replace(["r"], made)
    store.compact()
    before = store._pointer("default")["repos"]["r"]
    assert before["of"] == 7 and store.chunks().count() == 60
    store.upsert(made.where("file = 'f3.py'").withColumn("text", F.lit("new")))
    after = store._pointer("default")["repos"]["r"]
    assert sum(before["parts"][n] != after["parts"][n] for n in before["parts"]) == 1
    store.delete_files("r", ["f4.py", "f5.py"])
    store.delete_stale_files("r", made.where("start_line <> 6"))
    store.exchange(made.where("start_line = 7"), made.where("start_line = 7").withColumn("id", F.lit("again")))
    rows = {r.id: r.text for r in store.chunks().collect()}
    assert set(rows) == {f"i{k}" for k in range(60) if k not in (4, 5, 6, 7)} | {"again"} and rows["i3"] == "new"
    store.delete_repo("r")
    assert store.chunks().count() == 0 and store.stats() == {"total": 0, "repos": {}}


def test_served_makes_what_is_asked_for(spark, sf_dir, tmp_path):
    shutil.copy(f"{sf_dir}/documents.parquet", tmp_path)
    own = stored.served(spark, str(tmp_path), "whole", text=False)
    assert own.list_profiles() == ["whole"] and not own.has_text_index("whole")
    assert stored.served(spark, str(tmp_path), "whole").has_text_index("whole") and own.list_profiles() == ["whole"]


def test_a_text_index_is_written_without_another_sort(spark, sf_dir, tmp_path, monkeypatch):
    shutil.copy(f"{sf_dir}/documents.parquet", tmp_path)
    own, name = stored.served(spark, str(tmp_path), "whole", text=False), "spark.sql.maxConcurrentOutputFileWriters"
    before, asked = spark.conf.get(name), []
    monkeypatch.setattr(own, "_conf", lambda *x: asked.append(x) or ChunkStore._conf(own, *x))
    own.build_text_index("whole")
    assert [(n, int(v) > BUCKETS) for n, v in asked] == [(name, True)]  # as many as that, and Spark sorts
    assert spark.conf.get(name) == before


def test_texts_of_one_id_are_ranked_apart(spark, tmp_path):
    texts = ["of the red and", "the of blue", "and of the of the", None, "and so on of the"]
    pq.write_table(pa.table({"doc_id": [1, 1, 1, 2, 3], "text": texts, "lang": ["en"] * 5, "source": ["a", "a", "a", None, "b"]}), tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    found = catalogue.QUERIES["bm25_phrase"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.score) for r in found) == sorted(db.execute(catalogue.ORACLE_SQL["bm25_phrase"]).fetchall())


def test_a_text_index_holds_keys_once_and_is_made_without_a_shuffle(spark, sf_dir, tmp_path):
    shutil.copy(f"{sf_dir}/documents.parquet", tmp_path)
    own = stored.served(spark, str(tmp_path), "whole", text=False)
    made = bm25.index_rows(own.chunks("whole"))
    assert "Exchange" not in made._jdf.queryExecution().toString() and "Sort" not in made._jdf.queryExecution().toString()
    own.build_text_index("whole")
    rows = spark.read.parquet(f"{own._folder('whole')}/{own._pointer('whole')['indexes']['text']['path']}")
    n = own.chunks("whole").count()
    assert rows.where("file IS NOT NULL").count() == rows.where("term IS NULL").select("row").distinct().count() == n < rows.count()
    # an index of the layout before is none, and is made anew
    state = own._pointer("whole")
    del state["indexes"]["text"]["by"]
    own._point("whole", state)
    assert own.postings_of(["the"], "whole") is None and not own.has_text_index("whole")
    assert stored.served(spark, str(tmp_path), "whole").has_text_index("whole")


def test_reranking_is_served_from_postings_that_name_rows_only(spark, sf_dir, tmp_path):
    for name in ("documents", "embeddings"):
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path)
    found = catalogue.QUERIES["rerank_top30"](spark, str(tmp_path)).collect()
    own = stored.served(spark, str(tmp_path))
    rows = spark.read.parquet(f"{own._folder('default')}/{own._pointer('default')['indexes']['text']['path']}")
    postings = rows.where("term IS NOT NULL")
    named = [F.count(c).alias(c) for c in ("id", "repo", "file", "start_line", "len")]
    assert postings.count() > own.chunks().count() and not any(postings.select(*named).head())
    laid = rows.where("term IS NULL").select("id", "repo", "file", "start_line")
    assert laid.count() == own.chunks().count() and laid.exceptAll(own.chunks().select(*laid.columns)).count() == 0
    db = duckdb.connect()
    for name in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    assert sorted(map(tuple, found)) == sorted(db.execute(catalogue.ORACLE_SQL["rerank_top30"]).fetchall())


def test_reranking_shuffles_no_text_to_find_lines(spark, sf_dir, tmp_path):
    for name in ("documents", "embeddings"):
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path)  # one file, fewer than there are cores
    assert len(spark.read.parquet(str(tmp_path / "documents.parquet")).inputFiles()) < spark.sparkContext.defaultParallelism
    made = catalogue.QUERIES["rerank_top30"](spark, str(tmp_path))
    assert "RoundRobinPartitioning" not in made._jdf.queryExecution().executedPlan().toString()
