"""The chunk table on disk: one folder of Parquet versions for each profile, partitioned by repo.

A change writes a new version beside the old one and then replaces the pointer file, so a reader never sees half of it and
a crash leaves the old version in force. A repo lies in parts, by a hash of the file, about PART_CHUNKS chunks each; the
pointer lists the folder of each part. Parts that a change does not touch stay where they are.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.fs import FileSystem
from quillstrata.model import COLUMNS, SCHEMA, StoreError, check_dims, conform
from quillstrata.operators import bm25, changes, symbols, vector
from quillstrata.operators.structure import repo_stats

_NAME = re.compile(r"[a-z0-9][a-z0-9_-]*")
#: From this number of chunks on, vectors are indexed by cells.
INDEXED_FROM = 5000
#: Chunks of a repo that lie in one part, once the table has been compacted.
PART_CHUNKS = 100_000
#: Parts of a text index, by a hash of the term; a task that writes it makes a file for each.
BUCKETS = 16
#: The part that has the chunks' keys.
KEYS = -1


def check_profile(name: str) -> str:
    if not isinstance(name, str) or not _NAME.fullmatch(name) or "__" in name:
        raise ValueError(f"not a profile name: {name!r}; use a-z, 0-9, _ and -, without __")
    return name


class ChunkStore:
    """Reads and writes chunk tables under a folder that the driver and the executors share."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root, self.fs = spark, str(root).rstrip("/"), FileSystem(spark)

    # layout: all of it on the file system of the root, which may be an object store

    def _folder(self, profile: str) -> str:
        return f"{self.root}/" + ("code_index" if check_profile(profile) == "default" else f"code_index__{profile}")

    def _pointer(self, profile: str) -> dict:
        text = self.fs.read(f"{self._folder(profile)}/current.json")
        return json.loads(text) if text else {"repos": {}, "indexes": {}}

    def _point(self, profile: str, state: dict) -> None:
        self.fs.replace(f"{self._folder(profile)}/current.json", json.dumps(state))

    def exists(self, profile: str = "default") -> bool:
        return self.fs.exists(f"{self._folder(profile)}/current.json")

    def list_profiles(self) -> list[str]:
        found = [n for n in self.fs.names(self.root) if n.startswith("code_index") and self.fs.exists(f"{self.root}/{n}/current.json")]
        return sorted("default" if n == "code_index" else n.removeprefix("code_index__") for n in found)

    def chunks(self, profile: str = "default", repo: str | list[str] | None = None) -> DataFrame:
        """The table, or some repos of it; empty if there is none. Only the folders of the repos asked for are read."""
        wanted = {repo} if isinstance(repo, str) else None if repo is None else set(repo)
        return self._read(profile, [p for r, v in sorted(self._pointer(profile)["repos"].items()) if wanted is None or r in wanted for p in v["parts"].values()])

    def _read(self, profile: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self._folder(profile)}/{p}" for p in paths))

    # changes

    def _number(self, sizes: dict[str, int]) -> Column:
        """The part that a row (repo, file) lies in; ``sizes``: how many parts each repo has, one if it is not there."""
        parts = F.lit(1)
        if many := {r: n for r, n in sizes.items() if n > 1}:
            parts = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in many.items() for x in pair)), F.col("repo")), F.lit(1))
        return F.pmod(F.xxhash64("file"), parts).cast("int")

    def _rewrite(self, profile: str, touched: dict[str, list[int]], rows: DataFrame | None, sizes: dict[str, int]) -> None:
        """The parts ``touched`` hold ``rows`` from now on. One job writes all of them, then the pointer moves. A repo without
        rows leaves the table."""
        state, name = self._pointer(profile), f"data/{uuid.uuid4().hex}"
        folder = f"{self._folder(profile)}/{name}"
        if rows is not None:
            part = F.concat_ws("-", F.md5("repo"), self._number(sizes).cast("string")).alias("part")
            # rows lie by repo, file and line, so that statistics of row groups prune look-ups within a file; by ranges, so
            # that a part is in few files and a large one in many. Filters on the names and kinds of symbols skip row groups
            # by dictionaries and Bloom filters.
            dealt = rows.select(*COLUMNS, part).repartitionByRange("part", "file", "start_line").sortWithinPartitions("part", "file", "start_line")
            writer = dealt.write.partitionBy("part")
            for column in ("id", "symbol_name", "chunk_type"):
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            writer.parquet(folder)
        there = set(self.fs.names(folder)) if rows is not None else set()
        for repo, numbers in touched.items():
            own = state["repos"].get(repo)
            if own is None or own["of"] != sizes.get(repo, 1):
                own = {"of": sizes.get(repo, 1), "parts": {}}
            for n in numbers:
                part = f"part={hashlib.md5(repo.encode()).hexdigest()}-{n}"
                own["parts"].pop(str(n), None)
                if part in there:
                    own["parts"][str(n)] = f"{name}/{part}"
            if own["parts"]:
                state["repos"][repo] = own
            else:
                state["repos"].pop(repo, None)
        state["indexes"] = {}  # they are of the version before
        self._point(profile, state)

    def _sizes(self, profile: str) -> dict[str, int]:
        return {r: v["of"] for r, v in self._pointer(profile)["repos"].items()}

    def _touched(self, rows: DataFrame, sizes: dict[str, int]) -> dict[str, list[int]]:
        """The parts in which rows (repo, file) lie: one line for each part of a repo."""
        found: dict[str, list[int]] = {}
        for r in rows.select("repo", self._number(sizes).alias("n")).distinct().collect():
            found.setdefault(r.repo, []).append(r.n)
        return found

    def _parts(self, profile: str, touched: dict[str, list[int]]) -> DataFrame:
        repos = self._pointer(profile)["repos"]
        return self._read(profile, [repos[r]["parts"][str(n)] for r, ns in sorted(touched.items()) if r in repos for n in sorted(ns) if str(n) in repos[r]["parts"]])

    def upsert(self, chunks: DataFrame, profile: str = "default") -> None:
        """Rows of new ids are added, rows of known ids replaced. No rows, no change. Only the parts that new rows fall in are
        written anew: an id is made of its repo and file, so a known one lies there."""
        new = conform(chunks)
        self._check(new, profile)
        sizes = self._sizes(profile)
        touched = self._touched(new, sizes)
        if touched:
            self._rewrite(profile, touched, changes.upsert(self._parts(profile, touched), new, "id"), sizes)

    def replace(self, repos: list[str], chunks: DataFrame, profile: str = "default") -> None:
        """All rows of the repos at once, so that nothing of an earlier state survives."""
        new = conform(chunks).where(F.col("repo").isin(repos))
        if set(self._pointer(profile)["repos"]) - set(repos):
            self._check(new, profile, but=repos)
        sizes = self._sizes(profile)
        self._rewrite(profile, {r: list(range(sizes.get(r, 1))) for r in repos}, new, sizes)

    def exchange(self, files: DataFrame, chunks: DataFrame, profile: str = "default") -> None:
        """The old chunks of ``files`` (repo, file) go and ``chunks``, which are of these files, come, in one version."""
        new, sizes = conform(chunks), self._sizes(profile)
        touched = self._touched(files, sizes)
        if touched:
            self._check(new, profile, but=[])
            kept = self._parts(profile, touched).join(files.select("repo", "file"), ["repo", "file"], "left_anti").select(*COLUMNS)
            self._rewrite(profile, touched, kept.unionByName(new), sizes)

    def _check(self, new: DataFrame, profile: str, but: list[str] = []) -> None:  # noqa: B006
        first = new.where("vector IS NOT NULL").select(F.size("vector").alias("n")).head()
        if first:
            check_dims(self.chunks(profile, [r for r in self._pointer(profile)["repos"] if r not in but]), first.n)

    def _keep(self, profile: str, files: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> None:
        """The parts that hold ``files`` (repo, file) keep what ``rule`` makes of their rows."""
        sizes = self._sizes(profile)
        touched = {r: ns for r, ns in self._touched(files, sizes).items() if r in sizes}
        if touched:
            self._rewrite(profile, touched, rule(self._parts(profile, touched)).select(*COLUMNS), sizes)

    def delete_repo(self, repo: str, profile: str = "default") -> None:
        sizes = self._sizes(profile)
        if repo in sizes:
            self._rewrite(profile, {repo: list(range(sizes[repo]))}, None, sizes)

    def delete_files(self, repo: str, files: list[str], profile: str = "default") -> None:
        gone = self.spark.createDataFrame([(repo, f) for f in files], "repo string, file string")
        self._keep(profile, gone, lambda rows: rows.join(gone, ["repo", "file"], "left_anti"))

    def delete_stale_files(self, repo: str, current: DataFrame, profile: str = "default") -> None:
        stale = self.chunks(profile, repo).select("repo", "file").distinct().join(current.select("repo", "file"), ["repo", "file"], "left_anti")
        self._keep(profile, stale, lambda rows: changes.without_stale_files(rows, current))

    def delete_stale_chunks(self, repo: str, modified: DataFrame, valid: DataFrame, profile: str = "default") -> None:
        self._keep(profile, modified.where(F.col("repo") == repo), lambda rows: changes.without_stale_chunks(rows, modified, valid))

    def drop(self, profile: str) -> None:
        self.fs.delete(self._folder(profile))

    def compact(self, profile: str = "default") -> None:
        """Repos that have outgrown their parts dealt out anew, PART_CHUNKS chunks each, and what no pointer names removed."""
        rows, now = self.chunks(profile), self._sizes(profile)
        wanted = {r.repo: 1 + r["count"] // PART_CHUNKS for r in rows.groupBy("repo").count().collect()}  # a row for each repo
        grown = {r: n for r, n in wanted.items() if n >= 2 * now[r] or 2 * n <= now[r]}
        if grown:
            self._rewrite(profile, {r: list(range(n)) for r, n in grown.items()}, self.chunks(profile, list(grown)), grown)
        state = self._pointer(profile)
        used = {*(p for v in state["repos"].values() for p in v["parts"].values()), *(x["path"] for x in state["indexes"].values())}
        for kind in ("data", "index"):
            for name in self.fs.names(f"{self._folder(profile)}/{kind}"):
                own = f"{kind}/{name}"
                if not any(u == own or u.startswith(own + "/") for u in used):
                    self.fs.delete(f"{self._folder(profile)}/{own}")

    # indexes

    @contextmanager
    def _conf(self, name: str, value: str) -> Iterator[None]:
        before = self.spark.conf.get(name, None)
        self.spark.conf.set(name, value)
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(name)
            else:
                self.spark.conf.set(name, before)

    def build_text_index(self, profile: str = "default") -> str | None:
        """Postings with positions, partitioned by a hash of the term, the chunks' keys and lengths in a bucket of their own, and
        each repo's number of chunks and of tokens. Its format's version, or None without a table."""
        if not self.exists(profile):
            return None
        name, buckets = f"index/{uuid.uuid4().hex}", BUCKETS
        of_term = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        listed = bm25.index_rows(self.chunks(profile)).withColumn("bucket", F.when(F.col("term").isNull(), KEYS).otherwise(of_term))
        # a task has a file open for each bucket and for the keys, so that postings are neither shuffled nor sorted again (Spark
        # sorts once as many are open as it allows, hence one more); they come in runs by term, so that pages are pruned
        with self._conf("spark.sql.maxConcurrentOutputFileWriters", str(buckets + 2)):
            listed.write.partitionBy("bucket").parquet(f"{self._folder(profile)}/{name}")
        sums = self._laid(profile, name).groupBy("repo").agg(F.count("*").alias("n"), F.sum("len").alias("tokens")).collect()  # a row for each repo
        state = self._pointer(profile)
        state["indexes"]["text"] = {"path": name, "buckets": buckets, "version": "3", "by": "row", "sums": {r.repo: [r.n, r.tokens] for r in sums}}
        self._point(profile, state)
        return "3"

    def _text_index(self, profile: str) -> dict | None:
        """What the pointer says of the index; None if there is none whose postings are by row."""
        index = self._pointer(profile)["indexes"].get("text", {})
        return index if (index.get("version"), index.get("by")) == ("3", "row") else None

    def _index_rows(self, profile: str, path: str) -> DataFrame:
        return self.spark.read.schema(f"{bm25.INDEX}, bucket int").parquet(f"{self._folder(profile)}/{path}")

    def _laid(self, profile: str, path: str) -> DataFrame:
        """The chunks of an index by row: their keys and lengths."""
        return self._index_rows(profile, path).where(F.col("bucket") == KEYS).select("row", "id", "repo", "file", "start_line", "len")

    def postings_of(self, terms: list[str], profile: str = "default") -> DataFrame | None:
        """Postings (term, row, positions) of some terms: only their buckets are read. None if there is no index of the present
        version."""
        index = self._text_index(profile)
        if not index:
            return None
        # Spark's xxhash64 of a string, without a job for a few terms
        marks = {(h - (h >> 63 << 64)) % index["buckets"] for h in (xxhash.xxh64_intdigest(t.encode(), 42) for t in terms)}
        rows = self._index_rows(profile, index["path"])
        return rows.where(F.col("bucket").isin(sorted(marks)) & F.col("term").isin(terms)).select("term", "row", "positions")

    def has_text_index(self, profile: str = "default") -> bool:
        return self._text_index(profile) is not None

    def build_vector_index(self, profile: str = "default") -> int | None:
        """Cells of vectors, from INDEXED_FROM rows on; how many, or None where the table is searched as it is."""
        rows = self.chunks(profile).where("vector IS NOT NULL")
        n = rows.count()
        if n < INDEXED_FROM:
            return None
        indexed, centres = vector.build_cells(rows, n)
        name = f"index/{uuid.uuid4().hex}"
        indexed.repartition("cell").write.partitionBy("cell").parquet(f"{self._folder(profile)}/{name}")
        state = self._pointer(profile)
        state["indexes"]["vector"] = {"path": name, "centres": centres}
        self._point(profile, state)
        return len(centres)

    # searches

    def search_vector(self, query: list[float], limit: int = 30, repo: str | None = None, profile: str = "default", metric: str = "cosine", probes: int | None = None) -> DataFrame:
        """Exact, unless ``probes`` asks for that many cells of the index."""
        rows = self.chunks(profile, repo)
        check_dims(rows, len(query))
        index = self._pointer(profile)["indexes"].get("vector")
        if probes and index and repo is None:
            cells = self.spark.read.parquet(f"{self._folder(profile)}/{index['path']}")
            return vector.cell_search(cells, index["centres"], query, limit, probes, metric=metric)
        return vector.vector_search(rows, query, limit, metric=metric)

    def probes(self, profile: str = "default") -> int | None:
        """How many cells a search of this table should read; None where it has no index and is searched as it is."""
        index = self._pointer(profile)["indexes"].get("vector")
        return vector.n_probes(len(index["centres"])) if index else None

    def search_text(self, query: str, limit: int = 30, repo: str | None = None, profile: str = "default") -> DataFrame:
        """Chunks with their score, best first. With an index of the present version, its terms' postings are ranked and no
        text is read but that of the ``limit`` results; else all texts are scanned."""
        order = [F.desc(F.round("score", 6)), "repo", "file", "start_line"]
        best = self.ranked_text(query, limit, repo, profile)
        if best is None:
            return bm25.bm25(self.chunks(profile, repo), query).orderBy(*order).limit(limit)
        rows = best.collect()  # limit rows, whose chunks are then looked up where they lie
        scores = self.spark.createDataFrame(list({r.id: r.score for r in reversed(rows)}.items()), "id string, score double").coalesce(1)
        near = self.chunks(profile, sorted({r.repo for r in rows}) if rows else []).where(F.col("file").isin(sorted({r.file for r in rows})) & F.col("id").isin([r.id for r in rows]))
        return near.join(F.broadcast(scores), "id").select(*COLUMNS, "score").orderBy(*order)

    def ranked_text(self, query: str, limit: int | None, repo: str | None = None, profile: str = "default") -> DataFrame | None:
        """(id, repo, file, start_line, score) by the stored postings, all without a limit; None without such an index."""
        terms, _ = bm25.terms_of(query)
        found = self.postings_of(terms, profile) if terms else None
        if found is None:
            return None
        index = self._text_index(profile)
        laid = self._laid(profile, index["path"])
        if repo is not None:
            laid = laid.where(F.col("repo") == repo)
            found = found.join(laid.select("row"), "row", "left_semi")
        n, tokens = (sum(v[k] for r, v in index["sums"].items() if repo in (None, r)) for k in (0, 1))
        return bm25.ranked(found, laid, query, n, tokens / max(1, n), limit)

    def search_symbol(self, name: str, repo: str | None = None, file: str | None = None, limit: int = 10, profile: str = "default") -> DataFrame:
        return symbols.symbol_search(self.chunks(profile, repo), name, repo, file, limit)

    def chunks_of_file(self, repo: str, file: str, profile: str = "default") -> DataFrame:
        return self.chunks(profile, repo).where(F.col("file") == file).orderBy("start_line")

    def find_chunk(self, repo: str, file: str, line: int, profile: str = "default") -> DataFrame:
        """The smallest chunk that holds a line."""
        rows = self.chunks(profile, repo).where((F.col("file") == file) & F.lit(line).between(F.col("start_line"), F.col("end_line")))
        return rows.orderBy(F.col("end_line") - F.col("start_line"), "start_line").limit(1)

    def stats(self, profile: str = "default") -> dict:
        rows = {r.repo: r.chunks for r in repo_stats(self.chunks(profile)).collect()}  # a row for each repo
        total = rows.pop(None, 0)
        return {"total": total, "repos": rows}
