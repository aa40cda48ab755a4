"""Command line: ``python -m quillstrata.cli``."""

from __future__ import annotations

import argparse
import fcntl
import json
import logging
import os
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

from quillstrata import config as conf
from quillstrata import indexing, render
from quillstrata.catalog import Catalog
from quillstrata.model import StoreError
from quillstrata.operators import fusion, keyword, structure, symbols
from quillstrata.operators.embedding import Backend, create_backend
from quillstrata.sources import git
from quillstrata.sources.files import git_tracked, ignore_patterns, read_files
from quillstrata.store import ChunkStore
from quillstrata.timeline import build_timeline

VERSION = "0.1.0"


class Failure(SystemExit):
    def __init__(self, message: str):
        print(f"Error: {message}", file=sys.stderr)
        super().__init__(1)


def session() -> SparkSession:
    """The active session, or one on this machine."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    return spark


class App:
    def __init__(self, path: str | None):
        self.path = path
        try:
            self.cfg = conf.load(path)
        except ValueError as e:
            raise Failure(str(e)) from e
        self.catalog = Catalog(self.cfg.data_path / "catalog.json")

    @property
    def store(self) -> ChunkStore:
        return ChunkStore(session(), self.cfg.data_path / "store")

    def backend(self) -> Backend:
        p = self.cfg.profile
        return create_backend(p.backend, p.model, p.url)

    def targets(self, name: str | None) -> list[conf.Repo]:
        if not self.cfg.repos:
            raise Failure("no repos configured; add one with: repos add PATH")
        if name is None:
            return self.cfg.repos
        found = [r for r in self.cfg.repos if r.name == name] or [r for r in self.cfg.repos if r.resolved_path() == Path(name).expanduser().resolve()]
        if not found:
            raise Failure(f"no repo {name!r} in the configuration")
        return found

    def files(self, repo: str | None):
        """Files of the configured repos as they are now."""
        spark = session()
        every = None
        for r in self.cfg.repos:
            if (repo is None or r.name == repo) and r.resolved_path().is_dir():
                rows = read_files(spark, r.name, str(r.resolved_path()), None, ignore_patterns(str(r.resolved_path()), conf.IGNORE_FILE))
                every = rows if every is None else every.unionByName(rows)
        return every if every is not None else spark.createDataFrame([], "repo string, file string, path string, length bigint, text string")


@contextmanager
def lock(path: Path) -> Iterator[None]:
    """One indexing run at a time, on one machine."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd = os.open(path, os.O_CREAT | os.O_RDWR)
    try:
        fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
    except OSError as e:
        os.close(fd)
        raise Failure("another index run is going on") from e
    try:
        yield
    finally:
        os.close(fd)


def _confirmed(args: argparse.Namespace, question: str) -> None:
    if not args.yes and input(f"{question} [y/N]: ").strip().lower() not in ("y", "yes"):
        raise Failure("stopped")


def init(app: App, args: argparse.Namespace) -> None:
    try:
        print(f"Created config: {conf.write_default(app.path, args.force)}")
    except FileExistsError as e:
        print(f"Config already exists: {e}; --force writes it anew and keeps its settings")


def repos(app: App, args: argparse.Namespace) -> None:
    if args.what == "add":
        try:
            repo = conf.add_repo(args.path, args.name, app.path)
        except (FileNotFoundError, ValueError) as e:
            raise Failure(str(e)) from e
        print(f"Added: {repo.name} -> {repo.path}")
    elif args.what == "list":
        status(app, args)
    elif args.what == "paths":
        for r in app.cfg.repos:
            print(r.resolved_path())
    else:
        app.targets(args.name)
        _confirmed(args, f"Remove {args.name!r}" + ("" if args.keep_data else " and its index data") + "?")
        if not args.keep_data:
            _forget(app, args.name)
        conf.remove_repo(args.name, app.path)
        print(f"Removed {args.name!r}" + (" (index data kept)" if args.keep_data else " and its index data"))


def _forget(app: App, name: str) -> None:
    for profile in app.store.list_profiles():
        app.store.delete_repo(name, profile)
    app.catalog.delete_repo(name)


def index(app: App, args: argparse.Namespace) -> None:
    targets, profile = app.targets(args.repo), app.cfg.active
    if args.dry_run:
        print(f"Dry run [profile: {profile}]:")
        for r in targets:
            root = str(r.resolved_path())
            if not Path(root).is_dir():
                print(f"  {r.name}: path missing ({root})")
                continue
            head, stored = git.head(root), app.catalog.get_repo_index(r.name, profile)
            how = indexing.decide(args.full, bool(app.catalog.get_meta(f"pending:{r.name}", profile)), stored, head)
            listed = git_tracked(root)
            known = "not a git repo" if listed is None else f"{sum(_supported(p) for p in listed)} supported files"
            print(f"  {r.name}: " + (f"up to date ({head.branch}, {head.sha[:7]})" if how.startswith("skipped") else f"{how.partition(':')[0]} - {known} in {root}"))
        return
    try:
        backend = app.backend()
    except (ConnectionError, ValueError, ImportError) as e:
        raise Failure(str(e)) from e
    print(f"Embedding: {backend.model_name()} ({backend.dims()} dims) [profile: {profile}]")
    with lock(app.cfg.data_path / "index.lock"):
        store = app.store
        stored = app.catalog.get_meta("embedding_model", profile)
        if stored and stored != backend.model_name() and not args.full and store.stats(profile)["total"]:
            raise Failure(f"profile {profile!r} was indexed with {stored}, not {backend.model_name()}; use --full")
        if stored and stored != backend.model_name() and args.full and args.repo is None:
            store.drop(profile)  # vectors of two models don't mix
        results = indexing.run_index(session(), store, app.catalog, backend, targets, args.full, profile, print)
        if indexing.changed_content(results):
            print("Rebuilding search indexes...")
            store.compact(profile)
            version = store.build_text_index(profile)
            store.build_vector_index(profile)
            if version:
                app.catalog.set_meta("fts_index_version", version, profile)
    print("Done.")
    if any(r.mode == "error" for r in results) and len(results) == 1:
        raise SystemExit(1)


def _supported(path: str) -> bool:
    from quillstrata.sources.files import EXTENSIONS, FILENAMES

    name = path.rsplit("/", 1)[-1]
    return (os.path.splitext(name)[1].lower() in EXTENSIONS or name in FILENAMES) and name not in keyword.SKIP_FILENAMES


def _warn(message: str) -> None:
    print(f"Warning: {message}", file=sys.stderr)


def _reranker():
    """A cross-encoder where its package is there; else None, and words in common decide."""
    try:
        return fusion.cross_encoder("cross-encoder/ms-marco-MiniLM-L-6-v2")
    except Exception as e:  # noqa: BLE001: no package, no model or no network
        _warn(f"no cross-encoder ({e}); reranking by words in common")
        return None


def search(app: App, args: argparse.Namespace) -> None:
    backend: Backend | None = None
    if args.mode in ("hybrid", "semantic"):
        try:
            backend = app.backend()
        except (ConnectionError, ValueError, ImportError) as e:
            if args.mode == "semantic":
                raise Failure(str(e)) from e
            print(f"Warning: embedding unavailable ({e}); searching without it", file=sys.stderr)
    store, profile = app.store, app.cfg.active
    if args.format != "json" and args.mode != "keyword":
        if not store.exists(profile):
            print(f"Warning: profile {profile!r} is not indexed; run: index", file=sys.stderr)
        stored = app.catalog.get_meta("embedding_model", profile)
        if backend and stored and stored != backend.model_name():
            print(f"Warning: profile {profile!r} was indexed with {stored}, the config has {backend.model_name()}", file=sys.stderr)
    try:
        if args.mode == "keyword":
            rows = keyword.keyword_search(app.files(args.repo), args.query, args.limit, regex=args.regex)
        elif args.mode == "symbol":
            rows = store.search_symbol(args.query, args.repo, limit=args.limit, profile=profile)
        elif args.mode == "semantic":
            rows = store.search_vector(backend.embed_query(args.query), args.limit, args.repo, profile, probes=store.probes(profile))
        else:
            vector = backend.embed_query(args.query) if backend and store.exists(profile) else None
            wanted = args.rerank or app.cfg.rerank
            model = _reranker() if wanted else None
            scorer = fusion.overlap_scorer(args.query) if wanted and model is None else None
            full_text = store.search_text(args.query, fusion.LIMITS["fts"], args.repo, profile) if store.exists(profile) else None
            semantic = store.search_vector(vector, fusion.LIMITS["semantic"], args.repo, profile, probes=store.probes(profile)) if vector else None
            legs = fusion.legs_of(store.chunks(profile, args.repo), app.files(args.repo), args.query, None, args.repo, args.regex, semantic, full_text)
            rows = fusion.run_apart(session(), legs, args.query, None if model else args.limit, scorer, say=_warn)
        found = rows.collect()
        if args.mode == "hybrid" and model:
            found = fusion.reranked([r.asDict(recursive=True) for r in found], args.query, model, say=_warn)[: args.limit]
    except StoreError as e:
        raise Failure(f"{e}; try: index --full") from e
    if args.format == "json":
        print(render.as_json(args.mode, found, args.query))
    else:
        print(render.as_text(args.mode, found) if found else "No symbols found." if args.mode == "symbol" else "No results found.")


def repo_map(app: App, args: argparse.Namespace) -> None:
    rows = structure.repo_map(app.store.chunks(app.cfg.active, args.repo)).orderBy("name").collect()
    print(render.repo_map(rows, args.format) if rows or args.format == "json" else "No indexed data; run: index")


def list_symbols(app: App, args: argparse.Namespace) -> None:
    rows = symbols.list_symbols(app.store.chunks(app.cfg.active, args.repo), args.query, args.repo, args.type, args.limit).collect()
    print(render.as_json("symbols", rows, args.query) if args.format == "json" else render.as_text("symbols", rows) if rows else "No symbols found.")


def cat(app: App, args: argparse.Namespace) -> None:
    try:
        found = conf.find_file(args.file, app.cfg.repos, args.repo)
    except ValueError as e:
        raise Failure(str(e)) from e
    if not found.path.is_file():
        raise Failure(f"no such file: {found.path}")
    wanted = args.lines
    if args.symbol:
        rows = app.store.chunks(app.cfg.active, found.repo.name)
        match = symbols.resolve_symbol(rows, args.symbol, found.repo.name, found.file).head()
        if match is None:
            known = [r.symbol_name for r in symbols.suggestions(rows, found.repo.name, found.file).collect()]
            raise Failure(f"no symbol {args.symbol!r} in {found.file}" + (f"; there are: {', '.join(known)}" if known else ""))
        wanted = f"{match.start_line}-{match.end_line}"
        print(f"# {match.symbol_name} at {match.repo}/{match.file}:{wanted}", file=sys.stderr)
    text = found.path.read_text(encoding="utf-8", errors="ignore")
    lines = text.splitlines()
    first, last = 1, len(lines)
    if wanted:
        try:
            a, dash, b = wanted.partition("-")
            first = max(1, int(a))
            last = min(len(lines), int(b) if dash else first + 50)
        except ValueError as e:
            raise Failure(f"not a line range: {wanted!r}; use 10-50 or 42") from e
    part = lines[first - 1 : last]
    if args.format == "json":
        content = "\n".join(part) if wanted else text
        print(json.dumps({"repo": found.repo.name, "file": found.file, "start_line": first, "end_line": last, "content": content}, indent=2))
    else:
        print(render.numbered(part, first))


def history(app: App, args: argparse.Namespace) -> None:
    try:
        backend = app.backend()
    except (ConnectionError, ValueError, ImportError) as e:
        backend = None
        print(f"Note: embedding unavailable ({e}); only symbols are matched", file=sys.stderr)
    try:
        found = build_timeline(session(), app.store, app.cfg.repo_paths(), args.query, args.since, args.limit, args.repo, args.symbol, backend, app.cfg.active)
    except StoreError as e:
        raise Failure(f"{e}; try: index --full") from e
    print(render.timeline(found, args.format) if found["entries"] or args.format == "json" else f"No history found for {args.query!r}.")


def status(app: App, args: argparse.Namespace) -> None:
    if not app.cfg.repos:
        print("No repos configured; add one with: repos add PATH")
        return
    profile, store = app.cfg.active, app.store
    stats, others = store.stats(profile), [p for p in store.list_profiles() if p != profile]
    print(f"Index [profile: {profile}]: {stats['total']} total chunks" + (f"   (other profiles: {', '.join(others)})" if others else ""))
    for r in app.cfg.repos:
        known = app.catalog.get_repo_index(r.name, profile)
        if not r.resolved_path().is_dir():
            print(f"  ! {r.name:<28} path missing: {r.path}")
        elif known["sha"]:
            branch = f"{known['branch']}, " if known["branch"] else ""
            print(f"    {r.name:<28} indexed  {stats['repos'].get(r.name, 0):>6} chunks  {(known['indexed_at'] or '')[:10]}  ({branch}{known['sha'][:7]})")
        else:
            print(f"    {r.name:<28} not indexed")


def reset(app: App, args: argparse.Namespace) -> None:
    if not (args.repo or args.all or args.benchmarks):
        raise Failure("say what: --repo, --all or --benchmarks")
    _confirmed(args, "This deletes index data. Go on?")
    if args.benchmarks:
        for profile in app.store.list_profiles():
            if profile not in {*app.cfg.profiles, "default"}:
                app.store.drop(profile)
                app.catalog.clear_profile(profile)
                print(f"Dropped profile: {profile}")
    elif args.repo:
        _forget(app, args.repo)
        print(f"Reset: {args.repo}")
    else:
        for profile in app.store.list_profiles():
            app.store.drop(profile)
        for r in app.catalog.list_repos():
            app.catalog.delete_repo(r["name"])
        app.catalog.clear_all()
        print("Reset: all index data deleted.")


def doctor(app: App, args: argparse.Namespace) -> None:
    good = bool(app.cfg.repos)
    print("Repos:" if good else "Repos:\n  none configured")
    for r in app.cfg.repos:
        there = r.resolved_path().is_dir()
        good &= there
        print(f"  {'OK' if there else 'MISSING'}  {r.name} -> {r.path}")
    print("Embedding backend:")
    dims = None
    try:
        backend = app.backend()
        dims = backend.dims()
        print(f"  OK  {backend.model_name()} ({dims} dims)")
    except (ConnectionError, ValueError, ImportError) as e:
        good = False
        print(f"  ERROR  {e}")
    profile = app.cfg.active
    print(f"Index [profile: {profile}]:")
    model, stored = app.catalog.get_meta("embedding_model", profile), app.catalog.get_meta("embedding_dims", profile)
    if model:
        print(f"  Model: {model} ({stored} dims)")
        if dims and stored and int(stored) != dims:
            good = False
            print(f"  WARN  stored vectors have {stored} dimensions, the backend gives {dims}; run: index --full")
    else:
        good = False
        print("  EMPTY  run: index")
    for r in app.cfg.repos:
        if app.catalog.get_meta(f"pending:{r.name}", profile):
            print(f"  WARN  {r.name}: an index run was interrupted; the next one is in full")
    stats = app.store.stats(profile)
    print(f"  Total chunks: {stats['total']}")
    for name, n in sorted(stats["repos"].items()):
        print(f"    {name}: {n} chunks")
    print("All checks passed." if good else "Some checks failed.")
    if not good:
        raise SystemExit(1)


class _JsonLog(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"ts": self.formatTime(record), "level": record.levelname, "logger": record.name, "msg": record.getMessage()})


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("quillstrata", description="Search over collections of source files")
    top.add_argument("--config")
    top.add_argument("-v", "--verbose", action="store_true")
    top.add_argument("--json-log", action="store_true")
    top.add_argument("--version", action="version", version=f"quillstrata {VERSION}")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *, fmt: bool = False, yes: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        if fmt:
            p.add_argument("--format", choices=["text", "json"], default="text")
        if yes:
            p.add_argument("--yes", action="store_true")
        return p

    command("init", init).add_argument("--force", action="store_true")
    actions = command("repos", repos).add_subparsers(dest="what", required=True)
    add = actions.add_parser("add")
    add.add_argument("path")
    add.add_argument("--name")
    actions.add_parser("list")
    actions.add_parser("paths")
    remove = actions.add_parser("remove")
    remove.add_argument("name")
    remove.add_argument("--keep-data", action="store_true")
    remove.add_argument("--yes", action="store_true")
    p = command("index", index)
    p.add_argument("--repo")
    p.add_argument("--full", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p = command("search", search, fmt=True)
    p.add_argument("query")
    p.add_argument("--repo")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--mode", choices=["hybrid", "semantic", "keyword", "symbol"], default="hybrid")
    p.add_argument("--rerank", action="store_true")
    p.add_argument("--regex", action="store_true")
    command("map", repo_map, fmt=True).add_argument("--repo")
    p = command("symbols", list_symbols, fmt=True)
    p.add_argument("query", nargs="?")
    p.add_argument("--repo")
    p.add_argument("--type", choices=["class", "function", "method", "property"])
    p.add_argument("--limit", type=int, default=50)
    p = command("cat", cat, fmt=True)
    p.add_argument("file")
    p.add_argument("--repo")
    p.add_argument("--lines")
    p.add_argument("--symbol")
    p = command("history", history, fmt=True)
    p.add_argument("query")
    p.add_argument("--since", default="6 months ago")
    p.add_argument("--repo")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--symbol")
    command("status", status)
    p = command("reset", reset, yes=True)
    p.add_argument("--repo")
    p.add_argument("--all", action="store_true")
    p.add_argument("--benchmarks", action="store_true")
    command("doctor", doctor)
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    handler = logging.StreamHandler()
    handler.setFormatter(_JsonLog() if args.json_log else logging.Formatter("%(levelname)s: %(message)s"))
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO if args.json_log else logging.WARNING, handlers=[handler])
    args.run(App(args.config), args)


if __name__ == "__main__":
    main()
