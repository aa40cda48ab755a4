"""Configuration: repos, where data lies, and embedding profiles."""

from __future__ import annotations

import os
import shutil
import sys
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from quillstrata.store import check_profile

HOME = Path.home() / ".quillstrata"
IGNORE_FILE = ".quillstrataignore"
_KEPT = ("repos", "data_dir", "embedding", "reranking")


@dataclass
class Repo:
    name: str
    path: str

    def resolved_path(self) -> Path:
        return Path(self.path).expanduser().resolve()


@dataclass
class Profile:
    backend: str = "hash"
    model: str = "256"
    url: str = "http://localhost:11434"


@dataclass
class Config:
    repos: list[Repo] = field(default_factory=list)
    data_dir: str = str(HOME / "data")
    profiles: dict[str, Profile] = field(default_factory=lambda: {"default": Profile()})
    active: str = "default"
    rerank: bool = False

    @property
    def data_path(self) -> Path:
        return Path(self.data_dir).expanduser().resolve()

    @property
    def profile(self) -> Profile:
        return self.profiles[self.active]

    def repo_paths(self) -> dict[str, str]:
        return {r.name: str(r.resolved_path()) for r in self.repos}


def _profile(raw: dict | None) -> Profile:
    raw, base = raw or {}, Profile()
    return Profile(raw.get("backend", base.backend), str(raw.get("model", base.model)), raw.get("url", raw.get("ollama_url", base.url)))


def parse(raw: dict) -> Config:
    """``embedding`` is one profile, or ``profiles`` by name with ``active``, which may be left out if there is but one."""
    embedding = raw.get("embedding") or {}
    named = embedding.get("profiles")
    if named:
        profiles = {check_profile(n): _profile(p) for n, p in named.items()}
        active = embedding.get("active") or (next(iter(profiles)) if len(profiles) == 1 else None)
        if active not in profiles:
            raise ValueError(f"embedding.active must be one of {sorted(profiles)}, not {active!r}")
    else:
        profiles, active = {"default": _profile(embedding)}, "default"
    repos = [Repo(r["name"], r["path"]) for r in raw.get("repos") or []]
    return Config(repos, raw.get("data_dir") or str(HOME / "data"), profiles, active, bool((raw.get("reranking") or {}).get("enabled", False)))


def _read(path: Path) -> dict:
    try:
        return yaml.safe_load(path.read_text()) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"not valid YAML: {path}: {e}") from e


def load(path: str | Path | None = None) -> Config:
    """From the file; where there is none, from the environment (QUILLSTRATA_DATA_DIR, _BACKEND, _MODEL, _URL)."""
    path = Path(path or HOME / "config.yaml")
    if path.exists():
        return parse(_read(path))
    given = {k: os.environ[f"QUILLSTRATA_{k.upper()}"] for k in ("backend", "model", "url") if os.environ.get(f"QUILLSTRATA_{k.upper()}")}
    return parse({"embedding": given, "data_dir": os.environ.get("QUILLSTRATA_DATA_DIR")})


def _write(path: Path, raw: dict) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_name(path.name + ".tmp")
    new.write_text(yaml.safe_dump(raw, sort_keys=False))
    new.replace(path)


def write_default(path: str | Path | None = None, force: bool = False) -> Path:
    """A configuration to start from. ``force`` writes over one but keeps its settings; one that can't be read is copied
    to .bak first."""
    path = Path(path or HOME / "config.yaml")
    raw: dict = {"repos": [], "data_dir": "~/.quillstrata/data", "embedding": {"backend": "hash", "model": "256"}, "reranking": {"enabled": False}}
    if path.exists():
        if not force:
            raise FileExistsError(path)
        try:
            raw |= {k: v for k, v in _read(path).items() if k in _KEPT and v}
        except ValueError as e:
            shutil.copy(path, path.with_name(path.name + ".bak"))
            sys.stderr.write(f"Warning: {e}; kept as {path.name}.bak\n")
    _write(path, raw)
    return path


def add_repo(directory: str, name: str | None = None, path: str | Path | None = None) -> Repo:
    path = Path(path or HOME / "config.yaml")
    root = Path(directory).expanduser().resolve()
    if not root.is_dir():
        raise FileNotFoundError(f"not a directory: {root}")
    if not path.exists():
        write_default(path)
    raw = _read(path)
    repos = raw.get("repos") or []
    repo = Repo(name or root.name, str(root))
    if any(r.get("name") == repo.name for r in repos):
        raise ValueError(f"there is a repo {repo.name!r} already")
    _write(path, raw | {"repos": [*repos, {"name": repo.name, "path": repo.path}]})
    return repo


def remove_repo(name: str, path: str | Path | None = None) -> bool:
    path = Path(path or HOME / "config.yaml")
    raw = _read(path) if path.exists() else {}
    repos = raw.get("repos") or []
    left = [r for r in repos if r.get("name") != name]
    if len(left) == len(repos):
        return False
    _write(path, raw | {"repos": left})
    return True


@dataclass(frozen=True)
class FoundFile:
    repo: Repo
    path: Path
    file: str  # within the repo, with forward slashes


def find_file(name: str, repos: list[Repo], repo: str | None = None) -> FoundFile:
    """The repo and path of a file that is named within ``repo``, by a path inside of a repo, or as repo/path."""
    if repo is not None:
        own = [r for r in repos if r.name == repo]
        if not own:
            raise ValueError(f"no repo {repo!r} in the configuration")
        return _inside(own[0], name)
    full = Path(name).expanduser().resolve()
    holding = [r for r in repos if full.is_relative_to(r.resolved_path())]
    if holding:
        best = max(holding, key=lambda r: len(str(r.resolved_path())))
        return _inside(best, str(full.relative_to(best.resolved_path())))
    first, slash, rest = name.partition("/")
    for r in repos:
        if slash and r.name == first:
            return _inside(r, rest)
    raise ValueError(f"no repo holds {name!r}; name one with --repo")


def _inside(repo: Repo, name: str) -> FoundFile:
    root = repo.resolved_path()
    full = (root / name).resolve()
    if not full.is_relative_to(root):
        raise ValueError(f"{name!r} lies outside of {root}")
    return FoundFile(repo, full, full.relative_to(root).as_posix())
