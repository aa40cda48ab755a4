"""What is known about repos and profiles: a small catalog in one JSON file, replaced as a whole on each change."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path

_STATE = ("idx_sha", "idx_branch", "idx_chunks", "idx_at", "pending")


class Catalog:
    """``repos``: name → path and the last index of the default profile. ``meta``: profile → key → value."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.data: dict = json.loads(self.path.read_text()) if self.path.exists() else {"version": 1, "repos": {}, "meta": {}}
        self._depth = 0

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """Changes within are written together, or not at all."""
        before = json.dumps(self.data)
        self._depth += 1
        try:
            yield
        except BaseException:
            self.data = json.loads(before)
            raise
        finally:
            self._depth -= 1
        if not self._depth:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            new = self.path.with_name(f"{self.path.name}-{uuid.uuid4().hex}.tmp")
            with open(new, "w") as f:
                json.dump(self.data, f, indent=1, sort_keys=True)
                f.flush()
                os.fsync(f.fileno())
            new.replace(self.path)

    def get_meta(self, key: str, profile: str = "default") -> str | None:
        return self.data["meta"].get(profile, {}).get(key)

    def set_meta(self, key: str, value: str, profile: str = "default") -> None:
        with self.transaction():
            self.data["meta"].setdefault(profile, {})[key] = value

    def get_repo_index(self, repo: str, profile: str = "default") -> dict:
        """sha, branch, chunks and indexed_at; a default profile without them takes those of the repo's own row."""
        meta = self.data["meta"].get(profile, {})
        found = {n: meta.get(f"{k}:{repo}") or None for k, n in (("idx_sha", "sha"), ("idx_branch", "branch"), ("idx_chunks", "chunks"), ("idx_at", "indexed_at"))}
        row = self.data["repos"].get(repo)
        if profile == "default" and found["sha"] is None and row and row.get("last_indexed_sha"):
            found = {"sha": row["last_indexed_sha"], "branch": row["last_indexed_branch"], "chunks": row["chunk_count"], "indexed_at": row["last_indexed_at"]}
        found["chunks"] = int(found["chunks"] or 0)
        return found

    def set_repo_index(self, repo: str, sha: str, branch: str, chunks: int, profile: str = "default") -> None:
        now = datetime.now(UTC).isoformat()
        with self.transaction():
            for key, value in (("idx_sha", sha), ("idx_branch", branch), ("idx_chunks", str(chunks)), ("idx_at", now)):
                self.set_meta(f"{key}:{repo}", value, profile)
            if profile == "default" and repo in self.data["repos"]:
                self.data["repos"][repo] |= {"last_indexed_sha": sha, "last_indexed_branch": branch, "last_indexed_at": now, "chunk_count": chunks}

    def upsert_repo(self, name: str, path: str) -> None:
        with self.transaction():
            row = self.data["repos"].setdefault(name, {"last_indexed_sha": None, "last_indexed_branch": None, "last_indexed_at": None, "chunk_count": 0})
            row["path"] = path

    def get_repo(self, name: str) -> dict | None:
        row = self.data["repos"].get(name)
        return {"name": name, **row} if row else None

    def list_repos(self) -> list[dict]:
        return [self.get_repo(n) for n in sorted(self.data["repos"])]

    def delete_repo(self, name: str) -> None:
        with self.transaction():
            self.data["repos"].pop(name, None)
            self.clear_repo(name)

    def clear_repo(self, name: str) -> None:
        """In every profile; of names with a common beginning only the one."""
        with self.transaction():
            for meta in self.data["meta"].values():
                for key in _STATE:
                    meta.pop(f"{key}:{name}", None)

    def clear_profile(self, profile: str) -> None:
        with self.transaction():
            self.data["meta"].pop(profile, None)

    def clear_all(self) -> None:
        """What says that something is indexed, of every profile and repo."""
        with self.transaction():
            self.data["meta"] = {}
            for row in self.data["repos"].values():
                row |= {"last_indexed_sha": None, "last_indexed_branch": None, "last_indexed_at": None, "chunk_count": 0}
