"""Embedding backends, and how they run over a table.

``HashBackend`` needs no model and no network: it is the default. ``HttpBackend`` talks to an embedding server with the
endpoints /api/tags and /api/embed, ``LocalBackend`` wraps a sentence-embedding model that is installed.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import time
import urllib.error
import urllib.request
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a model wants in front of documents and queries.
PREFIXES = {
    "qwen3-embedding": ("", "Instruct: Given a code search query, retrieve relevant code snippets\nQuery: "),
    "qwen3-embedding:0.6b": ("", "Instruct: Given a code search query, retrieve relevant code snippets\nQuery: "),
    "nomic-embed-text": ("search_document: ", "search_query: "),
    "nomic-ai/CodeRankEmbed": ("", "Represent this query for searching relevant code: "),
}
OUTER, INNER = 32, 8
#: Characters to which a refused text is cut at most.
SHORTEST = 2000
_WORD = re.compile(r"\w+")


class Backend(Protocol):
    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...
    def embed_query(self, text: str) -> list[float]: ...
    def dims(self) -> int: ...
    def model_name(self) -> str: ...


def _slot(part: str, dims: int) -> int:
    """Where a part counts: below ``dims`` what adds, above it what takes away."""
    h = int.from_bytes(hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return h % dims + (0 if h >> 63 else dims)


_trigram = lru_cache(maxsize=1 << 16)(_slot)


@lru_cache(maxsize=1 << 16)
def _slots(word: str, dims: int) -> bytes:
    """Slots of a word, as 32-bit numbers: that of the word, 2 * ``dims`` higher, then its trigrams'."""
    padded = f"<{word}>"
    return array("i", (_slot(padded, dims) + 2 * dims, *(_trigram(padded[i : i + 3], dims) for i in range(len(word))))).tobytes()


class HashBackend:
    """Signed hashing of words and of their character trigrams, scaled to unit length: texts that share words are near."""

    def __init__(self, dims: int = 256):
        self._dims = dims

    def _one(self, text: str) -> list[float]:
        d = self._dims
        words = Counter(_WORD.findall(text.lower()))
        slots = np.frombuffer(b"".join(_slots(w, d) for w in words), np.int32)
        times = np.repeat(np.fromiter(words.values(), np.float64, len(words)), [1 + len(w) for w in words])
        n = np.bincount(slots, times, 4 * d).reshape(4, d)  # whole numbers, so that sums are exact in any order
        out = (n[2] - n[3]) + 0.25 * (n[0] - n[1])
        norm = float(np.sqrt(out @ out))
        return (out / norm if norm else out).tolist()

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        return self._one(text)

    def dims(self) -> int:
        return self._dims

    def model_name(self) -> str:
        return f"hash-{self._dims}"


class HttpBackend:
    """An embedding server. ``post`` and ``wait`` can be replaced in tests."""

    def __init__(self, model: str, url: str = "http://localhost:11434", post=None, wait=time.sleep, check: bool = True):
        self.model, self.url = model, url.rstrip("/")
        self._post, self._wait = post, wait
        self.prefixes = PREFIXES.get(model, ("", ""))
        self._dims: int | None = None
        if check:
            available(self.url, model)

    def _send(self, texts: list[str]) -> list[list[float]]:
        if self._post is not None:
            return self._post(texts)
        data = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(f"{self.url}/api/embed", data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=120) as answer:
            return json.load(answer)["embeddings"]

    def _tried(self, texts: list[str]) -> list[list[float]]:
        """Three tries with waits of 1 and 2 seconds; time-outs are raised at once. A vector for each text, or ValueError."""
        last: Exception | None = None
        for k in range(3):
            if k:
                self._wait(k)
            try:
                found = self._send(texts)
            except TimeoutError:
                raise
            except urllib.error.HTTPError as e:
                last = e
            except (ConnectionError, urllib.error.URLError) as e:
                if isinstance(getattr(e, "reason", None), TimeoutError):
                    raise TimeoutError(str(e)) from e
                last = ConnectionError(f"no answer from {self.url}: {e}")
            else:
                if len(found) != len(texts):
                    raise ValueError(f"{self.url} gave {len(found)} vectors for {len(texts)} texts")
                return found
        raise last

    def _embed(self, texts: list[str]) -> list[list[float]]:
        """Batches from a work list: one that the server refuses comes back as two halves. A text that it refuses alone is
        embedded by its beginning, half as long each time, down to SHORTEST characters, and that is said on stderr."""
        found: dict[int, list[float]] = {}
        work = [list(range(i, min(i + INNER, len(texts)))) for i in reversed(range(0, len(texts), INNER))]
        sizes = [len(t) for t in texts]
        while work:
            batch = work.pop()
            try:
                vectors = self._tried([texts[i][: sizes[i]] for i in batch])
            except urllib.error.HTTPError:
                half, i = len(batch) // 2, batch[0]
                if half:
                    work += [batch[half:], batch[:half]]
                elif sizes[i] > SHORTEST:
                    sizes[i] = max(SHORTEST, sizes[i] // 2)
                    print(f"Warning: a text of {len(texts[i])} characters was refused; trying its first {sizes[i]}", file=sys.stderr)
                    work.append(batch)
                else:
                    raise
            else:
                found.update(zip(batch, vectors, strict=True))
        return [found[i] for i in range(len(texts))]

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return self._embed([self.prefixes[0] + t for t in texts])

    def embed_query(self, text: str) -> list[float]:
        return self._embed([self.prefixes[1] + text])[0]

    def dims(self) -> int:
        if self._dims is None:
            self._dims = len(self.embed_query("dimensions"))
        return self._dims

    def model_name(self) -> str:
        return self.model


@cache
def available(url: str, model: str) -> None:
    """ConnectionError if there is no server, ValueError if it lacks the model."""
    try:
        with urllib.request.urlopen(f"{url}/api/tags", timeout=5) as answer:
            names = [m.get("name", "") for m in json.load(answer).get("models", [])]
    except (OSError, ValueError) as e:
        raise ConnectionError(f"no embedding server at {url}: {e}") from e
    if not any(n == model or n.split(":")[0] == model.split(":")[0] for n in names):
        raise ValueError(f"the server at {url} has no model {model!r}")


class LocalBackend:
    """A model of the sentence-transformers package, loaded once in each process."""

    def __init__(self, model: str):
        from sentence_transformers import SentenceTransformer

        self.model, self.own = model, SentenceTransformer(model, trust_remote_code=True)
        self.prefixes = PREFIXES.get(model, ("", ""))

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return self.own.encode([self.prefixes[0] + t for t in texts]).tolist()

    def embed_query(self, text: str) -> list[float]:
        return self.own.encode([self.prefixes[1] + text])[0].tolist()

    def dims(self) -> int:
        return self.own.get_sentence_embedding_dimension()

    def model_name(self) -> str:
        return self.model


def create_backend(backend: str = "hash", model: str = "", url: str = "http://localhost:11434") -> Backend:
    if backend == "hash":
        return HashBackend(int(model) if model.isdigit() else 256)
    if backend in ("http", "ollama"):
        return HttpBackend(model, url)
    if backend in ("local", "sentence-transformers"):
        return LocalBackend(model)
    raise ValueError(f"unknown embedding backend {backend!r}")


def embed_column(text: Column, backend: Backend) -> Column:
    """Vectors in the order of the rows: a batch goes to the backend OUTER texts at a time."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch]
            vectors = [v for i in range(0, len(texts), OUTER) for v in backend.embed_documents(texts[i : i + OUTER])]
            yield pa.array(vectors, pa.list_(pa.float32()))

    return run(text)


def embed_chunks(chunks: DataFrame, backend: Backend) -> DataFrame:
    return chunks.withColumn("vector", embed_column(F.col("text"), backend))
