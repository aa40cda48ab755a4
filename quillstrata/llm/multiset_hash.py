"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph (a line with a word) is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors, each lane modulo a power of two. The sum does not depend on the order of paragraphs, and a paragraph is inserted
or deleted by adding or subtracting its vector. A vector has two parts:

* EXACT lanes modulo 2**64, filled from a keyed hash of the whole paragraph: equality of multisets of paragraphs;
* SKETCH lanes modulo 2**32, in which each shingle of three words of the paragraph adds +1 or -1 to one lane: for two
  fingerprints the inner product of these lanes estimates what the documents share, so likeness needs no text. A text of
  Spark is shorter than 2**31 bytes and has fewer than 2**30 shingles, so no lane of a document wraps.

Texts without a word have the zero fingerprint.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import truncate_lineage, words_of

EXACT, SKETCH, SHINGLE = 4, 256, 3


def paragraph_hashes(paragraph: bytes) -> np.ndarray:
    """The EXACT lanes of a paragraph."""
    return np.frombuffer(hashlib.blake2b(paragraph, digest_size=8 * EXACT, person=b"paragraph").digest(), np.uint64)


def shingle_hashes(words: list[bytes]) -> list[int]:
    """One hash for each shingle of a paragraph; a paragraph of fewer words is one shingle."""
    h = xxhash.xxh3_64_intdigest
    if len(words) <= SHINGLE:
        return [h(b" ".join(words))]
    return [h(a + b" " + b + b" " + c) for a, b, c in zip(words, words[1:], words[2:], strict=False)]


class Fingerprint:
    """A sum of paragraph vectors."""

    def __init__(self) -> None:
        self.exact = np.zeros(EXACT, np.uint64)
        self.sketch = np.zeros(SKETCH, np.uint32)

    def _vectors(self, paragraphs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        exact, hashes = np.zeros(EXACT, np.uint64), []
        for paragraph in paragraphs:
            words = words_of(paragraph)
            if words:
                exact = exact + paragraph_hashes(b" ".join(words))
                hashes += shingle_hashes(words)
            if len(hashes) > 1 << 18:
                yield exact, self._lanes(hashes)
                exact, hashes = np.zeros(EXACT, np.uint64), []
        yield exact, self._lanes(hashes)

    @staticmethod
    def _lanes(hashes: list[int]) -> np.ndarray:
        h = np.array(hashes, np.uint64)
        signed = np.bincount((h % np.uint64(2 * SKETCH)).astype(np.int64), minlength=2 * SKETCH)
        return (signed[:SKETCH] - signed[SKETCH:]).astype(np.uint32)

    def insert(self, paragraphs: list[str]) -> Fingerprint:
        for exact, sketch in self._vectors(paragraphs):
            self.exact, self.sketch = self.exact + exact, self.sketch + sketch
        return self

    def delete(self, paragraphs: list[str]) -> Fingerprint:
        for exact, sketch in self._vectors(paragraphs):
            self.exact, self.sketch = self.exact - exact, self.sketch - sketch
        return self

    def copy(self) -> Fingerprint:
        other = Fingerprint()
        other.exact, other.sketch = self.exact.copy(), self.sketch.copy()
        return other

    def hex(self) -> str:
        return self.exact.astype(">u8").tobytes().hex() + self.sketch.astype(">u4").tobytes().hex()

    @classmethod
    def from_hex(cls, value: str) -> Fingerprint:
        data, own = bytes.fromhex(value), cls()
        own.exact = np.frombuffer(data[: 8 * EXACT], ">u8").astype(np.uint64)
        own.sketch = np.frombuffer(data[8 * EXACT :], ">u4").astype(np.uint32)
        return own

    def likeness(self, other: Fingerprint) -> float:
        """0 to 1: twice the estimated shared part over both sizes; 1 if and only if the fingerprints are equal."""
        if (self.exact == other.exact).all() and (self.sketch == other.sketch).all():
            return 1.0
        a, b = self.sketch.view(np.int32).astype(np.float64), other.sketch.view(np.int32).astype(np.float64)
        both = float(a @ a + b @ b)
        return min(max(2.0 * float(a @ b) / both, 0.0), 0.9999) if both else 0.0


def fingerprint(text: str | None) -> Fingerprint:
    return Fingerprint().insert((text or "").split("\n"))


class Halves:
    """A text, its fingerprint, and that of the whole paragraphs which an edit of its last half leaves alone."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.half = doc_id, text, len(text) // 2
        kept = text[: len(text) - self.half]
        cut = kept.rfind("\n") + 1
        self.rest = kept[cut:]
        self.shared = Fingerprint().insert(kept[:cut].split("\n"))
        self.own = self.shared.copy().insert(text[cut:].split("\n"))

    def edited(self, following: str) -> tuple[str, Fingerprint]:
        """The text whose last half is replaced by as much of the following text, and its fingerprint."""
        new = following[: self.half]
        changed = self.text[: len(self.text) - self.half] + new
        return changed, self.shared.copy().insert((self.rest + new).split("\n"))


FIELDS = {
    "doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string",
    "edited_fingerprint": "string", "near_edited": "double", "near_next": "double",
}


#: Bytes of text that a run of ids should hold, and how finely ids are cut before runs of that size are put together.
RUN_BYTES, FINE = 64 << 20, 4
_LEAST = -(1 << 63)


def _number(bounds: list[tuple[int, int]]) -> Column:
    """How many of the ascending bounds are at most the row's (_id, _h), by binary search."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*(F.struct(F.lit(i).cast("bigint"), F.lit(h).cast("bigint")) for i, h in bounds))
    own = F.struct(F.col("_id"), F.col("_h"))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))

    def step(at: Column, size: Column) -> Column:
        return F.when((at + size <= len(bounds)) & (F.element_at(listed, F.least(at + size, F.lit(len(bounds)))) <= own), at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def run_bounds(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Ascending (_id, _h) at which runs begin, so that runs hold about as many bytes each: at least ``parts`` runs, more
    where these would hold over RUN_BYTES. A hot id is cut by the hash of its texts.

    They decide how even the runs are, and not what is found. The driver holds some numbers for each run.
    """
    total = rows.agg(F.sum("_bytes")).head()[0] or 0
    runs = max(parts, -(-total // RUN_BYTES))
    fine = FINE * runs
    found = sorted(int(c) for c in rows.stat.approxQuantile("_id", [i / fine for i in range(1, fine)], 0.25 / fine))
    bounds: list[tuple[int, int]] = []
    for c in sorted(set(found)):
        times = bisect_right(found, c) - bisect_left(found, c)
        bounds += [(c, _LEAST + (k << 64) // times) for k in range(times)]
    held = {r["_n"]: r["_b"] for r in rows.groupBy(_number(bounds).alias("_n")).agg(F.sum("_bytes").alias("_b")).collect()}
    kept, size = [], held.get(0, 0)
    for k, bound in enumerate(bounds, 1):
        if size + held.get(k, 0) > total / runs and size:
            kept.append(bound)
            size = 0
        size += held.get(k, 0)
    return kept


def in_runs(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Rows (doc_id, text, _h, _run, _guard) and the number of runs: a run holds rows that follow one another in the order
    of (doc_id, _h, text), null ids first, and as a guard the row after them, which the next run has as well."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST)), "_h": F.xxhash64("text")})
    narrow = truncate_lineage(rows.select("_id", "_h", F.octet_length("text").cast("bigint").alias("_bytes")))
    bounds = run_bounds(narrow, parts)
    number = _number(bounds)
    firsts = narrow.groupBy(number.alias("_run")).agg(F.min(F.struct("_id", "_h")).alias("at")).orderBy("_run").collect()  # a row for each run
    placed = rows.withColumn("_run", number)
    guarded: list[Column] = [F.lit(None)] * (len(bounds) + 1)
    for k, r in enumerate(firsts):
        guarded[r["_run"]] = F.struct(F.lit(r["at"]._id).alias("_id"), F.lit(r["at"]._h).alias("_h"), F.lit(firsts[k - 1]["_run"]).alias("to"))
    start = F.element_at(F.array(*guarded).cast("array<struct<_id:bigint,_h:bigint,to:int>>"), F.col("_run") + 1)
    own = F.struct(F.col("_run").alias("to"), F.lit(False).alias("guard"))
    guard = F.struct(start["to"].alias("to"), F.lit(True).alias("guard"))
    is_first = (F.col("_id") == start["_id"]) & (F.col("_h") == start["_h"])
    dealt = placed.withColumn("_to", F.explode(F.when(is_first, F.array(own, guard)).otherwise(F.array(own))))
    return dealt.select("doc_id", "text", "_h", F.col("_to.to").alias("_run"), F.col("_to.guard").alias("_guard")), len(bounds) + 1


def compare_with_next(docs: DataFrame) -> DataFrame:
    """The columns of FIELDS for each row. The next document is the next one in the order of doc_id, null ids first; ties
    go by a hash of the text, then by the text; after the last comes the first, so a single row is its own next.

    Null texts are empty. Other columns are not read, so they may have any name. Repeated rows follow one another, each
    with its own result. An empty table gives an empty one. Texts of any length are read in whole; they cross the network
    once, dealt out by runs of ids, and are streamed in order within a run.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, runs = in_runs(docs, parts)
    in_order = dealt.repartitionById(runs, F.col("_run")).sortWithinPartitions("_run", "_guard", F.col("doc_id").asc_nulls_first(), "_h", "text")
    return in_order.mapInArrow(_follow, ", ".join(f"{k} {v}" for k, v in FIELDS.items()))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(k, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[v]) for k, v in FIELDS.items()])
    waiting: Halves | None = None  # the last row that has not met its next one
    out: list[tuple] = []
    for batch in batches:
        for doc_id, text, guard in zip(batch.column("doc_id"), batch.column("text"), batch.column("_guard"), strict=True):
            is_guard = guard.as_py()
            if is_guard and waiting is None:
                continue  # a repeated id of the next bucket's first row
            now = Halves(doc_id.as_py(), text.as_py())
            if waiting is not None:
                changed, other = waiting.edited(now.text)
                digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                near = waiting.own.likeness(other), waiting.own.likeness(now.own)
                out.append((waiting.doc_id, len(waiting.text), digest, waiting.own.hex(), other.hex(), *near))
            waiting = None if is_guard else now
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
