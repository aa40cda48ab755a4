"""Quality classifier: naive Bayes support vectors (Wang and Manning, ACL 2012).

Features are indicators of n-grams of the whole text: words and word pairs in lower case, byte trigrams of the lower-cased
text, runs of one to four characters after letters, digits and other scripts are each folded to one sign, and runs of one
to four recurrences (for each word: how many words ago it stood last, if less than RECENT). Each indicator is scaled by
the log ratio of its smoothed frequencies in the two classes; a linear hinge-loss model is fitted on these by dual
coordinate descent, and a sigmoid turns margins into scores.

Long texts are read in runs of CHUNK bytes that overlap by an n-gram, and of CHUNK words, to bound scratch memory; an
n-gram is found whatever run it lies in, so the result does not depend on the runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstrata.llm.common import fold
from quillstrata.llm.linear import fit_hinge, fit_sigmoid, margins

BITS = 20
CHUNK = 1 << 18
RECENT = 64
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").finditer
_MIX = np.uint32(2654435761)


def _shape(c: int) -> int:
    """Letters, capitals, digits and bytes of other scripts as one sign each; the rest as it is."""
    if c >= 128:
        return ord("a")
    return ord("a" if chr(c).islower() else "A" if chr(c).isupper() else "0" if chr(c).isdigit() else " " if c in (9, 11, 12, 13) else chr(c))


_SHAPES = bytes(map(_shape, range(256)))
_LOWER = bytes(ord(chr(c).lower()) if c < 128 else c for c in range(256))


def _hashed(code: np.ndarray, salt: int) -> np.ndarray:
    return ((code ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * _MIX) >> np.uint32(32 - BITS)


def _recurrences(codes: np.ndarray, before: dict[int, int], at: int) -> np.ndarray:
    """For each word, how many words ago it stood last, 0 if that is RECENT or more; ``before`` and ``at`` go on."""
    out = np.zeros(len(codes), np.uint32)
    for k, code in enumerate(codes.tolist(), at):
        ago = k - before.get(code, k - RECENT)
        if ago < RECENT:
            out[k - at] = ago
        before[code] = k
    return out


def _runs(signs: np.ndarray, salt: int) -> Iterator[np.ndarray]:
    """Numbers of the runs of one to four signs below 256."""
    code = signs
    for n in range(4):
        if n:
            code = code[:-1] << np.uint32(8) | signs[n:]
        yield _hashed(code, salt + n)


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Arrays of n-gram numbers of one text, with repeats."""
    raw = text.encode("utf-8", "surrogatepass")
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK + 3]
        yield from _runs(np.frombuffer(part.translate(_SHAPES), np.uint8).astype(np.uint32), 1)
        b = np.frombuffer(part.translate(_LOWER), np.uint8).astype(np.uint32)
        yield _hashed(b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:], 5)
    words = (m[0] for m in _WORDS(raw.lower()))
    codes, signs = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    before: dict[int, int] = {}
    at = 0
    while len(more := np.fromiter(map(crc32, islice(words, CHUNK)), np.uint32)):
        yield _hashed(more, 6)
        codes = np.concatenate((codes[-1:], more))
        yield _hashed(codes[:-1] * np.uint32(31) + codes[1:], 7)
        signs = np.concatenate((signs[-3:], _recurrences(more, before, at)))
        yield from _runs(signs, 8)
        at += len(more)


def distinct(text: str | None, known: np.ndarray, size: int) -> np.ndarray:
    """The model's n-grams that the text has, ascending. known: number of each n-gram in the model, or -1."""
    mark = np.zeros(size, bool)
    for part in ngrams(text or ""):
        found = known[part]
        mark[found[found >= 0]] = True
    return np.flatnonzero(mark)


@dataclass
class Model:
    known: np.ndarray
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def score(self, text: str | None) -> float:
        """Likelihood of label 1, from 0 to 1."""
        margin = float(self.weights[distinct(text, self.known, len(self.weights))].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -35, 35))))


def fit(samples: list[tuple[str, int]], least: int = 5, most: int = 30_000, alpha: float = 1.0, cost: float = 1.0) -> Model:
    """A model from (text, label 0 or 1) pairs. Kept are the ``most`` n-grams of largest |log-count ratio| times square
    root of frequency among those in at least ``least`` texts. With labels of one class only, or none, the score is
    that class's (or 0.5) for every text."""
    everything = np.arange(1 << BITS, dtype=np.int32)
    sets = [distinct(text, everything, 1 << BITS) for text, _ in samples]
    y = np.array([label for _, label in samples], np.int64)
    if len(set(y.tolist())) < 2:
        only = {0: -35.0, 1: 35.0}[int(y[0])] if len(y) else 0.0
        return Model(np.full(1 << BITS, -1, np.int32), np.zeros(0), 0.0, 0.0, only)
    counts = np.zeros((2, 1 << BITS))
    for s, label in zip(sets, y, strict=True):
        counts[label, s] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    # in texts with and without the n-gram: presence is a Bernoulli event for each class
    ratio = np.log((counts[1] + alpha) / (n[1] + 2 * alpha)) - np.log((counts[0] + alpha) / (n[0] + 2 * alpha))
    total = counts.sum(axis=0)
    worth = np.where(total >= least, np.abs(ratio) * np.sqrt(total), 0.0)
    kept = np.sort(np.argsort(-worth, kind="stable")[: min(most, int((worth > 0).sum()))])
    known = np.full(1 << BITS, -1, np.int32)
    known[kept] = np.arange(len(kept), dtype=np.int32)
    scale = ratio[kept]
    rows = []
    for s in sets:
        index = known[s]
        index = index[index >= 0].astype(np.int64)
        rows.append((index, scale[index]))
    sign = np.where(y == 1, 1.0, -1.0)
    balance = np.where(y == 1, len(y) / (2 * n[1]), len(y) / (2 * n[0]))
    w = fit_hinge(rows, sign, len(kept), cost * balance / 100)
    # the sigmoid's own margins come from folds that the weights have not seen
    out = np.zeros(len(rows))
    part = np.arange(len(rows)) % 3
    for k in range(3):
        own = [r for r, p in zip(rows, part, strict=True) if p != k]
        if len(set(sign[part != k])) == 2:
            v = fit_hinge(own, sign[part != k], len(kept), (cost * balance / 100)[part != k])
            out[part == k] = margins([r for r, p in zip(rows, part, strict=True) if p == k], v)
    a, b = fit_sigmoid(out, y == 1)
    return Model(known, w[:-1] * scale, float(w[-1]), a, b)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_chars: int = 20_000) -> list[tuple[str, int]]:
    """At most ``per_class`` labelled texts of each class, in the order of a hash of the id; longer ones than ``max_chars``
    are taken last, so only where a class has too few others. What the driver holds is bounded by these parameters.

    Rows of fold 0 of 5 are never taken, nor null labels, nor null texts. Labels that repeat an id count once (the lower
    one). They are thinned by a hash of the id before they meet the documents.
    """
    marked = labels.where((fold(F.col("doc_id"), 5) != 0) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("q"))
    seen = {r.q: r["count"] for r in marked.groupBy("q").count().collect()}
    if not seen:
        return []
    order = F.xxhash64(F.col("doc_id"), F.lit("nbsvm"))
    share = F.create_map(*(x for q, n in sorted(seen.items()) for x in (F.lit(q), F.lit(min(1.0, 2.0 * per_class / n)))))
    near = (F.pmod(order, F.lit(1 << 20)) / float(1 << 20)) < share[F.col("q")]
    few = marked.where(near).select("doc_id", "q", order.alias("o"))
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    place = F.row_number().over(W.partitionBy("q").orderBy(F.length("text") > max_chars, "o", "text"))
    # ``few`` has one row an id and about 4 * per_class rows, whatever the size of the table: a bound that the shares set
    joined = texts.join(F.broadcast(few), "doc_id").withColumn("place", place)
    rows = joined.where(F.col("place") <= per_class).select("o", "text", "q").collect()
    return [(r.text, r.q) for r in sorted(rows)]


def scored(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return run(text)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; only doc_id (for the fold) and text are read, so other columns may
    have any name. Null texts score as empty ones; a null id is not held out; an empty table gives an empty one; repeated
    rows give repeated results. Very long texts are scored in whole; a score at the threshold is predicted 1."""
    done = docs.select("doc_id", scored(F.col("text"), model).alias("score"))
    held = fold(F.col("doc_id"), 5) == 0
    return done.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
