"""Quality rules from a suffix array over the words of each text.

Suffixes are ranked by prefix doubling; common prefixes of neighbours in suffix order come from the same rank tables or,
for texts of over ``TABLED`` words, from Kasai's scan, whose memory is linear. At each word position the longer of the two
neighbouring common prefixes is the longest repeat that starts there, so the spans of these lengths together are the
union of all maximal repeated substrings. A text fails when repeats of at least ``min_words`` words cover too many of its
characters, or when a single repeat is too long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import words_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Limits:
    """min_words: shortest repeat that counts. max_covered: share of word characters in repeats, at most. max_longest:
    words of a single repeat, at most, however long the text is."""

    min_words: int = 4
    max_covered: float = 0.25
    max_longest: int = 50


#: Words up to which the rank tables of all levels are kept at once: 17 levels of 8 bytes a word.
TABLED = 1 << 17


def _doubled(ranks: np.ndarray, step: int) -> np.ndarray:
    """Ranks of the prefixes of 2 * ``step`` symbols from those of ``step``; a last entry -1 is the end."""
    n = len(ranks) - 1
    key = ranks[:n] * (n + 1)
    key[: n - step] += ranks[step:n] + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    out = np.empty(n + 1, np.int64)
    out[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    out[n] = -1
    return out


def rank_tables(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of the prefixes of 1, 2, 4, ... symbols of each suffix, up to where all differ."""
    n = len(ids)
    tables = [np.append(ids, -1)]
    while n > 1 and tables[-1].max() < n - 1 and 1 << len(tables) - 1 < n:
        tables.append(_doubled(tables[-1], 1 << len(tables) - 1))
    return tables


def prefixes_by_tables(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the common prefix of each suffix with the next one in it."""
    tables = rank_tables(ids)
    order = np.argsort(tables[-1][: len(ids)], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), np.int64)
    for level in range(len(tables) - 1, -1, -1):
        same = tables[level][a] == tables[level][b]
        common[same] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    return order, common


def prefixes_by_scan(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by Kasai's scan (CPM 2001): from one text position to the next a common prefix loses one symbol at most."""
    n = len(ids)
    ranks, step = np.append(ids, -1), 1
    while ranks.max() < n - 1 and step < n:
        ranks, step = _doubled(ranks, step), 2 * step
    order = np.argsort(ranks[:n], kind="stable")
    following = np.full(n, n)
    following[order[:-1]] = order[1:]
    symbols, common, size = ids.tolist(), np.zeros(n, np.int64), 0
    for i, j in enumerate(following.tolist()):
        if j == n:
            size = 0
            continue
        while i + size < n and j + size < n and symbols[i + size] == symbols[j + size]:
            size += 1
        common[i] = size
        size = max(0, size - 1)
    return order, common[order[:-1]]


def repeat_lengths(ids: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring from there that occurs at another position too.

    ``ids``: symbols numbered 0, 1, ... in order of first occurrence, none left out.
    """
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order, common = (prefixes_by_tables if n <= TABLED else prefixes_by_scan)(ids)
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    return longest


def covered(longest: np.ndarray, min_words: int) -> np.ndarray:
    """Which positions lie in a repeat of at least ``min_words``."""
    n = len(longest)
    starts = np.flatnonzero(longest >= min_words)
    if not len(starts):
        return np.zeros(n, bool)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + longest[starts], -1)
    return np.cumsum(steps)[:n] > 0


def repeated_spans(words: list, min_words: int = 5) -> list[tuple[int, int]]:
    """Word spans (start, end), ascending and disjoint: the union of the maximal repeats of at least ``min_words``."""
    number: dict = {}
    inside = covered(repeat_lengths(np.array([number.setdefault(w, len(number)) for w in words], np.int64)), min_words)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2], strict=True)]


FIELDS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
    "base_failed": "boolean", "kept": "boolean", "covered_chars": "bigint", "longest_repeat": "bigint",
}


def measure(text: str | None, limits: Limits = Limits()) -> tuple:
    """The values of FIELDS for one text."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    n_dup_lines = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    take = number.setdefault
    ids = np.fromiter((take(w, len(number)) for w in words), np.int64, n)
    longest = repeat_lengths(ids)
    most = int(longest.max()) if n else 0
    n_repeat_words = covered_chars = 0
    if most >= min(5, limits.min_words):
        n_repeat_words = int(covered(longest, 5).sum())
        spans = np.flatnonzero(covered(longest, limits.min_words)).tolist()
        covered_chars = sum(len(words[i].decode("utf-8", "surrogatepass")) for i in spans)
    failed = n < 10 or 100 * n_repeat_words > 20 * n
    kept = not failed and covered_chars <= limits.max_covered * word_chars and most <= limits.max_longest
    return n, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, kept, covered_chars, most


def rules(text: Column, limits: Limits = Limits()) -> Column:
    """A struct of FIELDS for a text column. Null and empty texts have no words, fail the base rules and are not kept."""

    @F.arrow_udf("struct<" + ", ".join(f"{k}: {v}" for k, v in FIELDS.items()) + ">")
    def run(texts: pa.Array) -> pa.Array:
        rows = [measure(t.as_py(), limits) for t in texts]
        columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
        kinds = [pa.bool_() if v == "boolean" else pa.int64() for v in FIELDS.values()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(FIELDS))

    return run(text)


def quality_report(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id and FIELDS for each row; other columns are not read, so they may have any name.

    Null and empty texts have no words, fail the base rules and are not kept; null ids stay null; repeated rows give
    repeated results; values at a limit are kept; very long texts are measured in whole; an empty table gives an empty one.
    """
    done = docs.select("doc_id", rules(F.col("text"), limits).alias("_rules"))
    return done.select("doc_id", *(F.col(f"_rules.{k}").alias(k) for k in FIELDS))


def kept_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs``, all columns as they are whatever their names, whose text passes; null, empty and very long
    texts, null ids, repeated rows and empty tables as in ``quality_report``."""
    return docs.where(rules(F.col("text"), limits)["kept"])
