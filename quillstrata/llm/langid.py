"""Language identification by hierarchical discrimination.

A text is first given to a family of languages by linear support vector machines, one for each family against the rest;
then one-versus-one machines separate the languages within that family by votes. Features are hashed byte trigrams of
the lower-cased letters, as shares of the text's trigrams, so a score is the mean weight over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstrata.llm.common import fold
from quillstrata.llm.linear import fit_hinge

#: Families of ISO 639-1 codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es it pt ro ca gl oc la co",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "turkic": "tr az kk uz ky tt",
    "indic": "hi bn ur pa mr gu ne si",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

BITS = 16
UNKNOWN = "und"
#: ASCII in lower case, anything there but letters as a space; other bytes stay.
_TABLE = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
_MIX = np.uint32(2654435761)


def family(lang: str) -> str:
    return FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the words; runs of non-letters are one space."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * _MIX) >> np.uint32(32 - BITS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    index, count = np.unique(trigrams(text), return_counts=True)
    return index.astype(np.int64), count / count.sum() * SCALE


#: Shares are small numbers; scaled up, so that a unit cost does not leave the machines without weight.
SCALE = 50.0


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # a column for each family, then for each pair
    bias: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is the product of the sigmoid margins of the family and of the closest pair."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        codes = trigrams(text)
        totals = np.zeros(self.weights.shape[1])
        for i in range(0, len(codes), 1 << 18):
            totals += self.weights[codes[i : i + (1 << 18)]].sum(axis=0, dtype=np.float64)
        value = totals * (SCALE / len(codes)) + self.bias
        k = int(np.argmax(value[: len(self.families)])) if len(self.families) > 1 else 0
        members = [x for x in self.langs if family(x) == self.families[k]]
        sure = _sigmoid(2 * value[k]) if len(self.families) > 1 else 1.0
        if len(members) == 1:
            return members[0], sure
        votes, least = dict.fromkeys(members, 0.0), dict.fromkeys(members, np.inf)
        for j, (x, y) in enumerate(self.pairs):
            if x in votes:
                m = value[len(self.families) + j]
                votes[x if m >= 0 else y] += 1
                least[x], least[y] = min(least[x], m), min(least[y], -m)
        best = max(members, key=lambda x: (votes[x], least[x]))
        return best, sure * _sigmoid(2 * float(least[best]))


def _sigmoid(m: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(m, -35, 35))))


def fit(samples: Iterable[tuple[str, str]], cost: float = 10.0) -> Model:
    """A model from (text, language) pairs; texts without a letter are passed over. Without samples it knows none."""
    found = [(features(text), lang) for text, lang in samples if has_letter(text)]
    langs = sorted({lang for _, lang in found})
    families = sorted({family(x) for x in langs})
    pairs = [p for f in families for p in combinations([x for x in langs if family(x) == f], 2)]
    width = 1 << BITS
    columns = []

    def machine(rows: list, labels: list) -> np.ndarray:
        y = np.array(labels, float)
        share = np.array([len(y) / (2 * max(1, (y == v).sum())) for v in y])
        return fit_hinge(rows, y, width, cost * share)

    for f in families if len(families) > 1 else []:
        columns.append(machine([x for x, _ in found], [1 if family(lang) == f else -1 for _, lang in found]))
    if len(families) == 1:
        columns.append(np.zeros(width + 1))
    for x, y in pairs:
        own = [(r, 1 if lang == x else -1) for r, lang in found if lang in (x, y)]
        columns.append(machine([r for r, _ in own], [v for _, v in own]))
    w = np.array(columns).T if columns else np.zeros((width + 1, 0))
    return Model(langs, families, pairs, np.ascontiguousarray(w[:-1], np.float32), w[-1])


def sample(docs: DataFrame, per_lang: int = 300, min_chars: int = 40, max_chars: int = 4000) -> list[tuple[str, str]]:
    """At most ``per_lang`` training texts for each language, in the order of a hash of the id: that bounds what the driver
    holds, a few texts for each distinct value of ``lang``. Texts of ``min_chars`` to ``max_chars`` characters are taken
    first, shorter and longer ones only where a language has too few of these, so every language is learnt.

    Rows of a null language or text and those of fold 2 of 4 are never taken. ``docs``: doc_id, text, lang.
    """
    learn = docs.where((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    odd = ~F.length("text").between(min_chars, max_chars)
    rows = learn.select("lang", "text", odd.alias("odd"), F.xxhash64(F.col("doc_id"), F.lit("langid")).alias("o"))
    # about four times as many as needed by hash, so that few rows are sorted; all rows of a rare language or length
    seen = rows.groupBy("lang", "odd").count()
    near = F.pmod("o", F.lit(1 << 20)) * F.col("count") < F.lit(4.0 * per_lang * (1 << 20))
    some = rows.join(F.broadcast(seen), ["lang", "odd"]).where(near)  # two rows for each language
    place = F.row_number().over(W.partitionBy("lang").orderBy("odd", "o", "text"))
    found = some.withColumn("place", place).where(F.col("place") <= per_lang).select("lang", "o", "text").collect()
    return [(r.text, r.lang) for r in sorted(found)]


def predicted(text: Column, model: Model) -> Column:
    """A struct of lang_pred and score; null texts and texts without a letter are ``und`` with score 0."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [model.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; only doc_id (for the fold) and text are read, so other columns may
    have any name. Null and empty texts are ``und`` with score 0. An empty table gives an empty one, repeated rows repeated
    results; a null id is not held out. Very long texts are read in whole; of tied languages the first by name is taken."""
    done = docs.select("doc_id", predicted(F.col("text"), model).alias("_lang"))
    held = fold(F.col("doc_id"), 4) == 2
    return done.select("doc_id", held.alias("held_out"), F.col("_lang.lang_pred").alias("lang_pred"), F.col("_lang.score").alias("score"))
