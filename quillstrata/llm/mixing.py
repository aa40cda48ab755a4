"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Targets: the sources share ``share`` times all words by weight; a source stops at ``most`` times its own words and the
excess is shared again by weight (water filling, solved in closed form over the sorted ratios of limit to weight).

Sampling: each document of a source has the same number of expected copies, target / words of the source. Documents are
put in one order within the source, by size class, then by a hash of the id. The prefix sum of expected copies at
position k is k times that number; a document is emitted once for each integer that (offset + prefix sum) crosses. As
documents of like size are neighbours, the words taken differ from the target by less than the largest document, and a
document is emitted at most ceil(target / words) <= ``most`` times.

Texts are read once for narrow rows (id, source, size, hash), which are kept and dealt out by ranges of the order. The
row's own number is the last key of that order, so neither a hot source nor a third of all rows with one id falls to one
task. A position is the row's place in its range and the rows of its source in earlier ranges: sums over a table of one
row for each range and one more for each further source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstrata.llm.common import WORD, truncate_lineage

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
SEED = "mix-42"
#: Rows of the table of ranges up to which it is broadcast, about 100 bytes each; a larger one is joined by shuffle.
FEW_RANGES = 100_000


#: Class of a size: 16 classes for each power of two, by integer arithmetic; sizes under 16 have their own.
SIZE_CLASS = "CASE WHEN size < 16 THEN size ELSE (length(bin(size)) - 1) * 16 + shiftright(size * 16, length(bin(size)) - 1) END"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source of (_source, _null, _words), which may have several rows a source: its words and target.

    The windows here run over the table of sources, with running sums that need no more than a row at a time.
    """
    per = sizes.groupBy("_source", "_null").agg(F.sum("_words").alias("source_size"))
    in_order = W.orderBy("_null", "_source")
    listed = F.array(*(F.lit(float(w)) for w in weights))
    per = per.withColumn("weight", F.element_at(listed, ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")))
    by_ratio = W.orderBy(F.col("source_size") * most / F.col("weight"), "_null", "_source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    total = F.sum("source_size").over(whole) * share
    per = per.withColumn("_limit", F.col("source_size") * most)
    level = (total - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("_level", level).withColumn("_free", F.col("_limit") > F.col("_level") * F.col("weight"))
    reached = F.min(F.when(F.col("_free"), F.struct(F.col("_limit") / F.col("weight"), F.col("_null"), F.col("_source"), F.col("_level")))).over(whole)
    per = per.withColumn("_at", reached["_level"])
    target = F.when(F.col("_at").isNull(), F.col("_limit")).otherwise(F.least("_limit", F.col("_at") * F.col("weight")))
    return per.select("_source", "_null", "source_size", target.alias("target"))


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null, without a list of them: each word becomes one sign, and what is between goes."""
    signs = F.translate(F.regexp_replace(text, WORD, "w"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(signs), F.lit(0)).cast("bigint")


def _copies(rows: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: str) -> DataFrame:
    """``rows`` (doc_id, source, size and others) with source_size, target and copies in place of source."""
    key = ["_null", "_source"]
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumns({"_null": F.col("source").isNull(), "_source": F.coalesce("source", F.lit("")), "_hash": digest, "_class": F.expr(SIZE_CLASS)})
    kept = truncate_lineage(rows.drop("source").withColumn("_row", F.monotonically_increasing_id()))
    order = [*key, "_class", "_hash", "doc_id", "size", "_row"]
    # ids number the rows of a partition without gaps, from its number times 2**33
    dealt = kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = truncate_lineage(dealt.drop("_class", "_hash", "_row"))
    part = F.shiftrightunsigned(F.col("_at"), 33)
    ranges = truncate_lineage(dealt.groupBy(*key, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.sum("size").alias("_words")))
    before = W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n", "_words")
    starts = starts.join(source_targets(ranges, weights, share, most), key)
    if ranges.count() <= FEW_RANGES:
        starts = F.broadcast(starts)
    placed = dealt.withColumn("_part", part).join(starts, [*key, "_part"])
    # the offset: the first 12 hex digits of a hash of the seed, as a fraction
    offset = F.conv(F.substring(F.md5(F.lit(seed)), 1, 12), 16, 10).cast("double") / float(16**12)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    position = F.col("_before") + F.col("_at") - F.col("_first") + 1
    copies = F.floor(offset + rate * position) - F.floor(offset + rate * (position - 1))
    return placed.withColumn("copies", copies.cast("bigint")).drop(*key, "_part", "_at", "_first", "_before")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes) of every row of ``docs``; only doc_id, source and
    text are read, so other columns may have any name.

    Null, empty and blank texts have size 0. A null source is a source of its own, last in order; a source without words
    has target 0 and is never taken. Repeated rows are rows of their own, and ties of the order go by the row's number:
    tied rows are alike in id and size, so the result is the same. Very long texts count as any other. An empty table
    gives an empty one. Reruns agree: order and offset come from hashes.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return _copies(rows, weights, share, most, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``, whatever their names.

    Rows are found again by id and a hash of all their columns. Rows that are equal in all columns are kept once before
    the texts are dealt out, and meet the copies of each of them. Nulls, ties and empty tables as in ``mix_report``.
    """
    alike = [F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    marks = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id"), F.xxhash64(*alike).alias("_like")]
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *marks)
    taken = _copies(rows, weights, share, most, seed).where("copies > 0").select("_id", "_like", "copies")
    texts = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), *marks).dropDuplicates(["_id", "_like"])
    each = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")
    return texts.join(taken, ["_id", "_like"]).select("_doc", each).select("_doc.*")
