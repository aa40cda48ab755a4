"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Fingerprints of such a pair may differ in far more bits than any exact cover of 64 bits serves, so candidates agree in a
band of minimum hashes. Within a band's group the pivot tables and the bits of the SimHash, at a wide distance, discard;
what is left gives coarse components. Every link lies in one of them, so each text is read once more, with its component,
and links are verified there by exact Jaccard.

A component is verified in blocks of about BLOCK shingles, so no task holds more, however many copies there are. Classes of
different blocks are then joined by links that cross them: first by one candidate for each two classes, as long as that
joins any, and at last by all candidates of bands that still hold more than one class. In a cluster of copies few are left
by then. Pairs within a class are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm import simhash
from quillstrata.llm.common import join_named, spread, truncate_lineage, words_of

SHINGLE = 5
#: The similarity, as a fraction.
NUM, DEN = 4, 5
#: At similarity 0.8 bits differ with probability 0.15: more than 24 of 64 do in about one pair of a million.
DISTANCE = 24
#: A pair of similarity s shares a band but with probability (1 - s**ROWS) ** BANDS: 5e-6 at 0.8.
ROWS, BANDS = 6, 40
#: Shingles that one task verifies together, about 16 MB of hashes.
BLOCK = 1 << 21
_RANDOM = np.random.default_rng(simhash.SEED)
_FLIP = _RANDOM.integers(0, 1 << 64, ROWS * BANDS, np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 64, ROWS * BANDS, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; fewer words make one shingle, no word an empty one."""
    words = [w.lower() for w in words_of(text)]
    runs = [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    return np.unique(np.array([xxhash.xxh64_intdigest(r, simhash.SEED) for r in runs], np.uint64))


def bits(hashes: np.ndarray) -> int:
    """The SimHash of a set: a bit is set if over half of the hashes have it."""
    counts = sum(simhash._bits(hashes[i : i + (1 << 16)]) for i in range(0, len(hashes), 1 << 16))
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def bands(hashes: np.ndarray) -> np.ndarray:
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        np.minimum(least, ((hashes[i : i + (1 << 12), None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def sketch(text: Column) -> Column:
    """node (a hash of the set), fp, n (the set's size) and bands of each text; null texts count as empty."""

    @F.arrow_udf("struct<node: bigint, fp: bigint, n: bigint, bands: array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        sets = [shingles(t.as_py()) for t in texts]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) for s in sets], np.uint64).view(np.int64)
        fp = np.array([bits(s) for s in sets], np.uint64).view(np.int64)
        keys = np.array([bands(s) for s in sets], np.uint64).view(np.int64).reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
        return pa.StructArray.from_arrays([pa.array(node), pa.array(fp), pa.array([len(s) for s in sets], pa.int64()), lists], ["node", "fp", "n", "bands"])

    return run(text)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        start = int(np.searchsorted(keys, keys[-1], "left"))
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between nodes of equal keys that may be links, a spanning forest for each key in rows sorted by key.

    A key of over HEAVY nodes is not searched: all of them are tied to its first one as they come. Components only get
    coarser by that, and no more than HEAVY nodes and a batch are held.
    """
    held: list[np.ndarray] = []  # rows of the last key, which may go on
    first = None  # of a heavy key: the key and the node that the others are tied to

    def tied(rows: np.ndarray, node: int) -> pa.RecordBatch:
        others = rows[rows[:, 1] != node, 1]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(others, node)), pa.array(np.maximum(others, node))], names=["a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "fp", "n")], axis=1)
        if not len(rows):
            continue
        cut = int(np.searchsorted(rows[:, 0], rows[0, 0], "right"))  # rows of the batch's first key
        if first is not None and rows[0, 0] == first[0]:
            yield tied(rows[:cut], first[1])
            rows = rows[cut:]
        elif held and rows[0, 0] == held[-1][0, 0]:
            held.append(rows[:cut])
            rows = rows[cut:]
            if sum(map(len, held)) > simhash.HEAVY:
                first = int(held[0][0, 0]), int(held[0][0, 1])
                yield tied(np.concatenate(held), first[1])
                held = []
        if not len(rows):
            continue
        if held:
            yield _searched(np.concatenate(held))
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left"))
        if last:
            yield _searched(rows[:last])
        held, first = [rows[last:]], None
    if held:
        yield _searched(np.concatenate(held))


def _searched(rows: np.ndarray) -> pa.RecordBatch:
    """Edges of the whole groups in rows (key, node, fp, n), sorted by key."""
    key, node, fp, n = (np.ascontiguousarray(c) for c in rows.T)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    two = starts[sizes == 2]
    small, large = np.minimum(n[two], n[two + 1]), np.maximum(n[two], n[two + 1])
    linked = (np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= DISTANCE) & (DEN * small >= NUM * large)
    a, b = [node[two[linked]]], [node[two[linked] + 1]]
    for s, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        found = np.array(simhash.forest(fp[s : s + size].view(np.uint64), DISTANCE), np.int64).reshape(-1, 2) + s
        a.append(node[found[:, 0]])
        b.append(node[found[:, 1]])
    one, other = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], names=["a", "b"])


def classes(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the number of its component over the links, by a search that compares with what is not reached yet."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, sets = sizes[order], [sets[i] for i in order]
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(flat, np.cumsum(sizes)[:-1])
    prints = np.array([bits(s) for s in sets], np.uint64)
    mark, out = np.zeros(len(words), np.int64), np.zeros(len(sets), np.int64)
    left, number = np.arange(len(sets)), -1
    while len(left):
        number += 1
        queue, left = [int(left[0])], left[1:]
        out[queue[0]] = number
        while queue and len(left):
            x = queue.pop()
            near = sizes[left]
            some = left[(DEN * near >= NUM * sizes[x]) & (NUM * near <= DEN * sizes[x])]
            some = some[np.bitwise_count(prints[some] ^ prints[x]) <= DISTANCE]
            mark[ids[x]] = 1
            reached = []
            for i in range(0, len(some), 512):
                part = some[i : i + 512]
                shared = np.add.reduceat(mark[np.concatenate([ids[y] for y in part])], np.append(0, np.cumsum(sizes[part])[:-1]))
                reached += part[(NUM + DEN) * shared >= NUM * (sizes[part] + sizes[x])].tolist()
            mark[ids[x]] = 0
            if reached:
                out[reached] = number
                queue += reached
                left = left[~np.isin(left, reached, assume_unique=True)]
    named = np.zeros(len(sets), np.int64)
    named[order] = out
    return named


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least) of each node of rows (part, node, text): the least node of its class within its part."""
    for table in _runs(batches, "part"):
        part, node = table.column("part").to_numpy(), table.column("node").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        text = table.column("text")
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
            own, at = np.unique(node[s:e], return_index=True)
            number = classes([shingles(text[s + int(i)].as_py()) for i in at])
            least = np.full(number.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, number, own)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(least[number])], names=["node", "least"])


def hashes(text: Column) -> Column:
    """The sorted shingle hashes of each text, as an array of signed integers."""

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        sets = [shingles(t.as_py()).view(np.int64) for t in texts]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))

    return run(text)


def alike(one: Column, other: Column) -> Column:
    """Whether two arrays of shingle hashes are of similarity 0.8."""

    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append((NUM + DEN) * shared >= NUM * (len(x) + len(y)))
        return pa.array(out, pa.bool_())

    return run(one, other)


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b) of different classes in rows (key, asked, node, fp, n, least) sorted by key, asked ones first:
    these are held, and the others stream past them."""
    at, held = None, []
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "asked", "node", "fp", "n", "least")], axis=1)
        starts = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))) if len(rows) else []
        for s, e in zip(starts, [*starts[1:], len(rows)], strict=True):
            part = rows[s:e]
            if part[0, 0] != at:
                at, held = part[0, 0], []
            if part[0, 1] == 0:
                held.append(part)
                continue
            _, _, node, fp, n, least = (np.ascontiguousarray(c) for c in part.T)
            for _, _, x, bits_of, size, own in (row for block in held for row in block.tolist()):
                near = (least != own) & (np.bitwise_count((fp ^ bits_of).view(np.uint64)) <= DISTANCE) & (DEN * np.minimum(n, size) >= NUM * np.maximum(n, size))
                found = node[near]
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(found, x)), pa.array(np.maximum(found, x))], names=["a", "b"])


def crossing_pairs(rows: DataFrame, parts: int) -> DataFrame:
    """Candidate pairs (a, b) of rows (key, node, fp, n, least) of one key and different classes. Of a key, the nodes
    outside of its largest class are asked, HEAVY at a time, against all of it; no pair lies within a class."""
    sizes = rows.groupBy("key", "least").count()
    largest = sizes.groupBy("key").agg(F.max(F.struct("count", "least")).alias("m"), F.sum("count").alias("all"))
    mixed = largest.where(F.col("all") > F.col("m.count")).select("key", F.col("m.least").alias("_most"), F.ceil((F.col("all") - F.col("m.count")) / float(simhash.HEAVY)).alias("_blocks"))
    own = rows.join(mixed, "key").select("node", "fp", "n", "least", "key", "_most", "_blocks")
    block = F.xxhash64("key", F.pmod(F.xxhash64("node"), F.col("_blocks")))
    asked = own.where("least <> _most").select(block.alias("key"), F.lit(0).cast("bigint").alias("asked"), "node", "fp", "n", "least")
    every = own.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    every = every.select(F.xxhash64("key", "_b").alias("key"), F.lit(1).cast("bigint").alias("asked"), "node", "fp", "n", "least")
    dealt = asked.unionByName(every).repartition(parts, "key").sortWithinPartitions("key", "asked")
    return dealt.mapInArrow(_crossing, "a bigint, b bigint").distinct()


def _merged(classes_of: DataFrame, links: DataFrame) -> DataFrame:
    """``classes_of`` (node, least) after its classes are joined along links (a, b) of nodes."""
    ends = _ends(links, classes_of).select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    joined = simhash.components(ends).select(F.col("node").alias("least"), F.col("least").alias("root"))
    return truncate_lineage(classes_of.join(joined, "least", "left").select("node", F.coalesce("root", "least").alias("least")))


def _ends(pairs: DataFrame, classes_of: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with their classes la and lb, where these differ."""
    one = classes_of.select(F.col("node").alias("a"), F.col("least").alias("la"))
    other = classes_of.select(F.col("node").alias("b"), F.col("least").alias("lb"))
    return pairs.join(one, "a").join(other, "b").where("la <> lb")


def across_blocks(classes_of: DataFrame, sets: DataFrame, edges: DataFrame, keyed: DataFrame) -> DataFrame:
    """(node, least) with all classes that a link joins as one. classes_of: node, least by blocks; sets: node, hashes;
    edges: candidates (a, b); keyed: node, fp, n, key for each band of a node."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
        return truncate_lineage(pairs.join(a, "a").join(b, "b").where(alike(F.col("ha"), F.col("hb"))).select("a", "b"))

    while True:
        pairs = _ends(edges, classes_of).groupBy(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")).agg(F.min(F.struct("a", "b")).alias("e"))
        found = verified(pairs.select("e.*"))
        if found.isEmpty():
            break
        classes_of = _merged(classes_of, found)
    pairs = crossing_pairs(truncate_lineage(keyed.join(classes_of, "node")), parts)
    return _merged(classes_of, verified(pairs))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, _h (hash of the text) and root (the class) for each row, over links of similarity 0.8; only doc_id and text
    are read, null texts count as empty, repeated rows give repeated results, an empty table gives an empty one."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text_hash = simhash.text_hash(F.col("text"))
    marked = truncate_lineage(spread(docs.select("doc_id", "text")).select("doc_id", text_hash.alias("_h"), sketch(F.col("text")).alias("k")))
    nodes = marked.groupBy(F.col("k.node").alias("node")).agg(F.min("_h").alias("_h"), F.first("k.n").alias("n"), F.count("*").alias("copies"))
    nodes = truncate_lineage(nodes)
    keyed = marked.select("k.node", "k.fp", "k.n", "k.bands").dropDuplicates(["node"]).select("node", "fp", "n", F.explode("bands").alias("key"))
    dealt = keyed.repartition(parts, "key").sortWithinPartitions("key").select("key", "node", "fp", "n")
    edges = truncate_lineage(dealt.mapInArrow(_candidates, "a bigint, b bigint").distinct())
    coarse = simhash.components(edges)
    placed = coarse.unionByName(coarse.select(F.col("least").alias("node"), "least")).distinct().withColumnRenamed("least", "root")
    asked = truncate_lineage(placed.join(nodes, "node").select("root", "node", "_h", "n"))
    blocks = asked.groupBy("root").agg(F.ceil(F.sum("n") / float(BLOCK)).alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    asked = asked.join(blocks, "root").select("node", "_h", "blocks", F.xxhash64("root", block).alias("part"))
    texts = docs.select(text_hash.alias("_h"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(asked.select("_h"), "_h", "left_semi").dropDuplicates(["_h"]).join(asked, "_h").select("part", "node", "text")
    found = truncate_lineage(texts.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_verified, "node bigint, least bigint"))
    split = asked.where("blocks > 1")
    if not split.isEmpty():
        hot = truncate_lineage(found.join(split.select("node"), "node", "left_semi"))
        own = docs.select(text_hash.alias("_h"), F.coalesce("text", F.lit("")).alias("text"))
        sets = own.join(split.select("_h"), "_h", "left_semi").dropDuplicates(["_h"]).join(split, "_h").select("node", hashes(F.col("text")).alias("hashes"))
        whole = across_blocks(hot, truncate_lineage(sets), edges, keyed)
        found = found.join(split.select("node"), "node", "left_anti").unionByName(whole)
    named = truncate_lineage(nodes.join(found, "node", "left").select("node", "copies", F.coalesce("least", "node").alias("root")))
    return truncate_lineage(join_named(marked.select("doc_id", "_h", F.col("k.node").alias("node")), named, "node").select("doc_id", "_h", "root"))
