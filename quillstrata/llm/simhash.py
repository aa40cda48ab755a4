"""SimHash near-duplicates with pivot distance tables.

A fingerprint has 64 bits; two link when they differ in at most ``DISTANCE`` bits. Equal fingerprints are one node, so
copies never meet as pairs. Hamming distances of each node to many reference fingerprints (pivots) are computed once, as
its row of the distance table, and travel with it: by the triangle inequality a pair whose rows differ by more than
DISTANCE in any coordinate can't link and is discarded; survivors are verified on the bits.

Distances of 64-bit fingerprints to a pivot lie within a few units of 32, too close to index by. So the pairs that the
table filters come from an exact cover: of 6 blocks of bits at most 3 hold a differing bit, so two linked fingerprints
agree in some 3 blocks, that is, in one of 20 keys of about 32 bits. A group of equal keys is not expanded to its pairs:
it gives a spanning forest of its links, by breadth-first search that leaves out what it has reached, in the order of
the first pivot's distance. Components of the forests' edges are those of all links.

A group of over HEAVY fingerprints is not searched by the task that meets it but dealt out again by 20 keys each of the
same kind, over the bits that the group's key leaves free; as about 48 bits are fixed then, these groups have at most
2**17 fingerprints, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import join_named, spread, truncate_lineage, words_of

DISTANCE, SHINGLE, SEED = 3, 3, 42
_BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: The blocks of each key: any DISTANCE differing bits leave one of these sets alone.
KEYS = list(combinations(range(len(_BLOCKS)), len(_BLOCKS) - DISTANCE))
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(16)], np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, least significant first."""
    octets = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text: a bit is set if over half of the shingles' hashes have it.

    Shingles are runs of SHINGLE words, repeats included; fewer words make one shingle; no word gives 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return h(b" ".join(words), SEED)
    n, counts = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        run = words[at : at + (1 << 16) + SHINGLE - 1]
        counts += _bits(np.array([h(a + b" " + b + b" " + c, SEED) for a, b, c in zip(run, run[1:], run[2:], strict=False)], np.uint64))
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def simhash(text: Column) -> Column:
    """The fingerprint as a signed 64-bit integer. Null texts count as empty."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64), pa.int64())

    return run(text)


#: A heavier group of one key is dealt out again.
HEAVY = 4096


def pivot_distances(fp: Column) -> list[Column]:
    """The row of the distance table: distances to 8 pivots in the octets of each of two 64-bit integers."""
    packed = []
    for some in (PIVOTS[:8], PIVOTS[8:]):
        number = F.lit(0).cast("bigint")
        for k, pivot in enumerate(some.view(np.int64).tolist()):
            number = number.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(pivot))).cast("bigint"), 8 * k))
        packed.append(number)
    return packed


def table_of(fps: np.ndarray) -> np.ndarray:
    """Rows of the distance table, for fingerprints that come without."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _keys(fp: Column) -> Column:
    """The 20 keys of a fingerprint, each with its number above its 33 bits, as 64-bit integers."""
    out = []
    for number, blocks in enumerate(KEYS):
        key, at = F.lit(0).cast("bigint"), 0
        for start, size in (_BLOCKS[b] for b in blocks):
            part = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << size) - 1).cast("bigint"))
            key, at = key.bitwiseOR(F.shiftleft(part, at)), at + size
        out.append(key.bitwiseOR(F.lit(number << 33).cast("bigint")))
    return F.array(*out)


def _finer(key: int, fps: np.ndarray) -> np.ndarray:
    """20 keys of each fingerprint (a row each) over the bits that ``key`` leaves free, in halves of its free blocks."""
    halves = [h for b, (at, size) in enumerate(_BLOCKS) if b not in KEYS[key >> 33] for h in ((at, size // 2), (at + size // 2, size - size // 2))]
    bits, out = fps.view(np.uint64), np.zeros((len(KEYS), len(fps)), np.uint64)
    for number, chosen in enumerate(KEYS):
        at = 0
        for start, size in (halves[c] for c in chosen):
            out[number] |= (bits >> np.uint64(start) & np.uint64((1 << size) - 1)) << np.uint64(at)
            at += size
        out[number] |= np.uint64(key << 23 | number << 18)
    return out.view(np.int64)


def forest(fps: np.ndarray, distance: int = DISTANCE, table: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions of the ends of a spanning forest of the links among distinct fingerprints. ``table``: their rows of the
    distance table."""
    table = table_of(fps) if table is None else table
    order = np.argsort(table[:, 0], kind="stable")
    table, fps = table[order], fps[order]
    left = np.arange(len(fps))  # not reached yet, in order of the first coordinate
    edges: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = table[left, 0]
            lo, hi = np.searchsorted(near, table[x, 0] - distance, "left"), np.searchsorted(near, table[x, 0] + distance, "right")
            some = left[lo:hi]
            some = some[np.abs(table[some] - table[x]).max(axis=1, initial=0) <= distance]
            some = some[np.bitwise_count(fps[some] ^ fps[x]) <= distance]
            if len(some):
                edges += [(int(order[x]), int(order[y])) for y in some]
                queue += some.tolist()
                left = left[~np.isin(left, some, assume_unique=True)]
    return edges


_COLUMNS = ["key", "fp", "near", "far"]
_FOUND = "key bigint, a bigint, b bigint, near bigint, far bigint"


def _batch(edges: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
    """Rows of _FOUND: edges have no key, rows that are dealt out again no b."""
    none = pa.nulls(len(edges), pa.int64())
    ends = np.sort(edges, axis=1)
    columns = [(none, again[:, 0]), (ends[:, 0], again[:, 1]), (ends[:, 1], pa.nulls(len(again), pa.int64())), (none, again[:, 2]), (none, again[:, 3])]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())]) for x, y in columns], names=["key", "a", "b", "near", "far"])


def _again(rows: np.ndarray) -> np.ndarray:
    """Rows of one key, of _COLUMNS, with 20 finer keys each."""
    return np.concatenate([np.column_stack((finer, rows[:, 1:])) for finer in _finer(int(rows[0, 0]), np.ascontiguousarray(rows[:, 1]))])


_NO_EDGES, _NO_ROWS = np.zeros((0, 2), np.int64), np.zeros((0, 4), np.int64)


def _groups(rows: np.ndarray, heavy: int | None) -> pa.RecordBatch:
    """The whole groups in ``rows`` (of _COLUMNS, sorted by key): edges, or for those of over ``heavy`` rows the rows again."""
    keys, fps = rows[:, 0], rows[:, 1]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(rows)))
    table = np.ascontiguousarray(rows[:, 2:]).view(np.int8)  # 16 distances of at most 64
    # most groups: two fingerprints, taken together
    two = starts[sizes == 2]
    linked = (np.abs(table[two] - table[two + 1]).max(axis=1) <= DISTANCE) & (np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= DISTANCE)
    edges, again = [np.stack((fps[two[linked]], fps[two[linked] + 1]), axis=1)], [_NO_ROWS]
    for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        if heavy is not None and n > heavy:
            again.append(_again(rows[at : at + n]))
        else:
            own = np.ascontiguousarray(fps[at : at + n])
            edges.append(own[np.array(forest(own.view(np.uint64), DISTANCE, table[at : at + n]), np.int64).reshape(-1, 2)])
    return _batch(np.concatenate(edges), np.concatenate(again))


def _searched(heavy: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``_groups`` over batches of rows sorted by key. Of one key at most ``heavy`` rows and a batch are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last key, which may go on
        passing = None  # a heavy key whose rows are dealt out again as they come
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _COLUMNS], axis=1)
            if not len(rows):
                continue
            cut = int(np.searchsorted(rows[:, 0], rows[0, 0], "right"))  # rows of the batch's first key
            if rows[0, 0] == passing:
                yield _batch(_NO_EDGES, _again(rows[:cut]))
                rows = rows[cut:]
            elif held and rows[0, 0] == held[-1][0, 0]:
                held.append(rows[:cut])
                rows = rows[cut:]
                if heavy is not None and sum(map(len, held)) > heavy:
                    passing = held[0][0, 0]
                    yield _batch(_NO_EDGES, _again(np.concatenate(held)))
                    held = []
            if not len(rows):
                continue
            if held:
                yield _groups(np.concatenate(held), heavy)
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left"))
            if last:
                yield _groups(rows[:last], heavy)
            held, passing = [rows[last:]], None
        if held:
            yield _groups(np.concatenate(held), heavy)

    return run


def links(fps: DataFrame) -> DataFrame:
    """Distinct edges (a, b), a < b, that connect the distinct values ``fp`` just as all links between them do."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near, far = pivot_distances(F.col("fp"))
    keyed = fps.select("fp", near.alias("near"), far.alias("far"), F.explode(_keys(F.col("fp"))).alias("key"))

    def search(rows: DataFrame, heavy: int | None) -> DataFrame:
        return rows.repartition(parts, "key").sortWithinPartitions("key").select(*_COLUMNS).mapInArrow(_searched(heavy), _FOUND)

    found = truncate_lineage(search(keyed, HEAVY))
    again = search(found.where("b IS NULL").select("key", F.col("a").alias("fp"), "near", "far"), None)
    return found.where("b IS NOT NULL").select("a", "b").unionByName(again.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, least) for each node of an edge but the least ones themselves: the least node that it is connected to.

    Alternates the large-star and small-star steps (Kiveris et al., SoCC 2014) on edges a < b until no edge changes; each
    round is cut from its past by a checkpoint. Stars are joins on the node, so no neighbourhood is collected.
    """
    edges = truncate_lineage(edges.select("a", "b"))
    before = None
    while True:  # the steps settle after some log(n)**2 rounds at most, however long a chain is
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))  # a: node, b: neighbour
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b")
        large = large.distinct()
        # small star: each node hands its lower neighbours, and itself, to the least of them
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").select(F.col("m"), F.col("a"), F.col("b"))
        stars = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        edges = truncate_lineage(stars)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = edges.groupBy("b").agg(F.min("a").alias("least")).select(F.col("b").alias("node"), "least")
    return ends


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for each row; only doc_id and text are read, so other columns may have any name.

    Null texts count as empty; texts without a word have fingerprint 0 and are linked like any others. The component's
    id is the smallest doc_id reachable over links, null only if all of its ids are null. Repeated rows give repeated
    results; very long texts are read in whole; an empty table gives an empty one.
    """
    marked = truncate_lineage(spread(docs.select("doc_id", "text")).select("doc_id", simhash(F.col("text")).alias("fp")))
    nodes = truncate_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    found = components(links(nodes.select("fp")))
    placed = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", "copies", F.coalesce("least", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = truncate_lineage(placed.join(least, "root").select("fp", "copies", "component_id"))
    return join_named(marked, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, members: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns as they are, of each class: that of the smallest id (null ids come last), then of
    the smallest hash of the text. ``members``: doc_id, _h (``text_hash``) and root (the class) of each row of ``docs``.

    Rows that repeat the chosen one in id and text are one row as well. An empty table gives an empty one.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_h").alias("h"))
    chosen = members.groupBy("root").agg(F.min(key).alias("k"))
    copies = members.groupBy("doc_id", "_h").count()
    same = F.col("doc_id").eqNullSafe(F.col("k.id")) & (F.col("_h") == F.col("k.h"))
    chosen = truncate_lineage(chosen.join(copies, same).select(F.col("k.id").alias("_id"), F.col("k.h").alias("_hash"), (F.col("count") > 1).alias("_many")))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("doc_id").alias("_doc_id"), text_hash(F.col("text")).alias("_h"))

    def those(many: bool) -> DataFrame:
        few = chosen.where(F.col("_many") == many)
        return own.join(few, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left_semi")

    repeated = those(True).dropDuplicates(["_doc_id", "_h"])
    return those(False).unionByName(repeated).select("_doc.*")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))
