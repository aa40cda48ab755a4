"""Ranked full-text search (Robertson and Zaragoza, 2009).

A query needs, of each chunk, its length and how often it has each of the query's terms; so a scan computes just these,
without exploding tokens: nothing but one row of sums and the top rows leaves the executors. ``postings`` is the
materialised form, for many queries over a corpus that is written once, and ``ranked`` answers from it without the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.functions import text as fn

K1, B = 1.2, 0.75
#: Tokens that a task lists and sorts at a time.
RUN = 1 << 20
_WORD = re.compile(r"[^\W_]+")


def terms_of(query: str) -> tuple[list[str], list[list[str]]]:
    """Distinct terms of a query in order, and its quoted phrases as lists of terms."""
    words = _WORD.findall(query.lower())
    phrases = [_WORD.findall(p) for p in re.findall(r'"([^"]*)"', query.lower())]
    return list(dict.fromkeys(words)), [p for p in phrases if p]


def idf(n, df):
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: how many chunks, and their mean length in tokens."""
    return chunks.agg(F.count("*").cast("bigint").alias("n_docs"), F.avg(F.size(fn.tokens(F.col("text")))).alias("avg_len"))


def bm25(chunks: DataFrame, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """``chunks`` that match, with column ``score``. Terms are alternatives; a quoted phrase must occur as it is.

    A blank query matches nothing.
    """
    terms, phrases = terms_of(query)
    if not terms:
        return chunks.withColumn("score", F.lit(0.0)).limit(0)
    toks = F.col("_tokens")
    keep = [c for c in chunks.columns if c != "score"]
    own = [F.size(toks).cast("double").alias("_len")]
    own += [(F.size(toks) - F.size(F.array_remove(toks, w))).cast("double").alias(f"_tf{i}") for i, w in enumerate(terms)]
    sums = [F.count("*").cast("double").alias("_n"), F.avg("_len").alias("_avg")]
    sums += [F.count_if(F.col(f"_tf{i}") > 0).cast("double").alias(f"_df{i}") for i in range(len(terms))]
    stats = chunks.select(fn.tokens(F.col("text")).alias("_tokens")).select(*own).agg(*sums)  # one row: its size does not grow
    # a chunk with a term has it in its text: that is cheap to see, and only such chunks are cut into tokens again
    maybe = F.lit(False)
    for w in terms:
        maybe = maybe | F.lower("text").contains(w)
    counted = chunks.where(maybe).withColumn("_tokens", fn.tokens(F.col("text")))
    joined = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    for words in phrases:
        counted = counted.where(joined.contains(" " + " ".join(words) + " "))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"_tf{i}")
        norm = tf + k1 * (1 - b + b * F.col("_len") / F.col("_avg"))
        score = score + F.when(tf > 0, idf(F.col("_n"), F.col(f"_df{i}")) * tf * (k1 + 1) / norm).otherwise(0.0)
    # every weight is positive, so a chunk without a term scores 0; a test of the counts themselves would be pushed down
    # and make the tokens twice
    scored = counted.select(*keep, *own).crossJoin(F.broadcast(stats)).select(*keep, score.alias("score"))
    return scored.where("score > 0")


def _in_a_row(places: list[Column]) -> Column:
    """Whether a position of the first list is followed by the next one of the second, and so on; a null list has none."""

    def follows(at: Column) -> Column:
        good = F.lit(True)
        for k, own in enumerate(places[1:], 1):
            good = good & F.coalesce(F.array_contains(own, at + k), F.lit(False))
        return good

    return F.exists(F.coalesce(places[0], F.array().cast("array<int>")), follows)


def ranked(found: DataFrame, laid: DataFrame, query: str, n_docs: int, avg_len: float, limit: int | None, k1: float = K1, b: float = B) -> DataFrame:
    """(id, repo, file, start_line, score): the best ``limit`` chunks (None: all) by postings of the query's terms, as ``bm25`` scores
    them; ``laid`` has the chunks by their row. One aggregation by row over these postings, and no text."""
    terms, phrases = terms_of(query)
    one = [F.max_by("positions", F.when(F.col("term") == w, F.lit(1))).alias(f"_p{i}") for i, w in enumerate(terms)]
    rows = found.groupBy("row").agg(*one)
    every = found.groupBy("term").agg(F.count("*").cast("double").alias("n"))
    df = {r.term: r.n for r in every.collect()}  # a row for each term of the query
    for words in phrases:
        rows = rows.where(_in_a_row([F.col(f"_p{terms.index(w)}") for w in words]))
    counted = rows.select("row", *(F.size(f"_p{i}").cast("double").alias(f"_tf{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        tf = F.col(f"_tf{i}")
        norm = tf + k1 * (1 - b + b * F.col("len").cast("double") / avg_len)
        score = score + F.when(tf > 0, idf(F.lit(float(n_docs)), F.lit(df.get(w, 0.0))) * tf * (k1 + 1) / norm).otherwise(0.0)
    scored = counted.join(laid, "row").select("id", "repo", "file", "start_line", score.alias("score"))
    return scored if limit is None else scored.orderBy(F.desc(F.round("score", 6)), "repo", "file", "start_line").limit(limit)


def _cut(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows that lie by the columns ``by``, in pieces of about RUN tokens that don't part equal keys, each with a column
    ``_g``: the number of its row's key."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        same = np.ones(n - 1, bool)
        for c in by:
            codes = batch.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            same &= codes[1:] == codes[:-1]
        first = tuple(batch.column(c)[0].as_py() for c in by)
        fresh = np.concatenate(([last is None or first != last], ~same))
        last = tuple(batch.column(c)[n - 1].as_py() for c in by)
        sums = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("_t")), 0).to_numpy(zero_copy_only=False))
        batch = batch.append_column("_g", pa.array(fresh))
        start, before = 0, 0
        for k in np.flatnonzero(fresh):  # where a piece may end
            reached = size + (int(sums[k - 1]) if k else 0) - before
            if reached >= RUN:
                yield from _joined([*held, batch.slice(start, k - start)])
                held, size, start, before = [], 0, int(k), int(sums[k - 1]) if k else 0
        held.append(batch.slice(start))
        size += int(sums[-1]) - before
    yield from _joined(held)


def _joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if sum(b.num_rows for b in held):
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield batch.set_column(batch.num_columns - 1, "_g", pa.array(np.cumsum(batch.column("_g").to_numpy(zero_copy_only=False)) - 1))


def _listed(piece: pa.RecordBatch, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """A piece's postings by term and key: one stable sort of its tokens."""
    lists = piece.column("_t")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    if not len(flat):
        return
    number = piece.column("_g").to_numpy()
    heads = np.flatnonzero(np.diff(number, prepend=-1))  # the first row of each key
    ranks = np.empty(len(flat.dictionary), np.int64)
    order = pc.sort_indices(flat.dictionary).to_numpy()
    ranks[order] = np.arange(len(order))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = ranks[flat.indices.to_numpy()] * len(heads) + np.repeat(number, sizes)
    if len(heads) < len(number):  # rows of one key: their positions are one list
        spots = np.lexsort((at, key))
    else:
        spots = np.argsort(key, kind="stable")
    key, at = key[spots], at[spots].astype(np.int32)
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    ends = np.append(starts[1:], len(key))
    terms, rows = np.divmod(key[starts], len(heads))
    words = flat.dictionary.take(pa.array(order))
    for k in range(0, len(starts), 1 << 15):
        s, e, own = starts[k : k + (1 << 15)], ends[k : k + (1 << 15)], pa.array(heads[rows[k : k + (1 << 15)]])
        offsets = np.append(s, e[-1]) - s[0]
        positions = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(at[s[0] : e[-1]]))
        columns = [words.take(pa.array(terms[k : k + (1 << 15)])), piece.column("id").take(own), pa.array((e - s).astype(np.int32)), positions, pa.array(sizes[heads][rows[k : k + (1 << 15)]].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*columns, *(piece.column(c).take(own) for c in kept)], names=["term", "id", "tf", "positions", "len", *kept])


def postings(chunks: DataFrame, *kept: str) -> DataFrame:
    """(term, id, tf, positions, len) and the columns ``kept``: the inverted index, one row for each term of a chunk.

    Chunks are dealt out by their key and lie in its order; tokens never leave their task. Rows come in runs, each in the
    order of terms and keys."""
    by = ["id", *kept]
    laid = chunks.select(*by, "text").repartition(*by).sortWithinPartitions(*by)
    cut = laid.select(*by, fn.tokens(F.col("text")).alias("_t"))
    types = {f.name: f.dataType.simpleString() for f in cut.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _cut(batches, by):
            yield from _listed(piece, list(kept))

    shape = ["term string", f"id {types['id']}", "tf int", "positions array<int>", "len int", *(f"{c} {types[c]}" for c in kept)]
    return cut.mapInArrow(run, ", ".join(shape))


#: Rows of a stored index: postings (term, row, positions), and for each chunk one without a term (row, len and its key).
INDEX = "term string, row bigint, positions array<int>, len int, id string, repo string, file string, start_line int"


def index_rows(chunks: DataFrame) -> DataFrame:
    """The columns of INDEX: postings by a number that each row of ``chunks`` gets, and the row's key once, under this number.

    Rows are numbered and listed within the task that reads them, so nothing is shuffled, whatever ids there are."""
    key = {"id": pa.string(), "repo": pa.string(), "file": pa.string(), "start_line": pa.int32()}
    cut = chunks.select(F.monotonically_increasing_id().alias("id"), *(F.col(c).alias(f"_{c}") for c in key), fn.tokens(F.col("text")).alias("_t"))
    none = [pa.int32(), *key.values()]
    names = ["term", "row", "positions", "len", *key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _cut(batches, ["id"]):
            n, sizes = piece.num_rows, pc.fill_null(pc.list_value_length(piece.column("_t")), 0).cast(pa.int32())
            own = [pa.nulls(n, pa.string()), piece.column("id"), pa.nulls(n, pa.list_(pa.int32())), sizes, *(piece.column(f"_{c}") for c in key)]
            yield pa.RecordBatch.from_arrays(own, names=names)
            for b in _listed(piece, []):
                yield pa.RecordBatch.from_arrays([b.column("term"), b.column("id"), b.column("positions"), *(pa.nulls(b.num_rows, t) for t in none)], names=names)

    return cut.mapInArrow(run, INDEX)


def phrase_positions(chunks: DataFrame, words: list[str]) -> DataFrame:
    """(id, at) where the words, lower-cased tokens, follow each other: one scan, in which only texts that contain each
    word are cut into tokens, and no positions but those of the phrase are made."""
    for w in words:
        chunks = chunks.where(F.lower("text").contains(w))
    size, wanted = len(words), " ".join(words)

    def starts(toks):  # tokens are bound to a variable: a column could be computed again for each of them
        at = F.transform(toks, lambda t, i: F.when((t == words[0]) & (F.array_join(F.slice(toks, i + 1, size), " ") == wanted), i))
        return F.filter(at, lambda i: i.isNotNull())

    found = F.flatten(F.transform(F.array(fn.tokens(F.col("text"))), lambda toks: starts(toks)))
    return chunks.select("id", F.explode(found).alias("at"))
