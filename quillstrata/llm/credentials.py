"""Secret scans by multipart credential linking, with DataFrame functions only.

Base spans stand by themselves: assignments of a secret word, access keys and long hexadecimal runs. Weak parts do not:
account or client identifiers, endpoints, and tokens that only look random. They are interval-joined within a scope of
``SCOPE`` code points; a weak part is reported only when a part that complements it starts in the same scope. Base spans
take part as secrets (assignments, hexadecimal runs) or identifiers (access keys).

Positions: ``split`` gives the texts between matches and ``regexp_extract_all`` the matches, so that a running sum of
both lengths gives each start. Sums run over blocks of BLOCK matches and then over the blocks, as a list grows by copying.
Only texts that contain a match are taken apart. No part has an upper bound of length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import truncate_lineage

#: Kinds in the order that breaks ties. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "ident", "endpoint", "token")
BASE = KINDS[:3]

#: kind: (pattern, group of the part that must have ``least`` characters, least)
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    # runs are maximal, so asking for 32 finds the same ones as dropping shorter ones
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "ident": (r"""(?i:(?<![A-Za-z0-9_])(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|key_?id|tenant(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", 0, 0),
    "endpoint": (r"""(?i:(?<![A-Za-z0-9_])(?:https?|wss?|ftps?|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[A-Za-z0-9.:@%_-]{3,}|(?<![A-Za-z0-9_])(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,})""", 0, 0),
    # runs are maximal; TESTS keeps those with a digit, a small and a capital letter
    "token": (r"[A-Za-z0-9+/_=-]{20,}", 0, 0),
}

#: What a match must contain besides.
TESTS = {"token": ("[0-9]", "[A-Z]", "[a-z]")}
BLOCK = 128

#: Code points over which parts of one credential may be spread.
SCOPE = 400

#: What each weak kind needs nearby.
NEEDS = {
    "ident": ("assign", "hex", "token"),
    "endpoint": ("assign", "access", "hex", "token"),
    "token": ("ident", "access", "endpoint"),
}


_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _may_have(text: Column, kind: str) -> Column:
    """A cheap test that every text with a match passes; only such texts meet the kind's pattern."""
    if kind == "access":
        return text.contains("AKIA")
    return text.rlike("[A-Za-z0-9+/_=-]{20}") if kind in ("hex", "token") else text.contains("=") | text.contains(":")


def _has(text: Column, kind: str) -> Column:
    return _may_have(text, kind) & text.rlike(PATTERNS[kind][0])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, merged: Callable[[Column, Column], Column]) -> Column:
    """For each of the whole numbers what ``merged`` (a sum or the greatest) makes of 0 and all earlier ones."""

    def running(some: Column, first: Column) -> Column:
        return F.slice(F.aggregate(some, F.array(first), lambda acc, x: F.concat(acc, F.array(merged(F.element_at(acc, -1), x)))), 1, F.size(some))

    def placed(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), merged))
        return F.flatten(F.zip_with(blocks, running(whole, F.lit(0)), running))

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK))
    return _let(values, lambda own: _let(F.transform(starts, lambda at: F.slice(own, at, BLOCK)), placed))


def spans_of(text: Column, kind: str) -> Column:
    """An array of structs (start, rank of the kind, end), leftmost and non-overlapping, for one kind."""
    pattern, group, least = PATTERNS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def fits(x: Column) -> Column:
        good = F.length(x["v"]) >= least
        for test in TESTS.get(kind, ()):
            good = good & x["m"].rlike(test)
        return good

    def measured(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        zipped = F.arrays_zip(gaps.alias("g"), found.alias("m"), (part if group else found).alias("v"))
        return F.transform(zipped, lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("m"), fits(x).alias("fits")))

    def placed(sizes: Column) -> Column:
        before = _before(F.transform(sizes, lambda x: x["g"] + x["m"]), lambda a, b: a + b)
        spans = F.zip_with(sizes, before, lambda x, at: F.struct((at + x["g"]).alias("start"), (at + x["g"] + x["m"]).alias("end"), x["fits"].alias("fits")))
        rank = F.lit(KINDS.index(kind)).alias("rank")
        return F.transform(F.filter(spans, lambda x: x["fits"]), lambda x: F.struct(x["start"].alias("start"), rank, x["end"].alias("end"))).cast(_SPANS)

    return F.when(_has(text, kind), _let(whole, lambda found: _let(measured(found), placed))).otherwise(F.array().cast(_SPANS))


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, _h, base, spans) for each row: _h is a hash of the text, base and spans are sorted arrays of structs.

    Texts are read once. Parts meet in a left-semi join on (document, bin of SCOPE code points), each complement standing in its own bin and
    in both neighbours; so a bin, not a document, is the unit of work, and no pair of parts is ever a row. Rows of one id and one text are joined
    once.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("_h"), text.alias("text"))
    found = truncate_lineage(
        rows.select("doc_id", "_h", F.concat(*(spans_of(F.col("text"), k) for k in BASE)).alias("base"), F.concat(*(spans_of(F.col("text"), k) for k in KINDS[3:])).alias("weak"))
    )
    some = found.where(F.size("weak") > 0).dropDuplicates(["doc_id", "_h"])
    weak = some.select("doc_id", "_h", F.explode("weak").alias("w")).withColumn("bin", F.floor(F.col("w.start") / SCOPE))
    parts = some.select(F.col("doc_id").alias("p_doc"), F.col("_h").alias("p_h"), F.explode(F.concat("base", "weak")).alias("p"))
    parts = parts.withColumn("p_bin", F.explode(F.array(*(F.floor(F.col("p.start") / SCOPE) + d for d in (-1, 0, 1))))).distinct()
    needs = F.lit(False)
    for kind, others in NEEDS.items():
        needs = needs | ((F.col("w.rank") == KINDS.index(kind)) & F.col("p.rank").isin([KINDS.index(o) for o in others]))
    near = F.abs(F.col("p.start") - F.col("w.start")) <= SCOPE
    same = F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("_h") == F.col("p_h")) & (F.col("bin") == F.col("p_bin"))
    linked = weak.join(parts, same & near & needs, "left_semi")
    linked = linked.groupBy("doc_id", "_h").agg(F.collect_set("w").alias("linked")).select(F.col("doc_id").alias("l_doc"), F.col("_h").alias("l_h"), "linked")
    joined = found.join(linked, F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("_h") == F.col("l_h")), "left")
    spans = F.concat("base", F.coalesce("linked", F.array().cast(_SPANS)))
    return joined.select("doc_id", "_h", F.array_sort("base").alias("base"), F.array_sort(spans).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def _of_rank(rank: int) -> Callable[[Column], Column]:
    return lambda s: s["rank"] == rank  # of one argument: a second one would be the element's index


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base spans), base_sha256 and spans for each row; null texts count as empty.

    Only doc_id and text are read, so other columns may have any name. Repeated rows give repeated results; null ids are
    kept; very long texts are scanned in whole; spans of one start are ordered by kind; an empty table gives an empty one.
    Positions are code points, ends exclusive. A part complements another if they start within SCOPE of each other.
    """
    found = find_spans(docs)
    counts = [F.size(F.filter("base", _of_rank(r))).cast("bigint").alias(f"n_{k}") for r, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


#: Bytes of spans up to which they are broadcast to the texts; more of them, and texts are dealt out by id.
FEW_BYTES = 16 << 20


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, replaced by ``mask``; other columns stay as they are, whatever
    their names, but for n_chars, which follows the text where there is such a column.

    Null texts stay null, empty ones empty. Rows of one id are told apart by a hash of the text, null ids as well; repeated
    rows give repeated results. Very long texts are scanned and rewritten in whole. An empty table gives an empty one.
    """
    marks = [F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h")]
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), "text", *marks)
    spans = find_spans(docs.select("doc_id", "text")).where(F.size("spans") > 0)
    spans = truncate_lineage(spans.select(F.col("doc_id").alias("s_id"), F.col("_h").alias("s_h"), "spans").dropDuplicates(["s_id", "s_h"]))
    if (spans.agg(F.sum(F.size("spans") * 24 + 64)).head()[0] or 0) <= FEW_BYTES:
        spans = F.broadcast(spans)
    hit = own.join(spans, F.col("_id").eqNullSafe(F.col("s_id")) & (F.col("_h") == F.col("s_h")), "left")

    # a span that starts before an earlier one's end is masked with it
    before = _before(F.transform("spans", lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    heads = F.filter(F.zip_with("spans", before, lambda x, end: F.struct(x["start"].alias("start"), end.alias("end"))), lambda x: x["start"] >= x["end"])
    last = F.array_max(F.transform("spans", lambda x: x["end"]))
    text = F.col("text")
    pieces = F.concat(F.transform(heads, lambda x: text.substr(x["end"] + 1, x["start"] - x["end"])), F.array(text.substr(last + 1, F.length("text"))))
    hit = hit.withColumn("_new", F.when(F.col("spans").isNull(), text).otherwise(F.array_join(pieces, mask)))
    changed = {"text": F.col("_new")} | ({"n_chars": F.length("_new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return hit.select(*(changed[c].alias(c) if c in changed else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))
