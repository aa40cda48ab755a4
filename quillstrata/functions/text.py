"""Column functions over text, names and scores. All of them are built from Spark's own, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstrata.parsers import LANGUAGES

#: What ends a line besides CR LF.
_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"


def kept_lines(text: Column) -> Column:
    """Lines with their ends; a text that ends in a line end has no empty line after it."""
    return F.regexp_extract_all(text, F.lit(rf"[^{_BREAKS}]*(?:\r\n|[{_BREAKS}])|[^{_BREAKS}]+"), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without their ends."""
    return F.transform(kept_lines(text), lambda x: F.regexp_replace(x, rf"(?:\r\n|[{_BREAKS}])\z", ""))


def fed_lines(text: Column) -> Column:
    """What lies between line feeds, as SQL cuts texts: no other character ends a line, and an empty text is one empty line.
    A text that ends in a line feed has no empty line after it."""
    parts = F.split(text, "\n", -1)
    return F.when(text.endswith("\n"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_slice(text: Column, first: int, last: int | None = None, cut: Callable[[Column], Column] = lines) -> Column:
    """Lines ``first`` to ``last`` (both from 1 and included), joined; without ``last`` that line and the 50 after it."""
    count = (first + 50 if last is None else last) - max(1, first) + 1
    return F.array_join(F.slice(cut(text), max(1, first), max(0, count)), "\n")


def signature(text: Column) -> Column:
    """The first line; beyond 200 characters cut and marked with three dots."""
    first = F.rtrim(F.regexp_replace(F.substring_index(text, "\n", 1), r"\s+\z", ""))
    return F.when(F.length(first) > 200, F.concat(F.substring(first, 1, 200), F.lit("..."))).otherwise(first)


def preview(text: Column, size: int = 200) -> Column:
    """One line of up to ``size`` characters, marked with three dots if there is more."""
    return F.concat(F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, size), F.when(F.length(text) > size, "...").otherwise(""))


def extension_of(path: Column) -> Column:
    """The lower-cased extension with its dot, '' if there is none. A leading dot is part of the name."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)\z", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_name(extension: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, extension), F.regexp_replace(extension, r"\A\.+", ""))


def chunk_id(repo: Column, file: Column, symbol_name: Column, chunk_type: Column, chunk_index: Column) -> Column:
    """16 hex digits over repo, file, the symbol (or else the type) and the place in the file."""
    what = F.when(symbol_name != "", symbol_name).otherwise(chunk_type)
    return F.substring(F.sha2(F.concat_ws(":", repo, file, what, chunk_index.cast("string")), 256), 1, 16)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")  # compiled, unlike a filter by a lambda


def query_class(query: Column) -> Column:
    """identifier, mixed or natural_language, by how much the words look like names in code."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda t: t != "")

    def like(t: Column, pascal: str) -> Column:
        return t.rlike("[a-z][A-Z]") | t.contains("_") | t.contains(".") | t.rlike(pascal)

    one = F.try_element_at(words, F.lit(1))
    single = like(one, "^[A-Z][a-z]") | one.rlike(r"^\p{Lu}{2,}$")
    return (
        F.when((F.size(words) == 1) & single, "identifier")
        .when((F.size(words) != 1) & F.exists(words, lambda t: like(t, "^[A-Z][a-z].")), "mixed")
        .otherwise("natural_language")
    )


def distance_score(distance: Column) -> Column:
    """1 / (1 + distance); rows without a distance score 1."""
    return 1.0 / (1.0 + F.coalesce(distance, F.lit(0.0)))


def match_type(sources: Column) -> Column:
    return F.when(F.size(sources) > 1, "combined").when(F.size(sources) == 1, F.get(sources, F.lit(0))).otherwise("")


def parent_context(symbol: Column, sig: Column) -> Column:
    return F.when(symbol != "", F.concat_ws(": ", symbol, sig)).otherwise("")


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def short_date(date: Column) -> Column:
    return F.substring(date, 1, 10)


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)
