"""Top-level definitions of Python files.

``ast`` gives exact spans. A file with a syntax error is cut by indentation instead, so that its sound parts survive.
"""

from __future__ import annotations

import ast
import re
import warnings

from quillstrata.parsers.base import Chunk, Lines, piece, preambles, within

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_HEAD = re.compile(r"(?:async\s+)?(def|class)\s+(\w+)")


def _span(node: ast.stmt, starts: list[int], rows: list[bytes]) -> tuple[int, int]:
    """Character offsets of a definition, its decorators included. ``ast`` counts columns in UTF-8 bytes."""

    def offset(line: int, column: int) -> int:
        return starts[line - 1] + len(rows[line - 1][:column].decode("utf-8", "replace"))

    first = min((d.lineno for d in node.decorator_list), default=node.lineno)
    start = starts[first - 1] + len(rows[first - 1]) - len(rows[first - 1].lstrip()) if first != node.lineno else offset(node.lineno, node.col_offset)
    return start, offset(node.end_lineno, node.end_col_offset)


def chunk_python(text: str, max_chars: int) -> list[Chunk]:
    """Functions and classes of the top level, then the rest as preamble. Longer classes are split into methods."""
    lines = Lines(text)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_indentation(text, lines, max_chars)
    rows, starts, at = [], [], 0
    for row in re.split(r"(\r\n|\n|\r)", text):  # as ast counts lines
        if row in ("\r\n", "\n", "\r"):
            at += len(row)
        else:
            rows.append(row.encode("utf-8", "surrogatepass"))
            starts.append(at)
            at += len(row)
    found: list[Chunk] = []
    spans: list[tuple[int, int]] = []
    for node in tree.body:
        if not isinstance(node, _DEFS):
            continue
        span = _span(node, starts, rows)
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        own = piece(text, span, kind, node.name, "python", lines)
        spans.append(span)
        if kind == "class" and len(own.text) > max_chars:
            members = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) or (isinstance(m, ast.ClassDef) and m.decorator_list)]
            parts = [piece(text, _span(m, starts, rows), "class" if isinstance(m, ast.ClassDef) else "function", m.name, "python", lines) for m in members]
            found += within(own, parts)
        else:
            found.append(own)
    return found + preambles(text, spans, "python", lines, max_chars)


def _by_indentation(text: str, lines: Lines, max_chars: int) -> list[Chunk]:
    """Blocks that begin with an unindented decorator or header and end before the next unindented line."""
    found: list[Chunk] = []
    spans: list[tuple[int, int]] = []
    open_at: int | None = None  # where the block began
    head: re.Match[str] | None = None
    end = at = 0

    def close() -> None:
        nonlocal open_at, head
        if open_at is not None and head is not None:
            span = (open_at, open_at + len(text[open_at:end].rstrip()))
            found.append(piece(text, span, "class" if head[1] == "class" else "function", head[2], "python", lines))
            spans.append(span)
        open_at = head = None

    for line in text.splitlines(keepends=True):
        flat = line[:1] not in (" ", "\t", "\n", "\r", ")", "]", "}", "#")
        if flat:
            header = _HEAD.match(line)
            if open_at is not None and (head is not None or not (header or line.startswith("@"))):
                close()
            if header:
                open_at, head = (at if open_at is None else open_at), header
            elif line.startswith("@") and open_at is None:
                open_at = at
        at += len(line)
        if line.strip() and (line[:1] != "#" or open_at is None):
            end = at
    close()
    return found + preambles(text, spans, "python", lines, max_chars)
