"""Overlapping windows of lines, for text that no parser knows."""

from __future__ import annotations

from quillstrata.parsers.base import Chunk


def windows(blank: list[bool], size: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open line ranges of up to ``size`` lines (one more where a blank line follows), each starting ``overlap``
    lines before the end of the one before. A window ends after the last blank line of its second half, if there is one."""
    n = len(blank)
    if n <= size:
        return [(0, n)] if n else []
    out = []
    start = 0
    while True:
        end = min(start + size, n)
        if end < n:
            end = next((i + 1 for i in range(end, start + size // 2, -1) if blank[i]), end)
        out.append((start, end))
        if end >= n:
            return out
        start = max(end - overlap, start + 1)


def chunk_lines(text: str, language: str, size: int = 80, overlap: int = 20) -> list[Chunk]:
    """A text of up to ``size`` lines is one chunk, unchanged; windows of a longer one lose white space at their end, and
    blank ones go."""
    lines = text.splitlines(keepends=True)
    if len(lines) <= size:
        return [Chunk(text, "fallback", "", "", 1, len(lines), language)] if lines else []
    found = []
    for start, end in windows([not line.strip() for line in lines], size, overlap):
        part = "".join(lines[start:end]).rstrip()
        if part:
            found.append(Chunk(part, "fallback", "", "", start + 1, end, language))
    return found
