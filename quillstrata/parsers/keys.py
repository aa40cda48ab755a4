"""Top-level keys of YAML and JSON files."""

from __future__ import annotations

import json
import re

from quillstrata.parsers.base import Chunk, Lines, piece

_KEY = re.compile(r"(?:\"((?:\\.|[^\"\\])*)\"|'((?:''|[^'])*)'|([^\s#\-\[\]{}&*!|>'\"%@`,?:][^\n#]*?|-[^\s][^\n#]*?))\s*:(?=\s|$)")
_STRING = re.compile(r'"(?:\\.|[^"\\])*"')


def chunk_yaml(text: str) -> list[Chunk]:
    """One block for each key in the first column, down to the last line before the next that isn't blank or a comment."""
    lines, found = Lines(text), []
    key: str | None = None
    start = end = at = 0
    for line in text.splitlines(keepends=True):
        m = _KEY.match(line)
        if m or line.startswith(("---", "...")):
            if key is not None:
                found.append((start, end, key))
            key = (m[0][: m[0].rindex(":")].strip() if m else None) if m else None
            start = at
        at += len(line)
        if line.strip() and not line.startswith("#"):
            end = at - len(line) + len(line.rstrip())
    if key is not None:
        found.append((start, end, key))
    return [_block(text, (a, b), k, "yaml", lines) for a, b, k in found]


def _block(text: str, span: tuple[int, int], key: str, language: str, lines: Lines) -> Chunk:
    own = piece(text, span, "config_block", key, language, lines)
    return Chunk(own.text, own.chunk_type, key, own.text.partition("\n")[0].rstrip(), own.start_line, own.end_line, language)


def chunk_json(text: str) -> list[Chunk]:
    """One block for each pair of the root object. Text that isn't JSON gives what pairs it begins with."""
    lines, found = Lines(text), []
    at = len(text) - len(text.lstrip())
    if text[at : at + 1] != "{":
        return []
    at += 1
    decoder = json.JSONDecoder(strict=False)
    while m := _STRING.search(text, at):
        if text[at : m.start()].strip(" \t\r\n,"):
            break
        colon = re.compile(r"\s*:\s*").match(text, m.end())
        if not colon:
            break
        try:
            _, at = decoder.raw_decode(text, colon.end())
        except (ValueError, RecursionError):
            break
        found.append(_block(text, (m.start(), at), m[0].strip('"'), "json", lines))
    return found
