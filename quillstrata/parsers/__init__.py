"""Chunkers: from the text of a file to chunks of whole definitions, keys or line windows.

Python is parsed with the standard library; brace languages with a masking scanner (``braces``); YAML and JSON by their
top-level keys; everything else by overlapping line windows.
"""

from __future__ import annotations

from quillstrata.parsers.base import MAX_CHARS, Chunk, cap_sizes
from quillstrata.parsers.braces import chunk_braces
from quillstrata.parsers.keys import chunk_json, chunk_yaml
from quillstrata.parsers.lines import chunk_lines
from quillstrata.parsers.python import chunk_python

# Names of languages by file extension; others are the extension without its dot.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go",
    ".java": "java", ".swift": "swift", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".sh": "shell",
    ".bash": "shell", ".sql": "sql", ".md": "markdown", ".toml": "toml",
}

_BRACES = ("javascript", "typescript", "go", "java", "swift")


def language_of(extension: str) -> str:
    return LANGUAGES.get(extension, extension.lstrip("."))


def chunk_text(text: str, extension: str, max_chars: int = MAX_CHARS, window: int = 80, overlap: int = 20) -> list[Chunk]:
    """Chunks of one file in the order in which they are found; a blank file has none.

    A file whose strategy finds no key falls back to line windows. No chunk is longer than ``max_chars``.
    """
    if not text.strip():
        return []
    language = language_of(extension)
    if language == "python":
        found = chunk_python(text, max_chars)
    elif language in _BRACES:
        found = chunk_braces(text, language, max_chars)
    elif language == "yaml":
        found = chunk_yaml(text)
    elif language == "json":
        found = chunk_json(text)
    else:
        found = []
    return cap_sizes(found or chunk_lines(text, language, window, overlap), max_chars)
