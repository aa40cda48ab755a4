"""Top-level definitions of JavaScript, TypeScript, Go, Java and Swift.

Strings and comments are blanked first, position by position. What remains is cut into statements by brackets, semicolons
and line ends, and each statement is told by its header.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from quillstrata.parsers.base import Chunk, Lines, piece, preambles, within

_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_QUOTED = {
    '"""': re.compile(r'"""(?:\\.|[^\\])*?(?:"""|\Z)', re.S),
    '"': re.compile(r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)'),
    "'": re.compile(r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"),
    "`": re.compile(r"`[^`]*(?:`|\Z)"),
}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


def _template_end(text: str, at: int) -> int:
    """The end of a template literal that starts at ``at``; its placeholders may hold other literals."""
    at += 1
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                c = text[at]
                if c == "`":
                    at = _template_end(text, at)
                    continue
                if c in "\"'":
                    m = _QUOTED[c].match(text, at)
                    at = max(at + 1, m.end()) if m else at + 1
                    continue
                depth += (c == "{") - (c == "}")
                at += 1
        else:
            at += 1
    return len(text)


def masked(text: str, language: str) -> str:
    """The text with the insides of strings, comments and regular expressions as spaces; line feeds stay."""
    script = language in ("javascript", "typescript")
    out: list[str] = []
    done = at = 0

    def blank(end: int, keep: int) -> None:
        nonlocal done, at
        out.append(text[done : at + keep])
        out.append(re.sub(r"[^\n]", " ", text[at + keep : end - keep]))
        done, at = max(at + keep, end - keep), end

    interesting = re.compile(r"[\"'`/]")
    while m := interesting.search(text, at):
        at = m.start()
        c = text[at]
        if c == "/":
            if note := _COMMENT.match(text, at):
                blank(note.end(), 0)
            elif script and re.search(r"(?:^|[(,=:\[!&|?{};\n]|\breturn)\s*\Z", text[max(0, at - 40) : at]) and (rx := _REGEX.match(text, at)):
                blank(rx.end(), 1)
            else:
                at += 1
        elif c == "`" and script:
            blank(_template_end(text, at), 1)
        elif c == "`" and language != "go":
            at += 1
        elif c == "'" and language == "swift":
            at += 1
        else:
            long = c == '"' and language in ("java", "swift") and text.startswith('"""', at)
            q = _QUOTED['"""' if long else c].match(text, at)
            blank(max(at + 1, q.end()), 1) if q.end() - at >= 2 else blank(at + 1, 0)
    out.append(text[done:])
    return "".join(out)


_MORE_BEFORE = re.compile(r"(?:[=+\-*%&|^<>?:,.(\[{!~]|\b(?:extends|implements|throws|where|return|async|default|const|export|public|private|static|in|of))\s*\Z")
_MORE_AFTER = re.compile(r"\s*(?:\{|\.(?!\.)|[=?:,)&|+*%^<>]|->|\b(?:extends|implements|throws|where|else|catch|finally|as|satisfies|instanceof)\b)")
_AFTER_BLOCK = re.compile(r"[ \t]*(?:[;.,)(=?:&|+\-*/\[>]|\b(?:as|satisfies|instanceof)\b)|\s*\b(?:else|catch|finally)\b|\s*(?:=>|\.\w)")


def statements(code: str, start: int, end: int, line_ends: bool) -> Iterator[tuple[int, int]]:
    """Spans of the statements of code[start:end]. ``line_ends``: a line end closes a statement that is complete."""
    depth, first = 0, -1
    at = start
    while at < end:
        c = code[at]
        if first < 0:
            if c in " \t\r\n;":
                at += 1
                continue
            first = at
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
            if c == "}" and depth == 0 and not _AFTER_BLOCK.match(code, at + 1, end):
                yield first, at + 1
                first = -1
        elif c == ";" and depth == 0:
            yield first, at + 1
            first = -1
        elif c == "\n" and depth == 0 and line_ends and not _MORE_BEFORE.search(code, max(first, at - 40), at) and not _MORE_AFTER.match(code, at + 1, end):
            if code[first] != "@" or "\n" in code[first:at].strip() or re.search(r"\b(?:class|func|function|struct|enum|protocol|interface)\b", code[first:at]):
                yield first, at
                first = -1
        at += 1
    if first >= 0 and code[first:end].strip():
        yield first, first + len(code[first:end].rstrip())


_N = r"([A-Za-z_$][\w$]*)"
_NOTES = r"(?:@[\w.]+(?:\([^)]*\))?\s*)*"
_JAVA = rf"{_NOTES}(?:(?:public|private|protected|abstract|final|static|sealed|non-sealed|strictfp|{_NOTES[:-1]})\s+)*"
_SWIFT = r"(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|fileprivate|internal|open|final|static|class|mutating|override|indirect|required|convenience|lazy|weak|nonisolated)(?:\(set\))?\s+)*?"
_FN_VALUE = r"(?:async\s*)?(?:function\b|\([^;]*?\)\s*(?::[^=;{]+)?=>|[\w$]+\s*=>)"
_EXPORT = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?"

#: language: (header, kind). The header's group is the name.
_HEADS: dict[str, list[tuple[re.Pattern[str], str]]] = {
    "javascript": [
        (re.compile(rf"{_EXPORT}(?:abstract\s+)?class\b(?:\s+(?!extends\b){_N})?"), "class"),
        (re.compile(rf"{_EXPORT}(?:async\s+)?function\b\s*\*?\s*{_N}?"), "function"),
        (re.compile(rf"(?:export\s+)?(?:const|let)\s+{_N}\s*(?::[^=]+(?:=>[^=]+)?)?=\s*{_FN_VALUE}"), "function"),
        (re.compile(rf"export\s+default\s+{_FN_VALUE}()"), "function"),
    ],
    "go": [(re.compile(rf"func\s+{_N}\s*[(\[]"), "function"), (re.compile(rf"type\s+{_N}"), "class"), (re.compile(r"type\s*\(()"), "class")],
    "java": [(re.compile(rf"{_JAVA}(?:class|interface|enum|record|@interface)\s+{_N}"), "class")],
    "swift": [
        (re.compile(rf"{_SWIFT}func\s+([\w$]+|[^\s\w(]+)"), "function"),
        (re.compile(rf"{_SWIFT}(?:class|struct|enum|extension|actor|protocol)\s+([A-Za-z_][\w.]*)"), "class"),
    ],
}
_HEADS["typescript"] = [
    *_HEADS["javascript"],
    (re.compile(rf"{_EXPORT}interface\s+{_N}"), "class"),
    (re.compile(rf"{_EXPORT}type\s+{_N}\s*(?:<[^=]*>)?\s*="), "class"),
    (re.compile(rf"{_EXPORT}(?:const\s+)?enum\s+{_N}"), "class"),
]
_GO_METHOD = re.compile(rf"func\s*\(\s*(?:\w+\s+)?\*?\s*([\w.]+)(?:\[[^\]]*\])?\s*\)\s*{_N}\s*\(")
_COMMONJS = re.compile(rf"(module\.exports|exports)(?:\.{_N})?\s*=\s*(?:(?:async\s+)?function\b\s*\*?\s*{_N}?|(class)\b(?:\s+(?!extends\b){_N})?|{_FN_VALUE}|(\{{))")

_MODS = r"(?:(?:public|private|protected|static|readonly|abstract|override|async|declare|accessor|get|set)\s+)*"
_MEMBERS: dict[str, list[tuple[re.Pattern[str], str]]] = {
    "javascript": [(re.compile(rf"{_NOTES}{_MODS}\*?\s*#?{_N}\s*\([^;]*?\)\s*\{{", re.S), "method")],
    "typescript": [
        (re.compile(rf"{_NOTES}{_MODS}\*?\s*#?{_N}\s*(?:<[^(]*>)?\s*\([^;]*?\)\s*(?::[^;{{]+)?\{{", re.S), "method"),
        (re.compile(rf"{_NOTES}{_MODS}#?{_N}\s*[?!]?\s*(?:[:=;]|$)"), "property"),
    ],
    "go": [],
    "java": [
        (re.compile(rf"{_JAVA}(?:(?:synchronized|native|default)\s+)*(?:<[^>]*>\s*)?(?:[\w.<>\[\],?\s]+?\s+)?{_N}\s*\([^;{{]*\)\s*(?:throws\s+[\w.,\s]+)?[{{;]"), "method"),
        (re.compile(rf"{_JAVA}(?:(?:transient|volatile)\s+)*[\w.<>\[\],?\s]+?\s+{_N}\s*(?:\[\s*\])*\s*(?:[=;,]|$)"), "property"),
    ],
    "swift": [(re.compile(rf"{_SWIFT}func\s+([\w$]+|[^\s\w(]+)"), "function"), (re.compile(rf"{_SWIFT}(init|deinit|subscript)\b"), "method")],
}


def _told(code: str, span: tuple[int, int], language: str) -> tuple[str, str] | None:
    """(kind, name) of a statement that defines something."""
    if language == "go" and (m := _GO_METHOD.match(code, *span)):
        return "method", f"{m[1]}.{m[2]}"
    if language in ("javascript", "typescript") and (m := _COMMONJS.match(code, *span)):
        bare = m[1] == "module.exports" and m[2] is None
        if m[1] == "exports" and m[2] is None or (m[6] and not bare):
            return None
        kind = "class" if m[4] else "function"
        return kind, m[2] or m[3] or m[5] or "module.exports"
    for head, kind in _HEADS[language]:
        if m := head.match(code, *span):
            return kind, m[1] or ""
    return None


def chunk_braces(text: str, language: str, max_chars: int) -> list[Chunk]:
    """Definitions of the top level, then the rest as preamble. Longer classes are split into their members."""
    code, lines = masked(text, language), Lines(text)
    line_ends = language != "java"
    found: list[Chunk] = []
    spans: list[tuple[int, int]] = []
    for span in statements(code, 0, len(code), line_ends):
        if (told := _told(code, span, language)) is None:
            continue
        own = piece(text, span, *told, language, lines)
        spans.append(span)
        body = code.find("{", *span)
        if own.chunk_type == "class" and len(own.text) > max_chars and _MEMBERS[language] and body >= 0:
            members = []
            for part in statements(code, body + 1, code.rfind("}", *span), line_ends):
                for head, kind in _MEMBERS[language]:
                    if m := head.match(code, *part):
                        members.append(piece(text, part, kind, m[1], language, lines))
                        break
            found += within(own, members)
        else:
            found.append(own)
    return found + preambles(text, spans, language, lines, max_chars)
