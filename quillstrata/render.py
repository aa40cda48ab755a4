"""Results as text or JSON. Rows are few: each function takes rows that a search has limited."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

# Fields of each report's JSON, in order.
FIELDS = {
    "hybrid": ("symbol_name", "signature", "parent_context", "file", "repo", "start_line", "end_line", "chunk_type", "language", "match_type", "rerank_score", "rrf_score", "sources", "text"),
    "semantic": ("symbol_name", "signature", "file", "repo", "start_line", "end_line", "score", "text"),
    "symbol": ("symbol_name", "signature", "file", "repo", "start_line", "end_line", "chunk_type"),
    "keyword": ("repo", "file", "line", "text"),
    "symbols": ("symbol_name", "chunk_type", "file", "repo", "line", "signature", "language"),
}
_SCORES = ("rerank_score", "rrf_score", "score")


def _dict(row: Any) -> dict:
    d = dict(row) if isinstance(row, Mapping) else row.asDict(recursive=True)
    d.setdefault("line", d.get("start_line"))
    parent = d.get("parent_symbol") or ""
    d["parent_context"] = f"{parent}: {d.get('parent_signature') or ''}" if parent else ""
    return d


def as_json(kind: str, rows: Iterable[Any], query: str | None = None) -> str:
    out = []
    for d in map(_dict, rows):
        values = {k: d.get(k) for k in FIELDS[kind]}
        for k in _SCORES:
            if k in values:
                values[k] = round(values[k], 4) if values[k] is not None else None
        if kind == "hybrid" and not d.get("reranked", bool(d.get("rerank_score"))):
            values["rerank_score"] = None
        out.append(values)
    if kind == "symbols":
        return json.dumps({"query": query or "", "symbols": out}, indent=2)
    return json.dumps({"query": query, "mode": kind, "results": out}, indent=2)


def _preview(text: str, size: int) -> str:
    return text.replace("\n", " ")[:size] + ("..." if len(text) > size else "")


def as_text(kind: str, rows: Iterable[Any]) -> str:
    out: list[str] = []
    for n, d in enumerate(map(_dict, rows), 1):
        at = f"{d['repo']}/{d['file']}"
        if kind == "keyword":
            out.append(f"[{n}] {at}:{d['line']}  {d['text'][:120]}{'...' if len(d['text']) > 120 else ''}")
        elif kind == "symbol":
            out.append(f"[{n}] {at}:{d['start_line']}  {d['symbol_name']}")
            out += [f"    {d['signature']}"] if d["signature"] else []
        elif kind == "symbols":
            out.append(f"  {d['symbol_name']:<40} {d['chunk_type']:<10} {at}:{d['line']}")
            out += [f"    {d['signature'][:80]}"] if d["signature"] and d["signature"] != d["symbol_name"] else []
        else:
            if kind == "hybrid":
                score = f"rerank: {d['rerank_score']:.2f}" if d.get("rerank_score") else f"rrf: {d['rrf_score']:.4f}"
                note = f"({score}, via: {'+'.join(d['sources'])})"
            else:
                note = f"(score: {d['score']:.4f})"
            out.append(f"[{n}] {at}:{d['start_line']}-{d['end_line']}  {note}")
            out += [f"    {d['signature'] or d['symbol_name']}"] if d["symbol_name"] else []
            out += [f"    in: {d['parent_signature']}"] if kind == "hybrid" and d.get("parent_symbol") else []
            out += [f"    {_preview(d['text'], 200)}", ""]
    return "\n".join(out)


def repo_map(rows: Iterable[Any], fmt: str = "text") -> str:
    """Of ``structure.repo_map``. The text shows up to 20 classes of 5 methods and 30 functions of each repo."""
    repos = [r.asDict(recursive=True) if hasattr(r, "asDict") else dict(r) for r in rows]
    if fmt == "json":
        shaped = [
            {
                "name": r["name"], "files": r["files"], "languages": r["languages"],
                "classes": [{k: c[k] for k in ("name", "file", "line", "methods")} for c in r["classes"]],
                "functions": [{k: f[k] for k in ("name", "file", "line", "signature")} for f in r["functions"]],
            }
            for r in repos
        ]
        return json.dumps({"repos": shaped}, indent=2)
    out: list[str] = []
    for r in repos:
        languages = sorted(r["languages"].items(), key=lambda x: (-x[1], x[0]))
        out += [f"\n{r['name']}  ({r['files']} files)", "  Languages: " + ", ".join(f"{k}: {v}" for k, v in languages)]
        if r["classes"]:
            out.append(f"  Classes ({len(r['classes'])}):")
        for c in r["classes"][:20]:
            out.append(f"    {c['name']:<30} {c['file']}:{c['line']}")
            more = len(c["methods"]) - 5
            if c["methods"]:
                out.append("      methods: " + ", ".join(c["methods"][:5]) + (f", ... (+{more})" if more > 0 else ""))
        if r["functions"]:
            out.append(f"  Functions ({len(r['functions'])}):")
        out += [f"    {(f['signature'][:60] or f['name']):<60} {f['file']}:{f['line']}" for f in r["functions"][:30]]
    return "\n".join(out)


_MARKS = {"added": "+", "removed": "-"}


def timeline(found: dict, fmt: str = "text") -> str:
    """``found``: query, scoped_files, scoped_symbols and entries, each with its changes."""
    if fmt == "json":
        return json.dumps(found, indent=2)
    out = [f'\nTimeline for "{found["query"]}" ({len(found["scoped_files"])} files, {len(found["entries"])} commits)\n']
    for e in found["entries"]:
        out.append(f"  {e['date'][:10]}  {e['sha'][:7]}  {e['author']}  {e['message']}")
        out += [f"    {e['repo']}/{e['file']}"] if e["file"] else []
        for c in e["changes"]:
            out.append(f"      {_MARKS.get(c['change_type'], '~')} {c['symbol']} ({c['change_type']}, {c['significance']})")
            if c["change_type"] == "signature_changed":
                out += [f"        was: {c['old_signature']}", f"        now: {c['new_signature']}"]
        out.append("")
    return "\n".join(out)


def numbered(lines: list[str], first: int = 1) -> str:
    return "\n".join(f"{n:>4}  {line}" for n, line in enumerate(lines, first))
