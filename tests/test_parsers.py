from __future__ import annotations

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstrata.operators import chunking
from quillstrata.parsers import chunk_text, language_of
from quillstrata.parsers.lines import windows


def told(text: str, ext: str, **how) -> list[tuple]:
    return [(c.chunk_type, c.symbol_name, c.start_line, c.end_line) for c in chunk_text(text, ext, **how)]


def test_python_definitions():
    text = 'import os\nimport sys\n\n\ndef add(a, b):\n    return a + b\n\n\n@cache\n@other(1)\nasync def get():\n    pass\n\n\nclass Box:\n    """def not_one(): pass"""\n\n    def size(self):\n        return 1\n'
    assert told(text, ".py") == [("function", "add", 5, 6), ("function", "get", 9, 12), ("class", "Box", 15, 19), ("preamble", "", 1, 5)]
    assert chunk_text(text, ".py")[1].signature == "@cache"


def test_python_only_imports_and_unicode():
    assert told("import os\nfrom a import b\n", ".py") == [("preamble", "", 1, 3)]
    assert told("def größe(ñ):\n    return 'é'; x = 1\n", ".py") == [("function", "größe", 1, 2)]


def test_python_with_a_syntax_error_keeps_the_sound_parts():
    names = [c.symbol_name for c in chunk_text("def one():\n    return 1\n\ndef broken(:\n  x\n\n@d\ndef two(\n    a,\n):\n    return 2\n", ".py")]
    assert "one" in names and "two" in names


def test_long_python_class_is_split():
    body = "".join(f"    @deco\n    def m{i}(self):\n        return '{'x' * 150}'\n\n" for i in range(60))
    chunks = chunk_text(f"@final\nclass Big:\n    y = 1\n\n{body}", ".py")
    names = [c.symbol_name for c in chunks if c.symbol_name]
    assert names == ["Big", *(f"Big.m{i}" for i in range(60))]
    assert chunks[5].parent_symbol == "Big" and chunks[0].chunk_type == "class"


TS = """import { a } from "x";
export interface User { id: string }
export class Service extends Base<{ a: 1 }> {
  run(): void { if (x) { return } }
}
export const handle = async (e: Event): Promise<void> => {
  const s = `a ${b({ c: "}" })} \\` }`;
}
const limit = 5;
type Id = string | { a: number };
export default function main() { return /[{"]/.test("x") }
enum Kind { A, B }
export { a };
"""


def test_typescript():
    assert told(TS, ".ts")[:-1] == [
        ("class", "User", 2, 2), ("class", "Service", 3, 5), ("function", "handle", 6, 8), ("class", "Id", 10, 10), ("function", "main", 11, 11), ("class", "Kind", 12, 12),
    ]
    rest = chunk_text(TS, ".tsx")[-1]
    assert rest.chunk_type == "preamble" and "const limit" in rest.text and "export { a }" in rest.text and rest.language == "typescript"


def test_commonjs():
    text = "const x = require('x');\nexports.a = function () {};\nmodule.exports.b = async (q) => { return 1 };\nmodule.exports = class Foo {};\nexports.c = require('y');\nexports.cfg = { a: 1 };\nmodule.exports.d = other;\n"
    assert [c.symbol_name for c in chunk_text(text, ".js")] == ["a", "b", "Foo", ""]
    assert told("module.exports = { a, b }\n", ".js")[0][:2] == ("function", "module.exports")


def test_go_and_receivers():
    text = "package main\n\ntype Service struct {\n\tname string\n}\n\nfunc New() *Service { return &Service{} }\n\nfunc (s *Service) Process(a int) error {\n\tprintln(`}`, '}', \"}\")\n\treturn nil\n}\n\nfunc (s Service) Name() string { return s.name }\n"
    assert told(text, ".go")[:-1] == [("class", "Service", 3, 5), ("function", "New", 7, 7), ("method", "Service.Process", 9, 12), ("method", "Service.Name", 14, 14)]


def test_java_and_swift():
    java = 'package a;\nimport b.C;\n\n@Service("x")\npublic final class A extends B {\n  String s = "}";\n  A() {}\n}\n\ninterface I { void m(); }\nrecord R(int a) {}\n'
    assert [x[:2] for x in told(java, ".java")] == [("class", "A"), ("class", "I"), ("class", "R"), ("preamble", "")]
    swift = "import Foundation\n\nfunc top() -> Int { 1 }\n\nclass C: P {\n  func m() {}\n}\nstruct S { var a: Int }\nenum E { case a }\nprotocol P { func q() }\n"
    assert [x[:2] for x in told(swift, ".swift")] == [("function", "top"), ("class", "C"), ("class", "S"), ("class", "E"), ("class", "P"), ("preamble", "")]


def test_long_typescript_class():
    body = "".join(f"  private p{i} = {i};\n  async m{i}(a: string): Promise<void> {{ log(\"{'x' * 40}\"); }}\n" for i in range(120))
    chunks = chunk_text("export class Big {\n" + body + "}\n", ".ts")
    names = [c.symbol_name for c in chunks]
    assert names[0] == "Big" and sum(n.startswith("Big.m") for n in names) == 120 and len(set(names)) == len(names)


def test_yaml_and_json():
    yaml = "# note\nname: x\nlist:\n- a: 1\n- b\n'quoted key': 1\n\nmap:\n  inner: |\n    text: here\n# end\n"
    assert told(yaml, ".yml") == [("config_block", "name", 2, 2), ("config_block", "list", 3, 5), ("config_block", "'quoted key'", 6, 6), ("config_block", "map", 8, 10)]
    js = '{\n  "a": {"b": "}"},\n  "c": [1,\n 2], "d": null\n}\n'
    assert told(js, ".json") == [("config_block", "a", 2, 2), ("config_block", "c", 3, 4), ("config_block", "d", 4, 4)]
    assert told("[1, 2]", ".json") == [("fallback", "", 1, 1)] and told("- a\n- b\n", ".yaml") == [("fallback", "", 1, 2)]


def test_fallback_and_blank():
    assert chunk_text("", ".py") == chunk_text(" \n\t", ".sh") == []
    assert told("a\nb\n", ".toml") == [("fallback", "", 1, 2)] and chunk_text("a\nb\n", ".toml")[0].text == "a\nb\n"
    text = "".join(f"line {i}\n" for i in range(200))
    assert [(c.start_line, c.end_line) for c in chunk_text(text, ".sh")] == [(1, 80), (61, 140), (121, 200)]


def test_a_window_may_hold_one_line_more():
    blank = [False] * 200
    blank[80] = True
    assert windows(blank, 80, 20)[0] == (0, 81)
    blank[60] = True
    blank[80] = False
    assert windows(blank, 80, 20)[:2] == [(0, 61), (41, 121)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=120), st.integers(4, 20), st.integers(0, 1))
def test_windows_cover_all_lines(blank, size, overlap):
    found = windows(blank, size, overlap)
    assert {i for a, b in found for i in range(a, b)} == set(range(len(blank)))
    assert all(0 < b - a <= size + 1 for a, b in found)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t{}()'\"`/*def class:=>;", max_size=400), st.sampled_from([".py", ".ts", ".go", ".java", ".swift", ".json", ".yml", ".sh"]))
def test_no_chunk_is_too_long_and_nothing_fails(text, ext):
    chunks = chunk_text(text, ext, max_chars=50)
    assert all(0 < len(c.text) <= 50 and c.text.strip() for c in chunks)


def test_size_cap_conserves_content():
    function = "def f():\n" + "".join(f"    x{i} = {i}\n" for i in range(4000))
    parts = [c for c in chunk_text(function, ".py") if c.symbol_name == "f"]
    assert "".join(c.text for c in parts) == function.rstrip() and all(len(c.text) <= 8000 for c in parts)
    assert [c.start_line for c in parts] == sorted(c.start_line for c in parts)
    assert [len(c.text) for c in chunk_text("x" * 20_000, ".md")] == [8000, 8000, 4000]
    assert chunk_text(" " * 16_000 + "\n", ".md") == []


def test_languages():
    assert [language_of(e) for e in (".tsx", ".jsx", ".bash", ".md", ".rs", "")] == ["typescript", "javascript", "shell", "markdown", "rs", ""]


def test_a_long_file_is_handed_on_in_small_batches():
    texts = ["", None, "one", "".join(f"line {i}\n" for i in range(60_000)), "two"]
    batch = pa.RecordBatch.from_pylist([{"repo": "r", "file": f"{k}.txt", "extension": ".txt", "text": t} for k, t in enumerate(texts)], pa.schema([(c, pa.string()) for c in ("repo", "file", "extension", "text")]))
    made = list(chunking._chunked(iter([batch]), 1 << 30, 8, 2))
    assert max(b.num_rows for b in made) <= chunking.BATCH_ROWS < sum(b.num_rows for b in made)
    rows = [r for b in made for r in b.to_pylist()]
    assert [(r["file"], r["chunk_index"], r["text"]) for r in rows] == [(f"{k}.txt", i, c.text) for k, t in enumerate(texts) for i, c in enumerate(chunk_text(t or "", ".txt", 1 << 30, 8, 2))]
