"""Chunkers of code on files made from tables: one file for each supplier, whose definitions SQL can list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.operators.chunking import chunk_files
from quillstrata.plans.base import big, query, table


def _written(template: str) -> Column:
    """The template with the supplier's number for each ~ and its nation's for each #."""
    return F.replace(F.replace(F.lit(template), F.lit("~"), F.col("s_suppkey").cast("string")), F.lit("#"), F.col("s_nationkey").cast("string"))


def _chunks(spark: SparkSession, sf_dir: str, name: str, template: str, max_chars: int = 8000) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    made = rows.select(F.concat(F.lit("s"), "s_suppkey").alias("repo"), F.lit(name).alias("file"), _written(template).alias("text"))
    found = chunk_files(made, max_chars)
    return found.select("repo", "symbol_name", "chunk_type", "signature", "parent_symbol", "parent_signature", big("start_line").alias("start_line"), big("end_line").alias("end_line"))


def _sql(*chunks: tuple) -> str:
    """SQL of (symbol_name, chunk_type, signature, start_line, end_line, parent_symbol, parent_signature) for each supplier."""

    def text(value: str) -> str:
        return "replace(replace('" + value.replace("'", "''") + "', '~', s_suppkey::VARCHAR), '#', s_nationkey::VARCHAR)"

    parts = []
    for name, kind, signature, start, end, *parent in chunks:
        owner, owner_signature = parent or ("", "")
        parts.append(
            f"SELECT 's' || s_suppkey AS repo, {text(name)} AS symbol_name, '{kind}' AS chunk_type, {text(signature)} AS signature, {text(owner)} AS parent_symbol, "
            f"{text(owner_signature)} AS parent_signature, {start}::BIGINT AS start_line, {end}::BIGINT AS end_line FROM supplier"
        )
    return " UNION ALL ".join(parts)


_TYPESCRIPT = """import { a } from "x";

export interface User~ { id: string }
export class Service~ extends Base<{ a: 1 }> {
  run(): number { if (a) { return # } }
}
export const handle~ = async (e: Event): Promise<void> => {
  const s = `a ${b({ c: "}" })} \\` }`;
}
type Id~ = string | { a: number };
export default function main~() { return /[{"]/.test("x") }
enum Kind~ { A, B }
"""


@query(_sql(
    ("User~", "class", "export interface User~ { id: string }", 3, 3), ("Service~", "class", "export class Service~ extends Base<{ a: 1 }> {", 4, 6),
    ("handle~", "function", "export const handle~ = async (e: Event): Promise<void> => {", 7, 9), ("Id~", "class", "type Id~ = string | { a: number };", 10, 10),
    ("main~", "function", 'export default function main~() { return /[{"]/.test("x") }', 11, 11), ("Kind~", "class", "enum Kind~ { A, B }", 12, 12), ("", "preamble", "", 1, 3),
))
def chunk_typescript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "a.ts", _TYPESCRIPT)


_COMMONJS = """const fs = require("fs");

module.exports = function load~(x) {
  return x + #;
};

exports.save~ = async (x) => {
  return "}";
};

module.exports.Store~ = class {
  get() { return # }
};

function plain~() { return 1 }
"""


@query(_sql(
    ("load~", "function", "module.exports = function load~(x) {", 3, 5), ("save~", "function", "exports.save~ = async (x) => {", 7, 9),
    ("Store~", "class", "module.exports.Store~ = class {", 11, 13), ("plain~", "function", "function plain~() { return 1 }", 15, 15), ("", "preamble", "", 1, 3),
))
def chunk_commonjs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "a.js", _COMMONJS)


_GO = """package main

import "fmt"

type Server~ struct {
\tport int
}

func (s *Server~) Start(x int) error {
\tfmt.Println("}", #)
\treturn nil
}

func New~(port int) *Server~ {
\treturn &Server~{port}
}
"""


@query(_sql(
    ("Server~", "class", "type Server~ struct {", 5, 7), ("Server~.Start", "method", "func (s *Server~) Start(x int) error {", 9, 12),
    ("New~", "function", "func New~(port int) *Server~ {", 14, 16), ("", "preamble", "", 1, 5),
))
def chunk_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "a.go", _GO)


_JAVA = """package a.b;

import java.util.List;

public final class Box~ extends Base {
    private int size = #;
    public int size() { return size; }
}

interface Shape~ {
    double area();
}

enum Colour~ { RED, GREEN }
"""


@query(_sql(
    ("Box~", "class", "public final class Box~ extends Base {", 5, 8), ("Shape~", "class", "interface Shape~ {", 10, 12),
    ("Colour~", "class", "enum Colour~ { RED, GREEN }", 14, 14), ("", "preamble", "", 1, 5),
))
def chunk_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "A.java", _JAVA)


_SWIFT = """import Foundation

public struct Point~ {
    let x = #
}

extension Point~ {
    func moved() -> Int { return x }
}

func helper~(_ a: Int) -> Int {
    return a
}
"""


@query(_sql(
    ("Point~", "class", "public struct Point~ {", 3, 5), ("Point~", "class", "extension Point~ {", 7, 9), ("helper~", "function", "func helper~(_ a: Int) -> Int {", 11, 13), ("", "preamble", "", 1, 3),
))
def chunk_swift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "a.swift", _SWIFT)


_DECORATED = """import os

@cache
@other(#)
async def get~():
    pass

@final
class Box~:
    def size(self):
        return 1
"""


@query(_sql(("get~", "function", "@cache", 3, 6), ("Box~", "class", "@final", 8, 11), ("", "preamble", "", 1, 3)))
def chunk_decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "a.py", _DECORATED)


_LONG = "class Long~:\n" + "".join(f"    def m{i}(self):\n        return '{'x' * 60}'\n\n" for i in range(6))


@query(_sql(("Long~", "class", "class Long~:", 1, 1), *((f"Long~.m{i}", "function", f"def m{i}(self):", 2 + 3 * i, 3 + 3 * i, "Long~", "class Long~:") for i in range(6))))
def chunk_long_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a class that is longer than a chunk may be, each with its parent."""
    return _chunks(spark, sf_dir, "a.py", _LONG, max_chars=400)


_MEMBERS = "export class Wide~ {\n" + "".join(f"  m{i}(a: number): string {{\n    return '{'y' * 60}';\n  }}\n" for i in range(6)) + "}\n"


@query(_sql(("Wide~", "class", "export class Wide~ {", 1, 1), *((f"Wide~.m{i}", "method", f"m{i}(a: number): string {{", 2 + 3 * i, 4 + 3 * i, "Wide~", "export class Wide~ {") for i in range(6))))
def chunk_long_typescript_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "a.ts", _MEMBERS, max_chars=400)


_PREAMBLE = "".join(f"value_{i} = {i}\n" + ("\n" if i % 5 == 4 else "") for i in range(30)) + "def last~():\n    return 1\n"


#: Lines of the parts: cut at blank lines, then by size.
PARTS = ((1, 13), (13, 17), (19, 29), (29, 29), (31, 35))


@query(_sql(("last~", "function", "def last~():", 37, 38), *(("", "preamble", "", a, b) for a, b in PARTS)))
def chunk_long_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preamble that is longer than a chunk may be is cut at blank lines."""
    return _chunks(spark, sf_dir, "a.py", _PREAMBLE, max_chars=130)
