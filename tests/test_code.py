"""The code scanner, by language, and the tables made with it."""

import pytest

from siltstone.functions import code
from siltstone.operators import chunk, symbols

SCRIPT = '''import a, { b as c, type D } from "./lib/util";
import * as path from 'path';
// class InComment {}
const s = "class InString {}"; const r = /class InRegex {}/g, d = x / 2 / y;
const t = `class InTemplate { ${f(`function inner() {}`, "}")} function no() {}`;
export default class Box<T> extends Base<T> implements Shape, Other<T> {
  private static async load(x: { a: number }): Promise<void> {
    if (x) { b(); }
    for (const i of y) { helper(i) }
  }
  #hidden() { return `${a.make({})}`; }
}
/* export function gone() {
} */
export const arrow = async (x: number) => { b(x) };
let plain = function () {};
interface Shape { area(): number }
type Pair<K> = [K, K];
export enum Color { Red }
export async function* walk() { a.go(1); c(2); }
'''
GO = '''package main

import (
	"fmt"
	util "example.org/m/pkg/util" // "not/this"
)

// func inComment() {}
var s = `type InString struct {
func no() {}`
type Box struct { w int }
func (b *Box) Area() int { return util.Twice(b.w) }
func main() { fmt.Println("func no() {"); r := '"'; _ = r }
'''
RUST = '''use crate::shapes::{Square, round::{self, Circle}};
use std::fmt as f;
/* outer /* struct Inner {} */ fn no() {} */
pub struct Box<'a> { name: &'a str }
const S: &str = r#"impl Fake { fn no() {} } "quoted" "#;
impl<'a> Shape for Box<'a> {
    pub fn area(&self) -> char { let c = '"'; Square(1); c }
}
pub(crate) trait Shape { fn area(&self) -> char; }
enum Color { Red }
mod inner { pub fn deep() {} }
type Pair = (u8, u8);
'''
PYTHON = '''import os
from .lib import one, two as zwei

@decorated
class A(one):
    """class InString: def no(): pass"""
    def method(self):
        return two(1) + one()
'''


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("x.ts", SCRIPT, [("Box", "class", 6), ("load", "method", 7), ("#hidden", "method", 11), ("arrow", "function", 15), ("plain", "function", 16), ("Shape", "interface", 17), ("Pair", "type", 18), ("Color", "enum", 19), ("walk", "function", 20)]),
        ("x.go", GO, [("Box", "type", 11), ("Area", "method", 12), ("main", "function", 13)]),
        ("x.rs", RUST, [("Box", "struct", 4), ("area", "function", 7), ("Shape", "trait", 9), ("Color", "enum", 10), ("inner", "mod", 11), ("Pair", "type", 12)]),
        ("x.py", PYTHON, [("A", "class", 4), ("method", "function", 7)]),
        ("x.md", SCRIPT, []),
    ],
)
def test_definitions(path, text, want):
    assert code.symbols(text, path) == want


@pytest.mark.parametrize("lang, text", [("script", SCRIPT), ("go", GO), ("rust", RUST), ("python", PYTHON)])
def test_a_mask_keeps_lines_and_places(lang, text):
    masked = code.mask(text, lang)
    assert len(masked) == len(text) and [i for i, c in enumerate(masked) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    for hidden in ("InComment", "InString", "InRegex", "InTemplate", "inner()", "gone", "Fake", "inComment", "Inner"):
        assert hidden not in masked
    assert all(m == t or m == " " for m, t in zip(masked, text))


@pytest.mark.parametrize("text", ['"', "'", "`", "`${", "/*", "/* /*", "/", 'r#"', "'''", "'a", "\\", "`${`", "a / b", "x = '\\''", "//"])
def test_what_is_not_closed_ends(text):
    for lang in ("script", "go", "rust", "python"):
        assert len(code.mask(text, lang)) == len(text)
        code.constructs(text, {"script": "a.ts", "go": "a.go", "rust": "a.rs", "python": "a.py"}[lang])


def test_breaks_are_before_constructs():
    b = code.breaks(SCRIPT, "x.tsx")
    at = lambda s: SCRIPT.index(s) - 1
    assert b[0] == 60 and b[at("export default class")] == 100 and b[at("export enum")] == 90 and b[at("type Pair")] == 80 and b[at("  private")] == 90
    assert not any("InComment" in SCRIPT[p : p + 20] for p in b)
    g = code.breaks(GO, "x.go")
    assert g[GO.index("type Box") - 1] == 80 and g[GO.index("func (b") - 1] == 90 and GO.index("func no") - 1 not in g


def test_chunks_of_code_break_before_a_class_not_in_a_string(spark):
    body = "x = 1\n" * 500 + 's = """\nclass Fake:\n"""\n' + "y = 2\n" * 60 + "\nclass Real:\n    pass\n" + "z = 3\n" * 200
    rows = chunk.chunk_documents(spark.createDataFrame([("h", body, "a.py")], "hash string, doc string, path string"), path="path").orderBy("seq").collect()
    # the first chunk ends where the class begins, the second begins with the overlap before it
    assert body.startswith("\nclass Real", rows[0]["pos"] + len(rows[0]["text"]))


def test_relations():
    got = [tuple(r)[:4] for r in code.relations(SCRIPT, "x.ts")]
    assert got[:3] == [("imports", None, "./lib/util", "D"), ("imports", None, "./lib/util", "a"), ("imports", None, "./lib/util", "b")], got
    assert ("extends", "Box", "Base", None) in got and ("implements", "Box", "Shape", None) in got and ("implements", "Box", "Other", None) in got
    assert ("calls", None, "a", "go") in got and [r for r in got if r[0] == "calls" and r[2] == "b"] == [("calls", None, "b", "b")] * 2
    assert [tuple(r)[:4] for r in code.relations(GO, "x.go")] == [("imports", None, "fmt", "fmt"), ("imports", None, "example.org/m/pkg/util", "util"), ("calls", None, "util", "Twice"), ("calls", None, "fmt", "Println")]
    assert {r.ref for r in code.relations(RUST, "x.rs") if r.kind == "imports"} == {"crate::shapes::Square", "crate::shapes::round", "crate::shapes::round::Circle", "std::fmt"}
    assert {tuple(r)[:4] for r in code.relations(PYTHON, "x.py")} == {("imports", None, "os", "os"), ("imports", None, ".lib", "one"), ("imports", None, ".lib", "two"), ("extends", "A", "one", None), ("calls", None, "two", "two"), ("calls", None, "one", "one")}


def test_edges_between_files(spark):
    files = {
        "web/app.ts": 'import { Store } from "../store/index.js";\nimport { gone } from "./gone";\nimport x from "lib";\n',
        "store/index.ts": "export class Store {}\n",
        "pkg/a.py": "from .b import f\nfrom . import b\nimport pkg.c\nfrom pkg.c import missing\nimport os\n",
        "pkg/b.py": "def f():\n    pass\n",
        "pkg/c.py": "",
        "pkg/__init__.py": "",
        "cmd/main.go": 'package main\nimport "example.org/m/internal/util"\n',
        "internal/util/u.go": "package util\nfunc Twice() {}\n",
        "src/main.rs": "use crate::shapes::Square;\nuse crate::shapes;\nuse std::fmt;\n",
        "src/shapes.rs": "pub struct Square;\n",
    }
    got = {tuple(r) for r in symbols.edges(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}
    assert got == {
        ("web/app.ts", 1, "../store/index.js", "Store", "store/index.ts", True),
        ("pkg/a.py", 1, ".b", "f", "pkg/b.py", True),
        ("pkg/a.py", 2, ".", "b", "pkg/b.py", False),
        ("pkg/a.py", 3, "pkg.c", "pkg", "pkg/c.py", False),
        ("pkg/a.py", 4, "pkg.c", "missing", "pkg/c.py", False),
        ("cmd/main.go", 2, "example.org/m/internal/util", "util", "internal/util/u.go", False),
        ("src/main.rs", 1, "crate::shapes::Square", "Square", "src/shapes.rs", True),
        ("src/main.rs", 2, "crate::shapes", "shapes", "src/shapes.rs", False),
    }
    assert symbols.definitions(spark.createDataFrame([("a.go", GO), ("n.txt", GO)], "path string, text string")).count() == 3
