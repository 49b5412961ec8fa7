"""Handwritten snippets, one extraction per language; expected rows are stated here."""

import pytest

from cartograph.operators.extract import extract
from cartograph.operators.tokens import tokens

PY = {
    "a.py": '''\
import os
import a.b, c.d as e, f
from m import x, y as z, (w)
from . import rel
from .pkg import rel2
from __future__ import annotations
from q.r import (
    one,  # first
    two,
)
from s import *

@decorate
def top(a, b=default(1)):
    x = 1
    "late doc"
    helper(a)
    obj.method(b)
    if a:
        inner_call(
            a
        )
    def nested(q):
        """nested doc"""
        deep(q)
    return "text with call(1)"  # comment call(2)

if True:
    def hidden(x):
        gone(x)

async def later(
    a: int,
    b: str = ")",
) -> dict:
    \'\'\'multi
    line ( doc\'\'\'
    await fetch(a)

class Outer(Base):
    """class doc"""
    attr = make()

    @property
    def prop(self):
        return size(self)

    def plain(self): return one_line(self)

    class Inner:
        def leaf(self):
            total = alpha(1) + \\
                beta(2)
            return not (total)

def after(): pass
''',
    "tabs.py": "def t(a):\n\tif a:\n\t\tcall_one(a)\n\tcall_two(a)\n\n\n# end\n",
    "crlf.py": "def c(a):\r\n    call_c(a)\r\n\r\ndef d(b):\r\n    call_d(b)\r\n",
    "empty.py": "",
    "noeol.py": "def last(x):\n    end(x)",
    "long.py": 'def big():\n    """' + "x\n" * 3000 + '"""\n    s = "' + "y\\\"" * 200000 + '"\n    fin(s)\n',
    "params.py": "def many(" + ", ".join(f"arg_{i}=0" for i in range(60)) + "):\n    body(1)\n",
}

TS = {
    "a.ts": '''\
import def, { a as b } from "./mod";
import './side';
import type { T } from 'types';
export { q } from "not-an-import";
const dyn = import("dynamic");
import req = require("old");

export async function load<T extends { a: number }>(x: T, cb: (n: number) => void): Promise<{ a: T }> {
  const pattern = /foo(bar)"/g;
  fetchIt(x);
  obj.skip(x);
  new Thing(x);
  const y = maybe?.(x);
  useState<string>(0);
  const half = a / b / call_div(2);
  if (x) { inside(x); }
  const s = `template ${hidden(x)}`;
  function nested(q) { deep(q); }
  const arrow = (z) => arrowCall(z);
  return y;
}

const fe = function named(x) { notDecl(x); };
function* gen(x) { yield genCall(x); }
function overload(a: string): string;
function overload(a) {
  impl(a)
}

abstract class Abs { run() { absCall(); } }

@Decor({ x: 1 })
export class Real extends mixin(Base) implements I<{ q: 1 }> {
  private field = start();
  #secret() { secretCall(); }
  constructor(private a: string) { super(a); init(a); }
  get value(): number { return compute(this.a); }
  static async delete(x, { y } = {}) {
    if (x) { removed(y); }
    switch (x) { case check(x): break; }
    return cond ? first(x) : second(y);
  }
  "quoted"() { quotedCall(); }
  sig(x: number): void;
  prop = (x) => { propCall(x); };
  obj() { return { inner(z) { innerCall(z); } }; }
}
''',
}

RS = {
    "a.rs": '''\
use std::fmt;

/* block comment fn ghost() { } */
pub struct Unit;
pub struct Tuple(u8, String);
struct Wide<T>
where
    T: Clone,
{
    a: T,
}

#[derive(Debug)]
pub async fn run<'a, F: Fn(i32) -> i32>(f: F, s: &'a str) -> Result<u8, ()>
where
    F: Send,
{
    let c = 'x';
    let q = '"';
    let raw = r#"fn fake() { call_in_raw(1) }"#;
    plain(1);
    std::mem::drop(c);
    f.method(2);
    println!("{}", in_macro(3));
    let v = vec![also_macro(4)];
    turbo::<u8>(5);
    if !(ready(6)) {
        loop_call(7);
    }
    let Some(inner) = maybe(8) else { return fail(9) };
    for (i, Pair(a, b)) in items(10) {
        match a {
            Some(Deep(x)) => on_some(x),
            Pair(y, z) if guard(y) => { on_pair(z) }
            _ => other(11),
        }
    }
    fn nested(x: u8) { deep(x) }
    Ok(12)
}

trait Shape {
    fn area(&self) -> f64;
    fn name(&self) -> String { describe(self) }
}

impl Shape for Unit {
    fn area(&self) -> f64 { compute(1.0) }
}

macro_rules! make {
    () => { fn generated() { ghost_call() } };
}

type Alias = fn(i32) -> i32;
''',
}

GO = {
    "a.go": '''\
package main

import "fmt"
import alias "strings"
import (
\t"grouped/one"
\t"grouped/two"
)

type Single struct {
\tA int
\tB struct{ C int }
}

type (
\tFirst struct{ X int }
\tSecond interface {
\t\tDo(x int) error
\t}
\tThird int
)

type Gen[T any] struct {
\tv T
}

type Slice []struct{ y int }
type Alias = struct{ z int }

type Iface interface {
\tRun(a int) string
}

func Plain(a int, b string) (int, error) {
\tgo spawn(a)
\tdefer close(b)
\tx := string(a)
\tfmt.Println(x)
\treturn helper(a), nil
}

func Generic[T any](x T) interface{} { return wrap(x) }

func (r *Single) Method(w int) string {
\tf := func(q int) int { return inner(q) }
\t// call_in_comment(1)
\ts := `raw call_in_raw(2)`
\tif (w > 1) { paren(w) }
\treturn f(w) + s
}

var fn = func() { top() }
''',
}

CASES = {"python": PY, "typescript": TS, "rust": RS, "go": GO}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(path, text) for files in CASES.values() for path, text in files.items()]
    sources = spark.createDataFrame(rows, "path string, content string").repartition(4)
    return extract(sources)


@pytest.fixture(scope="module")
def symbols(found):
    return found.symbols.collect()


@pytest.fixture(scope="module")
def edges(found):
    return found.raw_edges.collect()


def named(symbols, path):
    return {
        (s.name, s.kind, s.line_start, s.line_end) for s in symbols if s.file_path == path
    }


def targets(edges, source, kind="calls"):
    return {e.target for e in edges if e.source == source and e.kind == kind}


def test_tokens_join_to_the_text(spark):
    rows = [(path, text) for files in CASES.values() for path, text in files.items()]
    sources = spark.createDataFrame(rows, "path string, content string")
    joined: dict[str, list] = {}
    for lang in CASES:
        for row in tokens(sources, lang).collect():
            joined.setdefault(row.path, []).append((row.pos, row.tok))
    for path, text in rows:
        assert "".join(t for _, t in sorted(joined.get(path, []))) == text, path


def test_python_lines_are_those_of_the_text(symbols):
    lines = PY["a.py"].split("\n")
    for s in symbols:
        if s.file_path == "a.py":
            assert s.name in lines[s.line_start - 1]
    ends = {s.name: lines[s.line_end - 1].strip() for s in symbols if s.file_path == "a.py"}
    assert ends["top"].startswith("return")
    assert ends["later"] == "await fetch(a)"
    assert ends["leaf"] == "return not (total)"
    assert ends["Outer"] == ends["Inner"] == "return not (total)"
    assert ends["plain"].startswith("def plain")
    assert ends["after"] == "def after(): pass"
    kinds = {(s.name, s.kind) for s in symbols if s.file_path == "a.py"}
    assert kinds == {
        ("top", "function"), ("later", "function"), ("after", "function"),
        ("Outer", "class"), ("Inner", "class"),
        ("prop", "function"), ("prop", "method"), ("plain", "method"), ("leaf", "method"),
    }


def test_python_docstrings_and_signatures(symbols):
    by = {(s.name, s.kind): s for s in symbols if s.file_path == "a.py"}
    assert by["top", "function"].docstring == '"late doc"'
    assert by["later", "function"].docstring == "'''multi\n    line ( doc'''"
    assert by["Outer", "class"].docstring is None
    assert by["top", "function"].signature == "def top((a, b=default(1)))"
    assert by["later", "function"].signature == 'def later((\n    a: int,\n    b: str = ")",\n))'
    assert by["Outer", "class"].signature == "class Outer"
    long = next(s for s in symbols if s.file_path == "long.py")
    assert long.docstring == '"""' + "x\n" * 3000 + '"""' and long.line_end == 3004
    many = next(s for s in symbols if s.file_path == "params.py")
    assert many.signature == "def many((" + ", ".join(f"arg_{i}=0" for i in range(60)) + "))"


def test_python_calls(edges):
    assert targets(edges, "a.py::top") == {"helper", "inner_call", "deep"}
    assert targets(edges, "a.py::later") == {"fetch"}
    assert targets(edges, "a.py::prop") == {"size"}
    assert targets(edges, "a.py::plain") == {"one_line"}
    assert targets(edges, "a.py::leaf") == {"alpha", "beta"}
    assert targets(edges, "tabs.py::t") == {"call_one", "call_two"}
    assert targets(edges, "crlf.py::c") == {"call_c"}
    assert targets(edges, "noeol.py::last") == {"end"}
    assert targets(edges, "long.py::big") == {"fin"}
    assert targets(edges, "params.py::many") == {"body"}
    assert not any(e.target in ("gone", "make", "call", "default") for e in edges)


def test_python_defines_and_imports(edges):
    assert targets(edges, "a.py::Outer", "defines") == {"a.py::prop", "a.py::plain", "a.py::leaf"}
    assert targets(edges, "a.py::Inner", "defines") == {"a.py::leaf"}
    assert targets(edges, "a.py", "imports") == {"os", "a.b", "f", "x", "w", "one", "two"}


def test_typescript_symbols(symbols):
    lines = TS["a.ts"].split("\n")
    got = {(s.name, s.kind) for s in symbols if s.file_path == "a.ts"}
    assert got == {
        ("load", "function"), ("nested", "function"), ("overload", "function"), ("Real", "class"),
        ("constructor", "method"), ("value", "method"), ("delete", "method"), ("obj", "method"),
        ("inner", "method"),
    }
    by = {s.name: s for s in symbols if s.file_path == "a.ts"}
    assert by["load"].signature == (
        "function load((x: T, cb: (n: number) => void))"
    )
    assert lines[by["load"].line_end - 1] == "}" and by["load"].line_end - by["load"].line_start == 13
    assert by["delete"].signature == "delete((x, { y } = {}))"
    assert by["delete"].line_end - by["delete"].line_start == 4
    assert by["Real"].line_end == len(lines) - 1
    assert by["overload"].line_end - by["overload"].line_start == 2


def test_typescript_edges(edges):
    assert targets(edges, "a.ts::load") == {
        "fetchIt", "maybe", "useState", "call_div", "inside", "hidden", "deep", "arrowCall",
    }
    assert targets(edges, "a.ts::nested") == {"deep"}
    assert targets(edges, "a.ts::overload") == {"impl"}
    assert targets(edges, "a.ts::constructor") == {"init"}
    assert targets(edges, "a.ts::value") == {"compute"}
    assert targets(edges, "a.ts::delete") == {"removed", "check", "first", "second"}
    assert targets(edges, "a.ts::obj") == {"innerCall"}
    assert targets(edges, "a.ts::Real", "defines") == {
        f"a.ts::{m}" for m in ("constructor", "value", "delete", "obj", "inner")
    }
    assert targets(edges, "a.ts", "imports") == {"./mod", "./side", "types"}


def test_rust_symbols(symbols):
    lines = RS["a.rs"].split("\n")
    got = sorted((s.name, s.kind) for s in symbols if s.file_path == "a.rs")
    assert got == sorted([
        ("Unit", "struct"), ("Tuple", "struct"), ("Wide", "struct"), ("run", "function"),
        ("nested", "function"), ("name", "function"), ("area", "function"),
    ])
    by = {s.name: s for s in symbols if s.file_path == "a.rs"}
    assert by["Wide"].line_end - by["Wide"].line_start == 5
    assert by["run"].signature == "fn run((f: F, s: &'a str))"
    assert lines[by["run"].line_end - 1] == "}" and "Ok(12)" in lines[by["run"].line_end - 2]
    assert "compute" in lines[by["area"].line_start - 1]


def test_rust_calls(edges):
    assert targets(edges, "a.rs::run") == {
        "plain", "ready", "loop_call", "maybe", "fail", "items", "on_some", "guard", "on_pair",
        "other", "deep", "Ok",
    }
    assert targets(edges, "a.rs::nested") == {"deep"}
    assert targets(edges, "a.rs::name") == {"describe"}
    assert targets(edges, "a.rs::area") == {"compute"}


def test_go_symbols(symbols):
    lines = GO["a.go"].split("\n")
    line = lambda text: lines.index(text) + 1
    group = (line("type ("), lines.index(")", line("type (")) + 1)
    assert named(symbols, "a.go") == {
        ("Single", "struct", line("type Single struct {"), line("type Single struct {") + 3),
        ("First", "struct", *group),
        ("Second", "interface", line("\tSecond interface {"), line("\tSecond interface {")),
        ("Gen", "struct", line("type Gen[T any] struct {"), line("type Gen[T any] struct {") + 2),
        ("Iface", "interface", line("type Iface interface {"), line("type Iface interface {")),
        ("Plain", "function", line("func Plain(a int, b string) (int, error) {"),
         line("func Plain(a int, b string) (int, error) {") + 6),
        ("Generic", "function", *[line("func Generic[T any](x T) interface{} { return wrap(x) }")] * 2),
        ("Method", "method", line("func (r *Single) Method(w int) string {"),
         line("func (r *Single) Method(w int) string {") + 6),
    }
    by = {s.name: s for s in symbols if s.file_path == "a.go"}
    assert by["Method"].signature == "func (r) Method((w int))"
    assert by["Generic"].signature == "func Generic((x T))"
    assert by["Single"].signature == "type Single struct{...}"


def test_go_edges(edges):
    assert targets(edges, "a.go::Plain") == {"spawn", "close", "string", "helper"}
    assert targets(edges, "a.go::Generic") == {"wrap"}
    assert targets(edges, "a.go::Method") == {"inner", "paren", "f"}
    assert targets(edges, "a.go", "imports") == {"fmt", "strings"}


def test_options(spark):
    text = 'class A:\n    """doc"""\n    def f(self): pass\n'
    sources = spark.createDataFrame([("o.py", text)], "path string, content string")
    rows = extract(sources, ("python",), class_docstrings=True, clean_signature=True).symbols.collect()
    by = {r.name: r for r in rows}
    assert by["A"].docstring == '"""doc"""'
    assert by["f"].signature == "def f(self)"
