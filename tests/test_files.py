"""Files that are read whole in one task: no window over their tokens."""

import random

import pytest
from cartograph.functions.lexis import lex
from cartograph.operators import files, golang, python, rust
from cartograph.operators.extract import extract, facts
from cartograph.plans import source_queries
from pyspark.sql import functions as F

# Pieces that tokens begin, end or are broken with.
PIECES = [
    "fn ", "f", "g(", "(", ")", "{", "}", "[", "]", "<", ">", ";", "!", "#", "let ", "=", ":=", "->", "=>", "::", "..",
    "r#x", 'r#"a("#', '"b\\" ("', "'c'", "'d", "b'e'", "/* /* */ */", "/*", "*/", "// z\n", "`r`", "`", '"""', "'''",
    'f"{a(1)} {{', "f'{", "}}", "{b!r}", 'rb"', "\\\n", "\r\n", "\n", " ", "\t", "\x0b", "\ufeff", "é", "中(", "²",
    "1.5e3", "$v", "\\", '"', "'", 'br"y"', "_", "def ", "class ", "func ", "type ", "import ",
]
READERS = {"rust": rust, "go": golang, "python": python}


def _odd_texts(n: int) -> list[str]:
    rng = random.Random(5)
    return ["".join(rng.choices(PIECES, k=rng.choice((3, 20, 80)))) for _ in range(n)]


@pytest.mark.parametrize("lang", READERS)
def test_texts_are_lexed_as_by_the_engine(spark, lang):
    texts = _odd_texts(400)
    if lang == "rust":
        texts += ["fn a() { " + "/*" * d + " x " + "*/" * d + " }" for d in (11, 12, 13)]
        texts += ["r" + "#" * n + '"a"' + "#" * n + " b" for n in (0, 255, 256)]
    frame = spark.createDataFrame(enumerate(texts), "n int, text string").select("n", lex(F.col("text"), lang).alias("toks"))
    for row in frame.collect():
        assert READERS[lang].lexed(texts[row.n])[0] == row.toks


@pytest.mark.parametrize("lang", READERS)
def test_facts_of_a_file_have_no_window_and_no_sort(spark, lang):
    sources = spark.createDataFrame([("a", "f(1)", lang)], "path string, content string, lang string")
    plan = facts(sources, lang, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


RUST = '''fn f<F: Fn(u8)>(
    x: F, y: i64) -> i64 {
    let Some(a) = g(x) else { h(1) };
    println!("{}", i(2)); j(3);
    match k { Some(b) if l(4) => m(5), N(c) => 6, _ => o::p(7) }
    for (q, r(s)) in t(8) { u.v(9) }
}
struct W;
fn w(no: body);
struct X { y: Z }
#[attr(z(10))]
fn open(a: i64) {
  lost(11);
'''


def test_rust_declarations_and_calls_of_one_file():
    found = rust.file_facts("a.rs", RUST)
    own = [dict(zip(files.OWN, row)) for row in found]
    heads = [(r["head"], r["name"], r["line"], r["end_line"], r["params"]) for r in own if r["head"]]
    assert heads == [
        ("rs_fn", "f", 1, 7, "(\n    x: F, y: i64)"), ("rs_struct", "W", 8, 8, None), ("rs_struct", "X", 10, 10, None),
        ("rs_fn", "open", 12, 12, "(a: i64)"),
    ]
    assert [(r["tok"], r["line"]) for r in own if r["call"]] == [
        ("Fn", 1), ("g", 3), ("h", 3), ("j", 4), ("l", 5), ("m", 5), ("t", 6), ("lost", 13),
    ]


GO = '''package n
import "fmt"
type (
    One struct { x int }
    Two[T any] interface { M(y int) }
)
type Box[T any] struct { v T }
func (b Box[T]) Put(w int,
    z func(int) int) { New[int](w); xs[i] = c.d(e); fmt.Println(w); make(1) }
func New(v int) { if (v > 1) { put(v) }
func open() { lost(2)
'''


def test_go_declarations_calls_and_imports_of_one_file():
    own = [dict(zip(files.OWN, row)) for row in golang.file_facts("a.go", GO)]
    assert [(r["head"], r["name"], r["start_line"], r["end_line"], r["params"]) for r in own if r["head"]] == [
        ("go_struct", "One", 3, 6, None), ("go_struct", "Box", 7, 7, None),
        ("go_method", "Put", 8, 9, "(w int,\n    z func(int) int)"), ("go_func", "New", 10, 10, "(v int)"),
        ("go_func", "open", 11, 11, "()"),
    ]
    assert [(r["tok"], r["line"]) for r in own if r["imported"]] == [('"fmt"', 2)]
    assert [(r["tok"], r["line"]) for r in own if r["call"]] == [
        ("M", 5), ("New", 9), ("make", 9), ("put", 10), ("lost", 11),
    ]


PYTHON = '''import a.b, c
class D(E):
    """one"""
    @dec
    def m(self, x=(1, 2)):
        "two"
        return f"{g(x)} {h}"
async def n(
        y): k(1); l.o(2)
def p(): pass
'''


def test_python_declarations_calls_and_imports_of_one_file():
    own = [dict(zip((*files.OWN, "doc", "in_class", "top"), row)) for row in python.file_facts("a.py", PYTHON)]
    assert [
        (r["head"], r["name"], r["line"], r["end_line"], r["params"], r["doc"], r["in_class"], r["top"]) for r in own if r["head"]
    ] == [
        ("py_class", "D", 2, 7, None, '"""one"""', False, True),
        ("py_def", "m", 5, 7, "(self, x=(1, 2))", '"two"', True, True),
        ("py_def", "n", 8, 9, "(\n        y)", None, False, True), ("py_def", "p", 10, 10, "()", None, False, True),
    ]
    assert [r["tok"] for r in own if r["imported"]] == ["import", "a", ".", "b", ",", "c"]
    assert [(r["tok"], r["line"]) for r in own if r["call"]] == [("g", 7), ("k", 9)]


def test_rust_files_of_no_text_and_long_lists(spark):
    long = ", ".join(f"x{i}: i64" for i in range(300))
    rows = [("a.rs", f"fn a({long}) {{ b(1) }}"), ("none.rs", None), ("empty.rs", ""), ("blank.rs", " \n// c\n"), ("é.rs", "fn ñ() { ü(1) }")]
    found = extract(spark.createDataFrame(rows, "path string, content string"), ("rust",))
    assert sorted((r.id, r.signature) for r in found.symbols.collect()) == [("a.rs::a", f"fn a(({long}))"), ("é.rs::ñ", "fn ñ(())")]
    assert sorted((r.source, r.target) for r in found.raw_edges.collect()) == [("a.rs::a", "b"), ("é.rs::ñ", "ü")]


def test_functions_of_rust_stage_no_edges_and_call_sites_neither(spark, tmp_path, monkeypatch):
    for name, key, extra in (
        ("part", "p_partkey", "p_name string"), ("supplier", "s_suppkey", "s_name string"),
        ("orders", "o_orderkey", "o_orderstatus string"), ("customer", "c_custkey", "c_name string"),
    ):
        spark.createDataFrame([(k, f"name {k}") for k in range(50)], f"{key} long, {extra}").write.parquet(f"{tmp_path}/{name}.parquet")
    staged, stage = [], source_queries.stage

    def seen(frame, label="stage", **metrics):
        staged.append(label)
        return stage(frame, label, **metrics)

    monkeypatch.setattr(source_queries, "stage", seen)
    assert source_queries._kind("rust", "function")(spark, str(tmp_path)).count() == 50
    assert source_queries.call_sites(spark, str(tmp_path)).count() == 50 * 6
    assert staged == ["symbols"]
