"""The extraction behind the corpus queries: one language at a time, and the tokens that Rust sorts."""

from cartograph.operators import tokens
from cartograph.operators.extract import extract
from cartograph.plans import source_queries


def _tables(spark, folder) -> str:
    for name, key, extra, n in (
        ("part", "p_partkey", "p_name string", 50), ("supplier", "s_suppkey", "s_name string", 10),
        ("orders", "o_orderkey", "o_orderstatus string", 90), ("customer", "c_custkey", "c_name string", 45),
    ):
        rows = spark.createDataFrame([(k, f"name {k}") for k in range(n)], f"{key} long, {extra}")
        rows.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_a_query_of_one_language_lexes_the_files_of_that_language(spark, tmp_path, monkeypatch):
    sf, asked = _tables(spark, tmp_path), []

    def seen(sources, languages=tokens.ALL_LANGUAGES, **options):
        asked.append(languages)
        return extract(sources, languages, **options)

    monkeypatch.setattr(source_queries, "extract", seen)
    assert source_queries._edges("go", "calls")(spark, sf).count() == 45
    assert source_queries._kind("go", "struct")(spark, sf).count() == 45
    # Extracted once, and for this language only.
    assert asked == [("go",)]
    docs = source_queries.py_docstrings(spark, sf).collect()
    assert len(docs) == 50 and asked == [("go",), ("python",)]
    summary = {r.lang: (r.files, r.symbols, r.raw_edges) for r in source_queries.extract_summary(spark, sf).collect()}
    assert summary == {"python": (3, 70, 50 + 10 + 10 + 4), "typescript": (1, 30, 31), "rust": (3, 180, 90), "go": (2, 180, 47)}
    assert sorted(asked) == sorted((name,) for name in tokens.ALL_LANGUAGES)
    # Every call site has one edge, in all languages.
    assert source_queries.call_sites(spark, sf).count() == 50 + 10 + 2 * 10 + 90 + 45


def test_partitions_follow_the_bytes_of_the_language(spark, monkeypatch):
    monkeypatch.setattr(tokens, "PART_BYTES", 100)
    rows = [(f"a{i}.rs", "x" * 1000) for i in range(4)] + [("b.go", "x" * 10)]
    _, parts, present = tokens.by_language(spark.createDataFrame(rows, "path string, content string"), ("rust", "go"))
    assert parts == {"rust": 40, "go": int(spark.conf.get("spark.sql.shuffle.partitions"))} and present == ("rust", "go")


RUST = '''// first
/* two
lines */ struct S<T> { id: T } // end
fn f<A: B>(x: i64,
    y: &str) -> i64 {
    let s = "a
b"; /* c
*/ call(x); a.b(y);
    println!("g({})", h(x))
}
'''


def test_rust_sorts_telling_tokens_with_their_places(spark):
    sources = spark.createDataFrame([("a.rs", RUST), ("empty.rs", ""), ("none.rs", None), ("blank.rs", " \n// c\n")], "path string, content string")
    rows = tokens.significant(sources, "rust", 2).orderBy("path", "pos").collect()
    assert {r.path for r in rows} == {"a.rs"}
    placed = [(r.tok, r.line, r.end_line, r.depth, r.angle) for r in rows]
    # Neither the names and types nor the signs between them are sorted.
    assert not {"id", ":", "i64", "str", "&", "->", ".", "a", "x"} & {r.tok for r in rows}
    assert placed[:6] == [("struct", 3, 3, 0, 0), ("<", 3, 3, 0, 0), (">", 3, 3, 0, 1), ("{", 3, 3, 0, 0), ("}", 3, 3, 0, 0), ("fn", 4, 4, 0, 0)]
    at = {r.tok: r for r in rows}
    assert (at["call"].line, at["b"].line, at["h"].line, at["let"].line) == (8, 8, 9, 6)
    assert [(r.line, r.end_line) for r in rows if r.tok.startswith('"a')] == [(6, 7)]
    assert (at["call"].p1, at["call"].n1, at["b"].p1, at["h"].depth, at["y"].line) == (";", "(", ".", 2, 5)
    assert [(r.tok, r.p1, r.p2_named) for r in rows if r.p1 == "!"] == [("(", "!", True)]


def test_rust_symbols_and_calls_keep_their_lines(spark):
    found = extract(spark.createDataFrame([("a.rs", RUST)], "path string, content string"))
    assert sorted((r.kind, r.name, r.line_start, r.line_end, r.signature) for r in found.symbols.collect()) == [
        ("function", "f", 4, 10, "fn f((x: i64,\n    y: &str))"), ("struct", "S", 3, 3, "struct S"),
    ]
    assert [(r.source, r.target, r.line) for r in found.call_sites.collect()] == [("a.rs::f", "call", 8)]


TYPESCRIPT = '''import { a, b } from "./lib";
@Mark(c) export class Box<T> extends Base {
  first(x = (d, e), y = 1) { call<A<B, C>, D>(f.g); of<E; x = F >(h); }
}
function second<U extends (u: V) => W>(x: U, y: X) { return p?.q?.(r); }
'''

GO = '''package n
import "fmt"
type ( One struct { ID int } )
func (c One) Show(w int, f func(int) int) { New[int](w); xs[i] = c.d.e }
func New(v int) { fmt.Println(v) }
'''


def _placed(spark, lang, name, text):
    sources = spark.createDataFrame([(name, text)], "path string, content string")
    return tokens.significant(sources, lang, 2).orderBy("pos").collect(), extract(sources, (lang,))


def test_typescript_sorts_telling_tokens_only(spark):
    rows, found = _placed(spark, "typescript", "a.ts", TYPESCRIPT)
    assert not {r.tok for r in rows} & {"a", "b", "c", ",", "Base", "f", ".", "g", "C", "r", "x", "y"}
    # An equals sign bounds the arguments of the others.
    assert [r.tok for r in rows if r.generic] == ["call"]
    assert sorted((r.kind, r.name, r.line_start, r.line_end, r.signature) for r in found.symbols.collect()) == [
        ("class", "Box", 2, 4, "class Box"), ("function", "second", 5, 5, "function second((x: U, y: X))"),
        ("method", "first", 3, 3, "first((x = (d, e), y = 1))"),
    ]
    assert sorted((r.source, r.target, r.kind) for r in found.raw_edges.collect()) == [
        ("a.ts", "./lib", "imports"), ("a.ts::Box", "a.ts::first", "defines"), ("a.ts::first", "call", "calls"),
    ]


def test_go_sorts_telling_tokens_and_carries_lists_of_names_only(spark):
    rows, found = _placed(spark, "go", "a.go", GO)
    assert not {r.tok for r in rows} & {"n", "c", "ID", "int", "w", "f", "v", ".", ",", "fmt", "="}
    ahead = [(r.tok, "".join(r.ahead)) for r in rows if r.ahead is not None]
    # Behind a receiver the name carries the tokens; a list that holds others is not cut short.
    assert [tok for tok, _ in ahead] == ["Show", "func"]
    assert ahead[0][1].startswith("Show(w int, f func(int) int) {") and ahead[1][1] == "func New(v int)"
    assert sorted((r.kind, r.name, r.line_start, r.signature) for r in found.symbols.collect()) == [
        ("function", "New", 5, "func New((v int))"), ("method", "Show", 4, "func (r) Show((w int, f func(int) int))"),
        ("struct", "One", 3, "type One struct{...}"),
    ]
    assert [(r.target, r.kind) for r in found.raw_edges.orderBy("kind").collect()] == [("New", "calls"), ("fmt", "imports")]


def test_plain_parameter_lists_end_what_is_carried(spark):
    long = ", ".join(f"x{i}" for i in range(200))
    texts = {
        "plain": "(a, b)", "nested": "(a, b=(1, 2), c=f(3))", "angle": "(a=1 < 2, b=3)", "long": f"({long})",
        "string": '(a=")", b=2)', "wrong": "(a, b=[1)])",
    }
    content = "\n".join(f"def {name}{text}:\n    pass\n" + "pass\n" * 40 for name, text in texts.items())
    rows, found = _placed(spark, "python", "a.py", content)
    ahead = {r.n1: r.ahead for r in rows if r.tok == "def"}
    assert "".join(ahead["plain"]) == "def plain(a, b)" and "".join(ahead["string"]) == 'def string(a=")", b=2)'
    assert {len(ahead[name]) for name in ("nested", "angle", "long")} == {tokens.AHEAD}
    signatures = {r.name: r.signature for r in found.symbols.collect()}
    assert {n: signatures[n] for n in list(texts)[:5]} == {n: f"def {n}({t})" for n, t in list(texts.items())[:5]}
