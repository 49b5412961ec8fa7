"""Forms that real code has: calls inside strings, nesting without bound, unclosed brackets."""

import pytest
from pyspark.sql import functions as F

from cartograph.functions.text import language_of
from cartograph.operators.extract import extract
from cartograph.operators.tokens import token_stats

DEEP = "A<" * 12 + "B" + ">" * 12
WIDE = "F<" + ", ".join(f"T{i}" for i in range(300)) + ">"

FILES = {
    "python": {
        "f.py": '''\
def a(x):
    return f"{g(x)} and {h(x)!r} (not {{this(1)}}) {k(x):>{width(x)}}"
def b(x):
    y = rf\'\'\'one {
        many(x)
    } two it's {last(x)}\'\'\'
    after(y)
def c(x): 'short doc'
class D:
    def m(self): "inner"
    def n(self):
        call(f"plain (text")
''',
    },
    "typescript": {
        "t.ts": f"""\
function s(x) {{ return `a ${{g(x)}} it's }} ${{h(x)}} (z)`; }}
function deep(x) {{ {DEEP.replace("A<", "deepCall<", 1)}(2); if (x < y) {{ plain(x > (1)); }} }}
function wide(x) {{ {WIDE}(2); of(1, 2); async(3); for (const q of (xs)) {{ r(q); }} go(async (v) => w(v)); }}
function re(x) {{
  const p = /{"a" * 700}\\{{[{"b" * 300}}}]/;
  const q = wrap(
      /(odd"{{/);
}}
function next(x) {{ own(x); }}
@Injectable()
@Other
class Marked {{ @In() a; run() {{ one(1); }} }}
class Bare {{ }}
@Dec() export class Shown {{ }}
function open(x) {{
  lost(x);
function tail(x) {{ kept(x); }}
""",
    },
    "rust": {
        "r.rs": f"""\
fn a() {{ /* x /* y */ z( */ real(1); }}
fn b() {{ let s = r{"#" * 20}"{{ "# call(1) "{"#" * 20}; then(s); }}
fn z() {{ c(1); }}
""",
    },
    "go": {
        "g.go": """\
package n
func A(xs []int) { B[int](1); C[map[string]int](2); D[0](3); var m [3]int; e(m) }
type G[T any] struct { v T }
func H[T any](x T) { k(x) }
""",
    },
}


@pytest.fixture(scope="module")
def found(spark):
    def run(lang):
        rows = list(FILES[lang].items())
        out = extract(spark.createDataFrame(rows, "path string, content string"), (lang,))
        symbols = {(r["name"], r["kind"]): r for r in out.symbols.collect()}
        calls = {(r["source"].split("::")[1], r["target"]) for r in out.raw_edges.collect() if r["kind"] == "calls"}
        return symbols, calls

    return run


def test_python_interpolations_and_one_line_docs(found):
    symbols, calls = found("python")
    assert calls == {
        ("a", "g"), ("a", "h"), ("a", "k"), ("a", "width"), ("b", "many"), ("b", "last"), ("b", "after"), ("n", "call")
    }
    docs = {name: r["docstring"] for (name, _), r in symbols.items()}
    assert (docs["c"], docs["m"], docs["n"], docs["a"]) == ("'short doc'", '"inner"', None, None)
    lines = {name: (r["line_start"], r["line_end"]) for (name, _), r in symbols.items()}
    assert lines["a"] == (1, 2) and lines["b"] == (3, 7) and lines["D"] == (9, 12)


def test_typescript_without_bounds(found):
    symbols, calls = found("typescript")
    assert calls == {
        ("s", "g"), ("s", "h"), ("deep", "deepCall"), ("deep", "plain"), ("wide", "F"), ("wide", "of"),
        ("wide", "async"), ("wide", "r"), ("wide", "go"), ("wide", "w"), ("re", "wrap"), ("next", "own"),
        ("run", "one"), ("open", "lost"), ("tail", "kept"),
    }
    lines = {name: (r["line_start"], r["line_end"]) for (name, _), r in symbols.items()}
    assert lines["re"] == (4, 8) and lines["next"] == (9, 9)
    assert lines["Marked"] == (10, 12) and lines["Bare"] == (13, 13) and lines["Shown"] == (14, 14)
    assert lines["open"] == (15, 16) and lines["tail"] == (17, 17)


def test_rust_nested_comments_and_raw_strings(found):
    symbols, calls = found("rust")
    assert calls == {("a", "real"), ("b", "then"), ("z", "c")}
    assert {n for n, _ in symbols} == {"a", "b", "z"}


def test_go_type_arguments(found):
    symbols, calls = found("go")
    assert calls == {("A", "B"), ("A", "C"), ("A", "e"), ("H", "k")}
    assert {n for n, _ in symbols} == {"A", "G", "H"}


def test_token_stats_of_all_languages(spark):
    files = {
        "a.py": 'x = f"a{y}b{z}" \\\n  # c\n',
        "b.ts": "const p = `q${r}s`; // t\n",
        "c.rs": "fn f<'a>(s: &'a str) { r#\"x\"#; 'y'; /* z */ }",
        "d.go": "var r = `x`\n",
        "e.txt": "not a language",
        "f.go": "",
    }
    sources = spark.createDataFrame(list(files.items()), "path string, content string")
    rows = {r.path: r for r in token_stats(sources).collect()}
    # A file without a token has no row.
    assert set(rows) == {"a.py", "b.ts", "c.rs", "d.go"}
    assert {p: r.lang for p, r in rows.items()} == {
        "a.py": "python", "b.ts": "typescript", "c.rs": "rust", "d.go": "go"}
    assert {p: (r.strings, r.comments) for p, r in rows.items()} == {
        "a.py": (1, 1), "b.ts": (1, 1), "c.rs": (2, 1), "d.go": (1, 0)}
    # x = f"a{ y }b{ z }"
    assert rows["a.py"].significant_tokens == 7
    assert all(rows[p].chars == len(files[p]) for p in rows)
    assert all(rows[p].lines == files[p].count("\n") + 1 for p in rows)


def test_language_of_cuts_the_extension_once(spark):
    # The filter on the language runs over every row of every corpus.
    paths = ["a/b.py", "c.tsx", "d.jsx", "e.rs", "f.go", "g.md", ".py", "h", None]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", language_of(F.col("path")).alias("lang"))
    assert [r[1] for r in rows.collect()] == ["python", "typescript", "typescript", "rust", "go", None, None, None, None]
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_extract(") == 1
