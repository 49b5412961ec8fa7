"""Catalog entries for discovery, extraction and indexing (listing L and the rendered corpora).

The SQL twins compute the expected symbols and edges from the tables, never from the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.operators import lookup, tokens
from cartograph.operators.extract import Extraction, extract
from cartograph.plans import corpora, derived, incremental, index
from cartograph.plans.catalog import query
from cartograph.plans.derived import LISTING_FOLDERS, LISTING_SUFFIXES, Tables
from cartograph.session import new_path, stage
from cartograph.sources import discovery
from cartograph.streaming import reindex

# ---------------------------------------------------------------- listing

_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
L_SQL = f"""WITH listing AS (SELECT p_partkey AS k, p_partkey % 6 AS d, p_partkey % 9 AS e,
  'src/' || ({_LIST(LISTING_FOLDERS)})[p_partkey % 6 + 1] || '/f' || p_partkey || '.' ||
  ({_LIST(LISTING_SUFFIXES)})[p_partkey % 9 + 1] AS path FROM part)
"""


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    return derived.listing(Tables(spark, sf))


@query("ext_filter", L_SQL + "SELECT path FROM listing WHERE e < 7")
def ext_filter(spark, sf):
    return _listing(spark, sf).where(discovery.supported(F.col("path")))


@query("scope_filter", L_SQL + "SELECT path FROM listing WHERE d IN (3, 5)")
def scope_filter(spark, sf):
    return _listing(spark, sf).where(discovery.in_scope(F.col("path"), "src/core"))


@query("skip_dirs", L_SQL + "SELECT path FROM listing WHERE d NOT IN (2, 4)")
def skip_dirs(spark, sf):
    return _listing(spark, sf).where(discovery.outside_skip_dirs(F.col("path")))


@query("lang_dispatch", L_SQL + """
SELECT path, CASE WHEN e = 0 THEN 'python' WHEN e IN (1, 2, 4, 5) THEN 'typescript'
  WHEN e = 3 THEN 'rust' WHEN e = 6 THEN 'go' END AS lang FROM listing""")
def lang_dispatch(spark, sf):
    return discovery.with_language(_listing(spark, sf))


@query("extract_status", L_SQL + """
SELECT path, CASE WHEN e = 0 THEN 'python' WHEN e IN (1, 2, 4, 5) THEN 'typescript'
  WHEN e = 3 THEN 'rust' WHEN e = 6 THEN 'go' END AS lang,
  CASE WHEN e < 7 THEN 'ok' ELSE 'unsupported extension' END AS status FROM listing""")
def extract_status(spark, sf):
    return index.extract_status(_listing(spark, sf))


# The ignore lines of the example, (folder, line).
IGNORE_LINES = (
    ("", "# generated"), ("", "*.jsx"), ("", "node_modules/"), ("", "/src/core/f1*.rs"),
    ("", "f?.py"), ("src/core", "*.rs"), ("src/core", "!node/*.rs"), ("src", "!f1*.jsx"),
)


@query("ignore_rules", L_SQL + """
SELECT path FROM listing WHERE NOT (
  d = 2
  OR (e = 4 + 1 AND NOT starts_with('f' || k, 'f1'))
  OR (e = 0 AND k < 10)
  OR (d = 3 AND e = 3))""")
def ignore_rules(spark, sf):
    rows = [(folder, n, line) for n, (folder, line) in enumerate(IGNORE_LINES)]
    lines = spark.createDataFrame(rows, "dir string, line_no int, line string")
    return discovery.drop_ignored(_listing(spark, sf), discovery.parse_ignore_rules(lines))


@query("utf8_quarantine", """
SELECT 'doc/' || doc_id || '.py' AS path, CASE WHEN doc_id % 7 = 0 THEN 'not UTF-8' ELSE 'ok' END AS status,
  CAST(CASE WHEN doc_id % 7 = 0 THEN octet_length(encode(text)) + 1 ELSE octet_length(encode(text)) END AS BIGINT) AS length
FROM documents""")
def utf8_quarantine(spark, sf):
    """Whole document texts as file contents, every seventh with a byte that is not UTF-8."""
    raw = F.encode("text", "UTF-8")
    broken = F.concat(raw, F.unhex(F.lit("FF")))
    files = Tables(spark, sf).documents.select(
        F.concat(F.lit("doc/"), "doc_id", F.lit(".py")).alias("path"),
        F.when(F.col("doc_id") % 7 == 0, broken).otherwise(raw).alias("content"),
    )
    good, bad = discovery.split_text(files)
    return good.select(
        "path", F.lit("ok").alias("status"), F.octet_length("content").cast("long").alias("length")
    ).unionByName(bad.select("path", F.col("reason").alias("status"), "length"))


# ---------------------------------------------------------------- corpora

_found: dict[tuple[str, str, str], Extraction] = {}
_staged: dict[tuple[str, str, str, str], DataFrame] = {}


def _extracted(spark: SparkSession, sf: str, lang: str) -> Extraction:
    """Extraction of one language's files of all corpora; its facts are staged once per application and scale."""
    key = (spark.sparkContext.applicationId, sf, lang)
    if key not in _found:
        _found[key] = extract(corpora.everything(Tables(spark, sf)), (lang,))
    return _found[key]


def corpus(spark: SparkSession, sf: str, lang: str, part: str) -> DataFrame:
    """The symbols or raw edges of one language, staged by the first query that reads them, as an index is."""
    key = (spark.sparkContext.applicationId, sf, lang, part)
    if key not in _staged:
        _staged[key] = stage(getattr(_extracted(spark, sf, lang), part), part).df
    return _staged[key]


def all_corpora(spark: SparkSession, sf: str) -> Extraction:
    """The extractions of all languages, one below the other."""
    each = [
        _extracted(spark, sf, lang)._replace(**{part: corpus(spark, sf, lang, part) for part in ("symbols", "raw_edges")})
        for lang in tokens.ALL_LANGUAGES
    ]
    return Extraction(*(reduce(DataFrame.unionByName, frames) for frames in zip(*each)))


_COLUMNS = ("id", "name", "kind", "file_path", "line_start", "line_end", "signature", "docstring")


def _kind(lang: str, kind: str):
    def run(spark, sf):
        return corpus(spark, sf, lang, "symbols").where(F.col("kind") == kind).select(*_COLUMNS)

    return run


def _edges(lang: str, kind: str):
    def run(spark, sf):
        return corpus(spark, sf, lang, "raw_edges").where(F.col("kind") == kind).select("source", "target", "kind")

    return run


def _symbol_sql(table: str, key: str, path: str, name: str, kind: str, first: int, step: int,
                start: int, end: int, sig: str, doc: str = "CAST(NULL AS VARCHAR)") -> str:
    """One symbol per row: ``first + step * (key mod 40)`` is the first line of the row's text."""
    base = f"{first} + {step} * ({key} % 40)"
    return f"""SELECT {path} || '::' || {name} AS id, {name} AS name, '{kind}' AS kind, {path} AS file_path,
  CAST({base} + {start} AS BIGINT) AS line_start, CAST({base} + {end} AS BIGINT) AS line_end,
  {sig} AS signature, {doc} AS docstring FROM {table}"""


_PY_F = "'src/py/parts/m' || (p_partkey // 40) || '.py'"
_PY_C = "'src/py/sup/m' || (s_suppkey // 40) || '.py'"
_TS = "'src/ts/m' || (s_suppkey // 40) || '.' || (['ts', 'tsx', 'js', 'jsx'])[(s_suppkey // 40) % 4 + 1]"
_RS = "'src/rs/m' || (o_orderkey // 40) || '.rs'"
_GO = "'src/go/m' || (c_custkey // 40) || '.go'"

_PY_FUNCTION = _symbol_sql(
    "part", "p_partkey", _PY_F, "'part_' || p_partkey", "function", 4, 5, 0, 3,
    "'def part_' || p_partkey || '((size, price))'", "'\"\"\"' || p_name || '\"\"\"'")
_PY_METHOD = _symbol_sql(
    "supplier", "s_suppkey", _PY_C, "'ping_' || s_suppkey", "method", 1, 5, 2, 3,
    "'def ping_' || s_suppkey || '((self, x))'")
_PY_CLASS = _symbol_sql(
    "supplier", "s_suppkey", _PY_C, "'Sup_' || s_suppkey", "class", 1, 5, 0, 3, "'class Sup_' || s_suppkey")
_TS_FUNCTION = _symbol_sql(
    "supplier", "s_suppkey", _TS, "'make_' || s_suppkey", "function", 3, 6, 0, 2,
    "'function make_' || s_suppkey || '((x))'")
_TS_CLASS = _symbol_sql(
    "supplier", "s_suppkey", _TS, "'Sup_' || s_suppkey", "class", 3, 6, 3, 5, "'class Sup_' || s_suppkey")
_TS_METHOD = _symbol_sql(
    "supplier", "s_suppkey", _TS, "'run_' || s_suppkey", "method", 3, 6, 4, 4, "'run_' || s_suppkey || '((a, b))'")
_RS_FUNCTION = _symbol_sql(
    "orders", "o_orderkey", _RS, "'load_' || o_orderkey", "function", 1, 4, 1, 3,
    "'fn load_' || o_orderkey || '((id: i64))'")
_RS_STRUCT = _symbol_sql(
    "orders", "o_orderkey", _RS, "'Ord_' || o_orderkey", "struct", 1, 4, 0, 0, "'struct Ord_' || o_orderkey")
_GO_STRUCT = _symbol_sql(
    "customer", "c_custkey", _GO, "'Cust_' || c_custkey", "struct", 4, 5, 0, 0,
    "'type Cust_' || c_custkey || ' struct{...}'")
_GO_METHOD = _symbol_sql(
    "customer", "c_custkey", _GO, "'Show_' || c_custkey", "method", 4, 5, 1, 1,
    "'func (r) Show_' || c_custkey || '((w int))'")
_GO_FUNCTION = _symbol_sql(
    "customer", "c_custkey", _GO, "'New_' || c_custkey", "function", 4, 5, 2, 2,
    "'func New_' || c_custkey || '((v int))'")
_GO_IFACE = _symbol_sql(
    "customer", "c_custkey", _GO, "'Shower_' || c_custkey", "interface", 4, 5, 3, 3,
    "'type Shower_' || c_custkey || ' interface{...}'")


def _edge_sql(table: str, source: str, target: str, kind: str) -> str:
    return f"SELECT DISTINCT {source} AS source, {target} AS target, '{kind}' AS kind FROM {table}"


_NPART, _NSUP = "(SELECT count(*) FROM part)", "(SELECT count(*) FROM supplier)"
_PY_CALLS = (
    _edge_sql("part", f"{_PY_F} || '::part_' || p_partkey", f"'part_' || ((p_partkey * 7 + 3) % {_NPART})", "calls")
    + " UNION ALL "
    + _edge_sql("supplier", f"{_PY_C} || '::ping_' || s_suppkey", "'part_0'", "calls")
)
_PY_DEFINES = _edge_sql(
    "supplier", f"{_PY_C} || '::Sup_' || s_suppkey", f"{_PY_C} || '::ping_' || s_suppkey", "defines")
_PY_IMPORTS = (
    _edge_sql("part", _PY_F, "'os.path'", "imports") + " UNION ALL " + _edge_sql("part", _PY_F, "'item'", "imports")
)
_TS_CALLS = (
    _edge_sql("supplier", f"{_TS} || '::make_' || s_suppkey", f"'helper_' || ((s_suppkey + 1) % {_NSUP})", "calls")
    + " UNION ALL "
    + _edge_sql("supplier", f"{_TS} || '::run_' || s_suppkey", "'make_' || s_suppkey", "calls")
)
_TS_DEFINES = _edge_sql(
    "supplier", f"{_TS} || '::Sup_' || s_suppkey", f"{_TS} || '::run_' || s_suppkey", "defines")
_TS_IMPORTS = _edge_sql("supplier", _TS, "'./lib_' || (s_suppkey // 40)", "imports")
_RS_CALLS = _edge_sql("orders", f"{_RS} || '::load_' || o_orderkey", "'check_' || (o_orderkey % 10)", "calls")
_GO_CALLS = _edge_sql("customer", f"{_GO} || '::Show_' || c_custkey", "'New_' || c_custkey", "calls")
_GO_IMPORTS = _edge_sql("customer", _GO, "'fmt'", "imports")

for _name, _sql, _fn in (
    ("py_functions", _PY_FUNCTION, _kind("python", "function")),
    ("py_classes", _PY_CLASS, _kind("python", "class")),
    ("py_methods", _PY_METHOD, _kind("python", "method")),
    ("py_defines", _PY_DEFINES, _edges("python", "defines")),
    ("py_calls", _PY_CALLS, _edges("python", "calls")),
    ("py_imports", _PY_IMPORTS, _edges("python", "imports")),
    ("ts_functions", _TS_FUNCTION, _kind("typescript", "function")),
    ("ts_classes", _TS_CLASS, _kind("typescript", "class")),
    ("ts_methods", _TS_METHOD, _kind("typescript", "method")),
    ("ts_defines", _TS_DEFINES, _edges("typescript", "defines")),
    ("ts_calls", _TS_CALLS, _edges("typescript", "calls")),
    ("ts_imports", _TS_IMPORTS, _edges("typescript", "imports")),
    ("rs_functions", _RS_FUNCTION, _kind("rust", "function")),
    ("rs_structs", _RS_STRUCT, _kind("rust", "struct")),
    ("rs_calls", _RS_CALLS, _edges("rust", "calls")),
    ("go_functions", _GO_FUNCTION, _kind("go", "function")),
    ("go_methods", _GO_METHOD, _kind("go", "method")),
    ("go_structs", _GO_STRUCT, _kind("go", "struct")),
    ("go_interfaces", _GO_IFACE, _kind("go", "interface")),
    ("go_calls", _GO_CALLS, _edges("go", "calls")),
    ("go_imports", _GO_IMPORTS, _edges("go", "imports")),
):
    query(_name, _sql)(_fn)


@query("py_docstrings", f"SELECT {_PY_F} || '::part_' || p_partkey AS id, '\"\"\"' || p_name || '\"\"\"' AS docstring FROM part")
def py_docstrings(spark, sf):
    # Only declarations of Python have one.
    return corpus(spark, sf, "python", "symbols").where("docstring IS NOT NULL").select("id", "docstring")


@query("call_sites", f"""
SELECT {_PY_F} || '::part_' || p_partkey AS source, 'part_' || ((p_partkey * 7 + 3) % {_NPART}) AS target,
  {_PY_F} AS file_path, CAST(4 + 5 * (p_partkey % 40) + 2 AS BIGINT) AS line FROM part
UNION ALL SELECT {_PY_C} || '::ping_' || s_suppkey, 'part_0', {_PY_C}, CAST(1 + 5 * (s_suppkey % 40) + 3 AS BIGINT)
FROM supplier
UNION ALL SELECT {_TS} || '::make_' || s_suppkey, 'helper_' || ((s_suppkey + 1) % {_NSUP}), {_TS},
  CAST(4 + 6 * (s_suppkey % 40) AS BIGINT) FROM supplier
UNION ALL SELECT {_TS} || '::run_' || s_suppkey, 'make_' || s_suppkey, {_TS}, CAST(7 + 6 * (s_suppkey % 40) AS BIGINT)
FROM supplier
UNION ALL SELECT {_RS} || '::load_' || o_orderkey, 'check_' || (o_orderkey % 10), {_RS},
  CAST(3 + 4 * (o_orderkey % 40) AS BIGINT) FROM orders
UNION ALL SELECT {_GO} || '::Show_' || c_custkey, 'New_' || c_custkey, {_GO}, CAST(5 + 5 * (c_custkey % 40) AS BIGINT)
FROM customer""")
def call_sites(spark, sf):
    """Every call with its line: the detail behind the call edges."""
    # Neither the symbols nor the edges without lines are needed for it.
    sites = (_extracted(spark, sf, lang).call_sites for lang in tokens.ALL_LANGUAGES)
    return reduce(DataFrame.unionByName, sites).select("source", "target", "file_path", "line")


# Per corpus: language, table, key, path, header, text of a row, and the significant tokens, strings
# and comments of a row and of the header. The texts are written out once more in SQL.
_LONG_TYPES = ", ".join(f"T{i}" for i in range(300))
_PY_ROW = f"""'def part_' || p_partkey || '(size, price):' || chr(10) || '    \"\"\"' || p_name || '\"\"\"' || chr(10)
  || '    part_' || ((p_partkey * 7 + 3) % {_NPART}) || '(size)' || chr(10)
  || '    obj.skip_' || p_partkey || '(price)  # gone(1)' || chr(10)"""
_PY_CLASS_ROW = """'class Sup_' || s_suppkey || ':' || chr(10) || '    \"\"\"doc\"\"\"' || chr(10)
  || '    def ping_' || s_suppkey || '(self, x):' || chr(10) || '        f\"it''s {part_0(x)}\"' || chr(10)"""
_TS_ROW = f"""'function make_' || s_suppkey || '(x) {{' || chr(10)
  || '  `it''s ${{helper_' || ((s_suppkey + 1) % {_NSUP}) || '(x)}} }} (`; new Box(x); const p = /{"a" * 600}\\{{/;' || chr(10)
  || '}}' || chr(10) || 'class Sup_' || s_suppkey || ' {{' || chr(10) || '  run_' || s_suppkey || '(a, b) {{ make_'
  || s_suppkey || '<A<B<C<D<E>>>>, {_LONG_TYPES}>(a); }}' || chr(10) || '}}'"""
_RS_ROW = """'struct Ord_' || o_orderkey || ' { id: i64 }' || chr(10) || 'fn load_' || o_orderkey || '(id: i64) -> i64 {'
  || chr(10) || '    check_' || (o_orderkey % 10) || '(id); /* a /* b */ gone( */ std::mem::drop(id); println!(\"load_'
  || o_orderkey || '(0)\")' || chr(10) || '}'"""
_GO_ROW = """'type Cust_' || c_custkey || ' struct { ID int }' || chr(10) || 'func (c Cust_' || c_custkey || ') Show_'
  || c_custkey || '(w int) { New_' || c_custkey || '[int](w) }' || chr(10) || 'func New_' || c_custkey
  || '(v int) { fmt.Println(v) }' || chr(10) || 'type Shower_' || c_custkey || ' interface { Show(w int) }' || chr(10)"""
_STATS = " UNION ALL ".join(
    f"""
SELECT path, '{lang}' AS lang, CAST({tokens_head} + {tokens_row} * count(*) AS BIGINT) AS significant_tokens,
  CAST({strings_head} + {strings_row} * count(*) AS BIGINT) AS strings,
  CAST({comments_row} * count(*) AS BIGINT) AS comments,
  CAST(any_value(length(head)) + sum(length(body)) + count(*) - 1 AS BIGINT) AS chars,
  CAST(any_value(length(head) - length(replace(head, chr(10), '')))
    + sum(length(body) - length(replace(body, chr(10), ''))) + count(*) AS BIGINT) AS lines
FROM (SELECT {path} AS path, {head} AS head, {body} AS body FROM {table}) GROUP BY path"""
    for lang, table, path, head, body, tokens_head, tokens_row, strings_head, strings_row, comments_row in (
        ("python", "part", _PY_F, "'import os.path' || chr(10) || 'from pkg import item' || chr(10) || chr(10)",
         _PY_ROW, 8, 19, 0, 1, 1),
        ("python", "supplier", _PY_C, "''", _PY_CLASS_ROW, 0, 18, 0, 2, 0),
        ("typescript", "supplier", _TS,
         "'import { ping } from \"./lib_' || (s_suppkey // 40) || '\";' || chr(10) || chr(10)", _TS_ROW, 7, 657, 1, 1, 0),
        ("rust", "orders", _RS, "''", _RS_ROW, 0, 37, 0, 1, 1),
        ("go", "customer", _GO, "'package n' || chr(10) || 'import \"fmt\"' || chr(10) || chr(10)", _GO_ROW, 4, 50, 1, 0, 0),
    )
)


@query("token_stats", _STATS)
def token_stats(spark, sf):
    """Per file of all four languages: tokens that carry meaning, strings, comments, and the totals of all tokens."""
    return tokens.token_stats(corpora.everything(Tables(spark, sf)))


_SUMMARY = " UNION ALL ".join(
    f"SELECT '{lang}' AS lang, {files} AS files, {symbols} AS symbols, {edges} AS raw_edges"
    for lang, files, symbols, edges in (
        ("python", f"(SELECT count(DISTINCT {_PY_F}) FROM part) + (SELECT count(DISTINCT {_PY_C}) FROM supplier)",
         f"{_NPART} + 2 * {_NSUP}",
         f"(SELECT count(*) FROM ({_PY_CALLS})) + {_NSUP} + 2 * (SELECT count(DISTINCT {_PY_F}) FROM part)"),
        ("typescript", f"(SELECT count(DISTINCT {_TS}) FROM supplier)", f"3 * {_NSUP}",
         f"3 * {_NSUP} + (SELECT count(DISTINCT {_TS}) FROM supplier)"),
        ("rust", f"(SELECT count(DISTINCT {_RS}) FROM orders)", "2 * (SELECT count(*) FROM orders)",
         "(SELECT count(*) FROM orders)"),
        ("go", f"(SELECT count(DISTINCT {_GO}) FROM customer)", "4 * (SELECT count(*) FROM customer)",
         f"(SELECT count(*) FROM customer) + (SELECT count(DISTINCT {_GO}) FROM customer)"),
    )
)


@query("extract_summary", _SUMMARY)
def extract_summary(spark, sf):
    return index.extract_summary(corpora.everything(Tables(spark, sf)), all_corpora(spark, sf))


@query("find_definition", f"""
SELECT {_PY_F} || '::part_' || p_partkey AS id, 'part_' || p_partkey AS name, 'function' AS kind, {_PY_F} AS file_path,
  CAST(4 + 5 * (p_partkey % 40) AS BIGINT) AS line_start, CAST(7 + 5 * (p_partkey % 40) AS BIGINT) AS line_end,
  'def part_' || p_partkey || '(size, price):' || chr(10) || '    \"\"\"' || p_name || '\"\"\"' || chr(10)
  || '    part_' || ((p_partkey * 7 + 3) % {_NPART}) || '(size)' || chr(10)
  || '    obj.skip_' || p_partkey || '(price)  # gone(1)' AS text
FROM part WHERE p_partkey = 57""")
def find_definition(spark, sf):
    sources = corpora.c_py(Tables(spark, sf))
    return lookup.find_definition(
        corpus(spark, sf, "python", "symbols"), sources, "src/py/parts/m1.py::part_57"
    )


@query("discover_files", """
SELECT 'm=' || (c_custkey // 40) AS folder, CAST(1 AS BIGINT) AS files FROM customer GROUP BY ALL""")
def discover_files(spark, sf):
    """The Go corpus written as a directory tree of text files, then listed without reading them."""
    root = new_path(spark, "tree")
    texts = corpora.c_go(Tables(spark, sf)).select(
        F.regexp_extract("path", r"/m(\d+)\.go$", 1).alias("m"), "content"
    )
    texts.write.partitionBy("m").text(root)
    found = discovery.discover(spark, root, suffixes=("txt",))
    return found.groupBy(F.regexp_extract("path", r"^(m=\d+)/", 1).alias("folder")).agg(
        F.count(F.lit(1)).alias("files")
    )


# ---------------------------------------------------------------- whole pipeline

# Every corpus at once: the call to ``make_`` and ``New_`` resolve in their file, ``part_`` by name.
_FULL = f"""
SELECT DISTINCT source_id, target_id, kind FROM (
  SELECT {_PY_F} || '::part_' || p_partkey AS source_id,
    'src/py/parts/m' || (((p_partkey * 7 + 3) % {_NPART}) // 40) || '.py::part_' || ((p_partkey * 7 + 3) % {_NPART}) AS target_id,
    'calls' AS kind FROM part
  UNION ALL SELECT {_PY_C} || '::ping_' || s_suppkey, 'src/py/parts/m0.py::part_0', 'calls' FROM supplier
  UNION ALL SELECT * FROM ({_PY_DEFINES})
  UNION ALL SELECT {_TS} || '::run_' || s_suppkey, {_TS} || '::make_' || s_suppkey, 'calls' FROM supplier
  UNION ALL SELECT * FROM ({_TS_DEFINES})
  UNION ALL SELECT {_GO} || '::Show_' || c_custkey, {_GO} || '::New_' || c_custkey, 'calls' FROM customer)"""


@query("full_index", _FULL)
def full_index(spark, sf):
    """All corpora in one pass through the whole pipeline, read back from the store."""
    sources = corpora.everything(Tables(spark, sf))
    return index.index_sources(sources, new_path(spark, "index"), "/project").edges


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """Go files in two arrivals, with the time of each version.

    In the second the even files call another function, of every third file an older version comes
    late, and every fifth file is deleted; an older version of it comes late too.
    """
    texts = corpora.c_go(Tables(spark, sf))
    m = F.regexp_extract("path", r"/m(\d+)\.go$", 1).cast("long")
    longer = F.regexp_replace(
        "content", r"\{ New_(\d+)\[int\]\(w\) \}", "{ New_$1(w); Missing_$1(w); Show_$1(w) }"
    )

    def arrive(rows: DataFrame, content: Column, modified: int, arrival: int) -> DataFrame:
        return rows.select(
            "path", content.alias("content"), F.lit(modified).cast("long").alias("modified"), F.lit(arrival).alias("arrival")
        )

    old = F.lit("package n\nfunc Old(w int) { Old(w) }\n")
    return (
        arrive(texts, F.col("content"), 2, 1)
        .unionByName(arrive(texts.where(m % 2 == 0), longer, 3, 2))
        .unionByName(arrive(texts.where(m % 3 == 0), old, 1, 2))
        .unionByName(arrive(texts.where(m % 5 == 4), F.lit(None).cast("string"), 4, 2))
        .unionByName(arrive(texts.where(m % 5 == 4), old, 1, 3))
    )


@query("stream_reindex", f"""
SELECT {_GO} || '::Show_' || c_custkey AS source_id, {_GO} || '::New_' || c_custkey AS target_id, 'calls' AS kind
FROM customer WHERE (c_custkey // 40) % 5 <> 4
UNION ALL SELECT {_GO} || '::Show_' || c_custkey, {_GO} || '::Show_' || c_custkey, 'calls' FROM customer
WHERE (c_custkey // 40) % 2 = 0 AND (c_custkey // 40) % 5 <> 4""")
def stream_reindex(spark, sf):
    """Three arrivals of file versions through the stream; the store after the last batch."""
    versions, base, mark = (new_path(spark, x) for x in ("versions", "stream", "offsets"))
    rows = stage(_versions(spark, sf), "versions").df
    for arrival in (1, 2, 3):
        rows.where(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(versions)
        reindex.start(spark, versions, base, mark).awaitTermination()
    return reindex.latest(spark, base).edges


@query("scoped_reindex", f"""
SELECT 'symbol' AS what, {_PY_F} || '::part_' || p_partkey AS a, 'function' AS b FROM part
UNION ALL SELECT 'symbol', {_PY_C} || '::Sup_' || s_suppkey, 'class' FROM supplier WHERE (s_suppkey // 40) % 2 = 1
UNION ALL SELECT 'symbol', {_PY_C} || '::pong_' || s_suppkey, 'method' FROM supplier WHERE (s_suppkey // 40) % 2 = 1
UNION ALL SELECT 'calls', {_PY_F} || '::part_' || p_partkey,
  'src/py/parts/m' || (((p_partkey * 7 + 3) % {_NPART}) // 40) || '.py::part_' || ((p_partkey * 7 + 3) % {_NPART}) FROM part
UNION ALL SELECT 'calls', {_PY_C} || '::pong_' || s_suppkey, 'src/py/parts/m0.py::part_0' FROM supplier
WHERE (s_suppkey // 40) % 2 = 1
UNION ALL SELECT 'defines', {_PY_C} || '::Sup_' || s_suppkey, {_PY_C} || '::pong_' || s_suppkey FROM supplier
WHERE (s_suppkey // 40) % 2 = 1""")
def scoped_reindex(spark, sf):
    """One folder is indexed again: every second file is gone, and the others' methods renamed."""
    texts = corpora.c_py(Tables(spark, sf))
    before = incremental.create(spark, texts, new_path(spark, "versions"))
    odd = F.regexp_extract("path", r"/m(\d+)\.py$", 1).cast("long") % 2 == 1
    now = texts.where(odd).withColumn("content", F.replace("content", F.lit("ping_"), F.lit("pong_")))
    after = incremental.as_index(incremental.replace_scope(before, now, "src/py/sup"))
    return after.symbols.select(F.lit("symbol").alias("what"), F.col("id").alias("a"), F.col("kind").alias("b")).unionByName(
        after.edges.select(F.col("kind").alias("what"), F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    )
