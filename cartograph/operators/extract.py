"""Token table to symbols and raw edges.

Of each declaration, call and import one compact row is kept, the *facts*. Those of Python, Rust and
Go are read file by file (see ``files``); those of TypeScript by windows over the token table: mark
declarations, pair brackets to blocks, and find what encloses them. The facts are staged once; symbols
and edges are cheap selections and one containment join over them.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cartograph.functions.lexis import is_string
from cartograph.operators import golang, python, rust
from cartograph.operators.files import FAR, read_facts
from cartograph.operators.tokens import (
    ALL_LANGUAGES,
    before_row,
    by_language,
    dealt,
    in_order,
    prepare,
    significant,
)
from cartograph.schema import RAW_EDGES, SYMBOLS
from cartograph.session import stage

# Words that are never the name of a called function of TypeScript.
KEYWORDS = (
    "if for while switch catch return typeof instanceof in new delete void throw case do "
    "else function class extends super import await yield this with const let var"
).split()

# A token after which an operand follows, so ``function`` or ``class`` is an expression.
OPERAND_FOLLOWS = (
    "= ( , : ? [ => ! && || ?? & | ^ ~ + - * / % < > <= >= == === != !== . ?. ... return typeof void "
    "new delete await yield throw case in of instanceof extends"
).split()

# What may stand before a method name in a class body.
BEFORE_METHOD = (
    "{ } ; , ) * get set static async public private protected override readonly declare abstract"
).split()

# Before a brace that opens a type or an object, not a body.
BEFORE_TYPE_BRACE = ": | & < , = => ( extends is keyof ?".split()

# Statements that can look like ``name(...) {`` outside the direct level of a class body.
_CONTROL = ("if", "for", "while", "switch", "catch", "with", "function")

_FUNCTIONS = ("py_def", "ts_func", "ts_method", "rs_fn", "go_func", "go_method")
_CLASSES = ("py_class", "ts_class")

_c = F.col


def _in(col: str | Column, values) -> Column:
    """Membership that is false for null. A column name makes one SQL expression of it."""
    if isinstance(col, str):
        listed = ", ".join(f"'{v}'" for v in values)
        return F.expr(f"coalesce({col} IN ({listed}), false)")
    return F.coalesce(col.isin(*values), F.lit(False))


def _is(col: str, value: str) -> Column:
    """Equality that is false for null."""
    return F.expr(f"{col} <=> '{value}'")


def _last(condition: Column, value: Column, over: WindowSpec) -> Column:
    return F.last(F.when(condition, value), ignorenulls=True).over(over)


# ------------------------------------------------------------------ marks and heads


def _marks(rows: DataFrame) -> DataFrame:
    """The latest keyword that decides how later tokens read, and the decorators before a class."""
    tok = _c("tok")
    marked = (_in("tok", ("import", "export")) & ~_is("p1", ".")) | (_is("n1", "<") & _c("named"))
    so_far = in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The first decorator since the last statement or member ended, at the same depth.
    level = Window.partitionBy("path", "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    bounds = _in("tok", ("@", ";", "{", "}", "class"))
    first = _in("tok", (";", "{", "}", "class")) | ((tok == "@") & ~_is("since", "@"))
    return rows.withColumn("since", _last(bounds, tok, level)).select(
        "*",
        _last(marked, F.struct("pos", "line", "tok", "depth", "angle"), so_far).alias("mark"),
        _last(first, F.struct("tok", "line"), level).alias("decorator"),
    )


def _head() -> Column:
    """The sort of declaration that starts at a token."""
    tok, named = _c("tok"), _c("n1_named")
    before = F.when(_is("p1", "async"), _c("p2")).otherwise(_c("p1"))
    statement = ~_in(before, OPERAND_FOLLOWS)
    first_on_line = F.coalesce(_c("line") > _c("p1_end_line"), F.lit(False))
    return (
        F.when((tok == "function") & named & statement, "ts_func")
        .when(
            (tok == "class")
            & named
            & ~_in("n1", ("extends", "implements"))
            & statement
            & ~_is("p1", "abstract"),
            "ts_class",
        )
        .when(
            _in("n1", "(<")
            & _c("named")
            & (_in("p1", BEFORE_METHOD) | (first_on_line & ~_in("p1", OPERAND_FOLLOWS))),
            "ts_method",
        )
    )


def _name_and_line() -> tuple[Column, Column]:
    """Name and first line of the declaration that starts here, if one does."""
    tok = _c("tok")
    name = F.when(_in("tok", ("function", "class")) & _c("n1_named"), _c("n1")).otherwise(tok)
    decorated = (tok == "class") & _is("decorator.tok", "@") & (_is("p1", ")") | _c("p1_named"))
    line = (
        F.when(_is("p1", "async"), _c("p1_line"))
        .when(decorated & ~_in("p1", ("export", "default", "declare")), _c("decorator.line"))
        .otherwise(_c("line"))
    )
    return name, line


def _call_and_import() -> tuple[Column, Column]:
    """Whether a token is a plain name that is called, and whether it is part of an import."""
    tok, no = _c("tok"), F.lit(False)
    called = _is("n1", "(") & _c("named")
    call = (
        (called | _c("generic") | (_c("named") & _is("n1", "?.") & _is("n2", "(")))
        & ~_in("p1", (".", "?.", "new", "function"))
        & ~(_is("p1", "*") & _is("p2", "function"))
        # Between an operand and another ``of`` is a keyword.
        & ~((tok == "of") & (F.coalesce(_c("p1_named"), no) | _in("p1", ("]", "}"))))
        & ~_in("tok", KEYWORDS)
    )
    imports = ~_c("named") & (
        (_is("p1", "from") & _is("mark.tok", "import")) | _is("p1", "import")
    ) & is_string(tok)
    return F.coalesce(call, no), F.coalesce(imports, no)


def _classified(rows: DataFrame) -> DataFrame:
    """The rows that blocks, calls and imports are made of, neighbours reduced to flags."""
    tok, n1 = _c("tok"), _c("n1")
    no = F.lit(False)
    # A cheap test on the token itself; the exact conditions are evaluated for these rows only.
    words = (
        _in("tok", ("function", "class")) | _is("n1", "<") | _is("n1", "?.") | _in("p1", ("from", "import"))
    )
    rows = rows.where(_in("tok", ("(", ")", "[", "]", "{", "}", ";")) | _is("n1", "(") | words)
    name, start_line = _name_and_line()
    call, imported = _call_and_import()
    in_generics = F.coalesce(
        (_c("mark.depth") == _c("depth")) & (_c("angle") > _c("mark.angle")), no
    )
    columns = {
        "head": _head(),
        "name": name,
        "start_line": start_line,
        "call": call,
        "imported": imported,
        "body": (tok == "{") & ~_in("p1", BEFORE_TYPE_BRACE),
        "list": (tok == "(") & ~in_generics,
        "then": F.when(_in("tok", (")", "]")), n1),
        "stmt": _c("mark.pos"),
    }
    kept = ["path", "pos", "tok", "line", "end_line", "depth", "ahead"]
    return rows.select(*kept, *[c.alias(n) for n, c in columns.items()])


# ------------------------------------------------------------------ blocks


def _following(*keys: str) -> WindowSpec:
    """Rows after the current one, nearest last: a running frame over descending order."""
    return (
        Window.partitionBy("path", *keys[:-1])
        .orderBy(F.desc(keys[-1]))
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _brackets(rows: DataFrame) -> DataFrame:
    """Parameter lists and bodies by bracket depth.

    Both windows share one partitioning and order, so they cost one sort. A bracket's pair is the
    nearest closing one after it at its depth. ``stop`` is the nearest body, ``;`` or declaration.
    """
    tok, head = _c("tok"), _c("head")
    after = _following("depth", "pos")
    pair = F.struct("pos", _c("end_line").alias("line"), "then")
    paired = rows.select("*", _last(_in("tok", (")", "]", "}")), pair, after).alias("pair"))
    stop = F.struct(
        F.when(head.isNotNull(), "head").otherwise(tok).alias("what"),
        "pos",
        F.when(tok == "{", _c("pair.pos")).otherwise(_c("pos")).alias("end_pos"),
        F.when(tok == "{", _c("pair.line")).otherwise(_c("end_line")).alias("end_line"),
    )
    return paired.select(
        "*",
        _last(_c("body") | (tok == ";") | head.isNotNull(), stop, after).alias("stop"),
        _last(_c("list"), F.struct("pos", "pair"), after).alias("params"),
    )


def _brace_ranges(rows: DataFrame) -> DataFrame:
    """Range and last line of declarations; invalid heads lose their mark.

    Brackets and separators have served their purpose here and are left out.
    """
    tok, head, params, stop = (_c(x) for x in ("tok", "head", "params", "stop"))
    has_body = _is("stop.what", "{")
    valid = (
        F.when(head == "ts_method", (_is("params.pair.then", "{") | _is("params.pair.then", ":")) & has_body)
        .when(head.isNotNull(), has_body)
        .otherwise(F.lit(False))
    )
    # A name with ``(...) :`` where a method may stand is a signature without a body: no call.
    no_call = F.when(head == "ts_method", valid | _is("params.pair.then", ":"))
    # The parameters of an arrow function.
    no_call = F.coalesce(no_call, F.lit(False)) | ((tok == "async") & _is("params.pair.then", "=>"))
    columns = {
        "head": F.when(valid, head),
        "call": _c("call") & ~F.coalesce(no_call, F.lit(False)),
        "end_pos": F.when(head.isNotNull(), stop["end_pos"]),
        "end_line_of": F.when(head.isNotNull(), stop["end_line"]),
        "start_pos": F.when(_in("head", _FUNCTIONS), params["pair"]["pos"])
        .when(head == "ts_class", stop["pos"])
        .otherwise(_c("pos")),
        "open_pos": params["pos"],
        "close_pos": params["pair"]["pos"],
    }
    serves = head.isNotNull() | _c("call") | _c("imported")
    kept = ["path", "pos", "tok", "line", "end_line", "depth", "ahead", "name", "start_line", "imported", "stmt"]
    return rows.where(serves).select(*kept, *[c.alias(n) for n, c in columns.items()])


def _cut(toks: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(toks, first.cast("int"), (last - first + 1).cast("int")), "")


def _enclosed(rows: DataFrame) -> DataFrame:
    """What encloses a row: a class, whose direct members may be methods.

    A position lies in one of several ranges that start before it exactly when the largest end of
    those ranges reaches it, so a running maximum is enough.
    """
    head, before, no = _c("head"), before_row(), F.lit(False)
    is_class = _in("head", _CLASSES)
    out = rows.select(
        "*",
        # Where a range without a closing bracket ends: before the next declaration.
        F.last(F.when(head.isNotNull(), F.struct("pos", "line")), ignorenulls=True)
        .over(_following("pos"))
        .alias("next_head"),
        F.max(F.when(is_class, _c("end_pos"))).over(before).alias("class_end"),
        _last(is_class, F.struct("depth", "end_pos"), before).alias("near_class"),
    )
    in_class = F.coalesce(_c("class_end") >= _c("pos"), no)
    direct = F.coalesce(
        (_c("near_class.end_pos") >= _c("pos")) & (_c("near_class.depth") + 1 == _c("depth")), no
    )
    member = in_class & (direct | ~_in("tok", _CONTROL))
    unclosed = head.isNotNull() & _c("end_pos").isNull()
    return out.select(
        "path",
        F.lit("typescript").alias("lang"),
        "pos",
        "tok",
        F.when(~_is("head", "ts_method") | member, head).alias("head"),
        "name",
        "call",
        "imported",
        "stmt",
        "line",
        "start_line",
        F.coalesce(
            _c("end_line_of"),
            F.when(unclosed, F.greatest(_c("line"), _c("next_head.line") - 1)),
            _c("end_line"),
        ).alias("end_line"),
        "start_pos",
        F.coalesce("end_pos", _c("next_head.pos") - 1, F.lit(FAR)).alias("end_pos"),
        "open_pos",
        "close_pos",
        F.when(
            _in("head", _FUNCTIONS) & (_c("close_pos") - _c("pos") < F.size("ahead")),
            _cut(_c("ahead"), _c("open_pos") - _c("pos") + 1, _c("close_pos") - _c("pos") + 1),
        ).alias("params"),
        F.lit(None).cast("string").alias("doc"),
        in_class.alias("in_class"),
        F.lit(True).alias("top"),
    )


# Partitions of text that no window sorts hold so many times as much.
_WIDER = 4
_READERS = {"python": python.file_facts, "rust": rust.file_facts, "go": golang.file_facts}


def facts(sources: DataFrame, lang: str, parts: int) -> DataFrame:
    """One row per declaration, call and import token of the files of one language.

    ``params`` is the raw text of a function's parameter list; of TypeScript, where the tokens kept
    next to its head hold it.
    """
    if lang in _READERS:
        return read_facts(dealt(sources, lang, -(-parts // _WIDER)), _READERS[lang], lang)
    rows = _classified(_marks(significant(sources, lang, parts)))
    rows = _enclosed(_brace_ranges(_brackets(rows)))
    return rows.where(_c("head").isNotNull() | _c("call") | _c("imported"))


# ------------------------------------------------------------------ symbols


def _uncovered() -> Column:
    """Functions whose parameter list did not end within the tokens kept next to the head."""
    return _in("head", _FUNCTIONS) & _c("close_pos").isNotNull() & _c("params").isNull()


def _with_parameters(
    heads: DataFrame, sources: DataFrame, languages: tuple[str, ...], uncovered: int, parts: dict[str, int]
) -> DataFrame:
    """Fills in ``params``, the raw text of the parameter list, where it is not known yet.

    It is cut from the file, which is joined only when there are such heads.
    """
    if not uncovered:
        return heads
    near, far = heads.where(~_uncovered()), heads.where(_uncovered()).drop("params")
    for lang in languages:
        cut = far.where(_c("lang") == lang).join(prepare(sources, lang, parts[lang]), "path")
        near = near.unionByName(
            cut.withColumn(
                "params", _cut(_c("toks"), _c("open_pos") + 1, _c("close_pos") + 1)
            ).drop("toks")
        )
    return near


def _symbol_id() -> Column:
    return F.concat("path", F.lit("::"), "name")


class Extraction(NamedTuple):
    facts: DataFrame
    symbols: DataFrame
    raw_edges: DataFrame
    call_sites: DataFrame


# Signature prefix of each sort of declaration; ``%`` stands for the name.
SIGNATURES = {
    "py_def": "def %",
    "py_class": "class %",
    "ts_func": "function %",
    "ts_method": "%",
    "ts_class": "class %",
    "rs_fn": "fn %",
    "rs_struct": "struct %",
    "go_func": "func %",
    "go_method": "func (r) %",
    "go_struct": "type % struct{...}",
    "go_iface": "type % interface{...}",
}

# Symbol kind of each sort of declaration (Python ``def`` is decided by its place).
KINDS = {
    "py_class": "class",
    "ts_func": "function",
    "ts_method": "method",
    "ts_class": "class",
    "rs_fn": "function",
    "rs_struct": "struct",
    "go_func": "function",
    "go_method": "method",
    "go_struct": "struct",
    "go_iface": "interface",
}


def _symbols(
    heads: DataFrame,
    sources: DataFrame,
    languages: tuple[str, ...],
    uncovered: int,
    parts: dict[str, int],
    class_docstrings: bool,
    clean_signature: bool,
) -> DataFrame:
    head = _c("head")
    rows = _with_parameters(heads, sources, languages, uncovered, parts)
    prefix = F.lit(None).cast("string")
    for sort, text in SIGNATURES.items():
        before, after = text.split("%")
        prefix = F.when(head == sort, F.concat(F.lit(before), "name", F.lit(after))).otherwise(prefix)
    listed = _c("params") if clean_signature else F.concat(F.lit("("), "params", F.lit(")"))
    # A decorated method is both a function and a method, as each rule takes it on its own.
    as_function = F.when((head == "py_def") & _c("top"), "function")
    as_method = F.when((head == "py_def") & _c("in_class"), "method")
    fixed = F.lit(None).cast("string")
    for sort, kind in KINDS.items():
        fixed = F.when(head == sort, F.lit(kind)).otherwise(fixed)
    kinds = F.filter(F.array(as_function, as_method, fixed), lambda k: k.isNotNull())
    doc = _c("doc") if class_docstrings else F.when(head == "py_def", _c("doc"))
    return rows.withColumn("kind", F.explode(kinds)).select(
        _symbol_id().alias("id"),
        "name",
        "kind",
        _c("path").alias("file_path"),
        _c("start_line").cast("long").alias("line_start"),
        _c("end_line").cast("long").alias("line_end"),
        F.concat(prefix, F.coalesce(listed, F.lit(""))).alias("signature"),
        doc.alias("docstring"),
        F.lit("null").alias("properties"),
    ).select(*SYMBOLS.names)


# ------------------------------------------------------------------ edges

_BIN = 256


def _contained(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Points in ranges of the same role and path: equi-join on fixed-width bins of token numbers.

    A long range has one row per bin it touches, a point has one bin, so the work of a large file
    is spread over its bins.
    """
    at = points.withColumn("bin", F.floor(_c("pos") / _BIN))
    spans = ranges.withColumn(
        "bin", F.explode(F.sequence(F.floor(_c("start_pos") / _BIN), F.floor(_c("end_pos") / _BIN)))
    )
    return at.join(spans, ["path", "role", "bin"]).where(
        (_c("pos") > _c("start_pos")) & (_c("pos") <= _c("end_pos"))
    )


def _raw_edges(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw edges, call sites with their line)."""
    head = _c("head")
    is_method = ((head == "py_def") & _c("in_class")) | (head == "ts_method")
    emitted = _in("head", _FUNCTIONS) & ((head != "py_def") | _c("top") | _c("in_class"))
    ends = found.groupBy("path").agg(F.max("pos").alias("last_pos"))
    bounded = found.where(_in("head", _FUNCTIONS + _CLASSES)).join(ends, "path").withColumn(
        "end_pos", F.least("end_pos", "last_pos")
    )
    ranges = bounded.where(emitted | _in("head", _CLASSES)).where(_c("end_pos") >= _c("start_pos")).select(
        "path",
        F.when(_in("head", _CLASSES), "defines").otherwise("calls").alias("role"),
        "start_pos",
        "end_pos",
        _symbol_id().alias("source"),
    )
    points = found.where(_c("call")).select(
        "path", "pos", F.lit("calls").alias("role"), "line", _c("tok").alias("target")
    ).unionByName(
        found.where(is_method).select(
            "path", "pos", F.lit("defines").alias("role"), "line", _symbol_id().alias("target")
        )
    )
    inside = _contained(points, ranges).select(
        "source", "target", _c("role").alias("kind"), "path", "line", "pos"
    )
    edges = inside.withColumnRenamed("path", "file_path").select(*RAW_EDGES.names).unionByName(_imports(found))
    sites = inside.where(_c("kind") == "calls").select(
        "source", "target", _c("path").alias("file_path"), _c("line").cast("long").alias("line"), "pos"
    )
    return edges.distinct(), sites


def _imports(found: DataFrame) -> DataFrame:
    """File -> module. Python: plain dotted names only; aliased, ``*`` and relative forms are left out."""
    lang = _c("lang")
    rows = found.where(_c("imported"))
    quoted = rows.where(lang != "python").select(
        "path",
        F.when(lang == "go", F.expr("trim(BOTH '\"' FROM tok)"))
        .otherwise(F.expr("trim(BOTH '\"\\'' FROM tok)"))
        .alias("target"),
    )
    # One group is the tokens of one import statement.
    statements = (
        rows.where(lang == "python")
        .groupBy("path", "stmt")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "tok"))).alias("parts"))
        .select("path", F.array_join("parts.tok", " ").alias("text"))
    )
    plain = F.regexp_extract("text", r"^import (.*)$", 1)
    listed = F.regexp_extract("text", r"^from (?!__future__ import)[^. ][^ ]*(?: \. [^ ]+)* import (.*)$", 1)
    names = F.explode(F.split(F.translate(F.concat(plain, listed), "()", ""), ","))
    dotted = F.translate(_c("item"), " ", "")
    python = (
        statements.select("path", names.alias("item"))
        .where(F.trim("item").rlike(r"^[\p{L}_][\p{L}\p{N}_]*( \. [\p{L}_][\p{L}\p{N}_]*)*$"))
        .select("path", dotted.alias("target"))
    )
    return quoted.unionByName(python).select(
        _c("path").alias("source"), "target", F.lit("imports").alias("kind"), _c("path").alias("file_path")
    )


def extract(
    sources: DataFrame,
    languages: tuple[str, ...] = ALL_LANGUAGES,
    class_docstrings: bool = False,
    clean_signature: bool = False,
) -> Extraction:
    """Symbols and raw edges of ``sources(path, content)``; one file never fails the job.

    Symbols are as declared, before ids are made unique (see ``resolve.dedup_nodes``).
    """
    sources, parts, languages = by_language(sources, languages)
    each = [facts(sources, lang, parts[lang]) for lang in languages]
    far = F.sum(F.when(_uncovered(), 1).otherwise(0))
    found = stage(reduce(DataFrame.unionByName, each), "facts", far=far)
    heads = found.df.where(_c("head").isNotNull())
    symbols = _symbols(
        heads, sources, languages, found.metrics["far"] or 0, parts, class_docstrings, clean_signature
    )
    edges, sites = _raw_edges(found.df)
    return Extraction(found.df, symbols, edges, sites)
