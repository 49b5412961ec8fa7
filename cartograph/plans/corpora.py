"""Source texts rendered from the given tables, forty rows to a file.

FIXTURES.md states the rules. The expected symbols and edges follow from the tables alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartograph.plans.derived import Tables

ROWS_PER_FILE = 40


def _fill(template: str, **values: Column) -> Column:
    """``{name}`` fields of a template replaced by columns; ``⟦`` and ``⟧`` stand for literal braces."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        text, rest = rest.split("{", 1)
        field, rest = rest.split("}", 1)
        parts += [F.lit(text), values[field].cast("string")]
    parts.append(F.lit(rest))
    return F.translate(F.concat(*parts), "⟦⟧", "{}")


def _render(rows: DataFrame, path: Column, key: Column, text: Column, header: Column) -> DataFrame:
    """One text per path: header, then the rows' texts in key order. At most forty rows a file."""
    return (
        rows.select(path.alias("path"), header.alias("header"), F.struct(key.alias("k"), text.alias("text")).alias("row"))
        .groupBy("path", "header")
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
        .select("path", F.concat("header", F.array_join("rows.text", "\n")).alias("content"))
    )


def _module(key: Column) -> Column:
    return F.floor(key / ROWS_PER_FILE)


def python_functions(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    text = _fill(
        'def part_{k}(size, price):\n    """{name}"""\n    part_{j}(size)\n'
        "    obj.skip_{k}(price)  # gone(1)\n",
        k=k, name=F.col("p_name"), j=(k * 7 + 3) % t.rows("part"),
    )
    path = F.concat(F.lit("src/py/parts/m"), _module(k), F.lit(".py"))
    return _render(t.part, path, k, text, F.lit("import os.path\nfrom pkg import item\n\n"))


def python_classes(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    text = _fill(
        'class Sup_{k}:\n    """doc"""\n    def ping_{k}(self, x):\n'
        "        f\"it's ⟦part_0(x)⟧\"\n",
        k=k,
    )
    path = F.concat(F.lit("src/py/sup/m"), _module(k), F.lit(".py"))
    return _render(t.supplier, path, k, text, F.lit(""))


def c_py(t: Tables) -> DataFrame:
    return python_functions(t).unionByName(python_classes(t))


# The extensions of the TypeScript backend, in turn.
TS_SUFFIXES = ("ts", "tsx", "js", "jsx")


def c_ts(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    text = _fill(
        "function make_{k}(x) ⟦\n  `it's $⟦helper_{j}(x)⟧ ⟧ (`; new Box(x); const p = /{long}\\⟦/;\n⟧\n"
        "class Sup_{k} ⟦\n  run_{k}(a, b) ⟦ make_{k}<A<B<C<D<E>>>>, {types}>(a); ⟧\n⟧",
        k=k, j=(k + 1) % t.rows("supplier"), long=F.lit("a" * 600),
        types=F.lit(", ".join(f"T{i}" for i in range(300))),
    )
    ext = F.element_at(F.array(*map(F.lit, TS_SUFFIXES)), (_module(k) % 4 + 1).cast("int"))
    path = F.concat(F.lit("src/ts/m"), _module(k), F.lit("."), ext)
    header = _fill('import ⟦ ping ⟧ from "./lib_{m}";\n\n', m=_module(k))
    return _render(t.supplier, path, k, text, header)


def c_rs(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    text = _fill(
        "struct Ord_{k} ⟦ id: i64 ⟧\nfn load_{k}(id: i64) -> i64 ⟦\n"
        '    check_{j}(id); /* a /* b */ gone( */ std::mem::drop(id); println!("load_{k}(0)")\n⟧',
        k=k, j=k % 10,
    )
    path = F.concat(F.lit("src/rs/m"), _module(k), F.lit(".rs"))
    return _render(t.orders, path, k, text, F.lit(""))


def c_go(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    text = _fill(
        "type Cust_{k} struct ⟦ ID int ⟧\n"
        "func (c Cust_{k}) Show_{k}(w int) ⟦ New_{k}[int](w) ⟧\n"
        "func New_{k}(v int) ⟦ fmt.Println(v) ⟧\n"
        "type Shower_{k} interface ⟦ Show(w int) ⟧\n",
        k=k,
    )
    path = F.concat(F.lit("src/go/m"), _module(k), F.lit(".go"))
    return _render(t.customer, path, k, text, F.lit('package n\nimport "fmt"\n\n'))


def everything(t: Tables) -> DataFrame:
    return c_py(t).unionByName(c_ts(t)).unionByName(c_rs(t)).unionByName(c_go(t))
