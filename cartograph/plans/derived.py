"""Graphs and file listings derived from the given tables.

Every rule is row-wise arithmetic over the tables' keys, ``distinct`` or a min/max aggregate, so
no key, however frequent, forms one large group. File sizes are fixed by ``key div n``: more data
means more files, not longer ones. FIXTURES.md states the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.schema import SYMBOLS


class Tables:
    """The given Parquet tables of one scale factor, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._rows: dict[str, int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, name: str) -> int:
        """Row count from the Parquet footers."""
        if name not in self._rows:
            self._rows[name] = getattr(self, name).count()
        return self._rows[name]


def _tag(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix + "::"), key.cast("string"))


def _module(folder: Column, key: Column, size: int, ext: str) -> Column:
    return F.concat(folder, F.lit("/m"), F.floor(key / size).cast("string"), F.lit(ext))


def _symbols(rows: DataFrame, kind: str, prefix: str, key: str, name: Column, path: Column) -> DataFrame:
    k = F.col(key).cast("long")
    start = (k % 5000) * 10 + 1
    return rows.select(
        _tag(prefix, k).alias("id"),
        name.alias("name"),
        F.lit(kind).alias("kind"),
        path.alias("file_path"),
        start.alias("line_start"),
        (start + k % 9).alias("line_end"),
        F.concat(F.lit(kind + " "), name).alias("signature"),
        F.when(k % 2 == 0, F.concat(F.lit("doc "), name)).alias("docstring"),
        F.lit("null").alias("properties"),
    )


def graph_p_symbols(t: Tables) -> DataFrame:
    c = F.col
    no_hash = lambda col: F.translate(c(col), "#", "_")
    part = _symbols(
        t.part, "function", "part", "p_partkey", F.translate(c("p_name"), " ", "_"),
        _module(F.concat(F.lit("src/part/"), no_hash("p_brand")), c("p_partkey"), 5000, ".py"),
    )
    supplier = _symbols(
        t.supplier, "class", "supplier", "s_suppkey", no_hash("s_name"),
        _module(F.concat(F.lit("src/supplier/nation_"), c("s_nationkey")), c("s_suppkey"), 5000, ".ts"),
    )
    customer = _symbols(
        t.customer, "struct", "customer", "c_custkey", no_hash("c_name"),
        _module(F.concat(F.lit("src/customer/"), c("c_mktsegment")), c("c_custkey"), 1000, ".rs"),
    )
    nation = _symbols(
        t.nation, "interface", "nation", "n_nationkey", c("n_name"),
        F.concat(F.lit("src/nation/region_"), c("n_regionkey"), F.lit(".go")),
    )
    region = _symbols(
        t.region, "method", "region", "r_regionkey", c("r_name"), F.lit("src/region/all.go")
    )
    out = part.unionByName(supplier).unionByName(customer).unionByName(nation).unionByName(region)
    return out.select(*SYMBOLS.names)


def _next_part(t: Tables) -> Column:
    return (F.col("l_partkey") * 5 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % t.rows("part")


def graph_p_edges(t: Tables) -> DataFrame:
    c = F.col

    def edges(rows: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
        return rows.select(
            source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("kind")
        )

    line = t.lineitem
    return (
        edges(line, _tag("part", c("l_partkey")), _tag("part", _next_part(t)), "calls")
        .unionByName(
            edges(t.orders, _tag("customer", c("o_custkey")),
                  _tag("part", c("o_orderkey") % t.rows("part")), "calls")
        )
        .unionByName(
            edges(line.where("l_linenumber = 1"), _tag("supplier", c("l_suppkey")),
                  _tag("part", c("l_partkey")), "defines")
        )
        .unionByName(
            edges(t.nation, _tag("nation", c("n_nationkey")), _tag("region", c("n_regionkey")), "defines")
        )
        .distinct()
    )


def raw_edges_r(t: Tables) -> DataFrame:
    """Raw edges of four sorts by line number: full id, name, unresolvable name, import."""
    c = F.col
    sort = c("l_linenumber") % 4
    # Names come from the 64-value part vocabulary and belong to many symbols each.
    names = t.part.select(c("p_partkey").alias("np"), F.translate(c("p_name"), " ", "_").alias("np_name"))
    rows = t.lineitem.select("l_partkey", "l_suppkey", sort.alias("sort"), _next_part(t).alias("np"))
    named = rows.where("sort = 1").join(names, "np")
    own = _tag("part", c("l_partkey"))
    plain = rows.where("sort <> 1").select(
        F.when(c("sort") == 3, F.concat(F.lit("src/part/p"), c("l_partkey"), F.lit(".py")))
        .otherwise(own).alias("source"),
        F.when(c("sort") == 0, _tag("supplier", c("l_suppkey")))
        .when(c("sort") == 2, F.concat(F.lit("ext_"), c("l_suppkey")))
        .otherwise(F.concat(F.lit("mod_"), c("l_suppkey"))).alias("target"),
        F.when(c("sort") == 3, "imports").otherwise("calls").alias("kind"),
    )
    return plain.unionByName(
        named.select(own.alias("source"), c("np_name").alias("target"), F.lit("calls").alias("kind"))
    )


def graph_s_edges(t: Tables) -> DataFrame:
    """A sparse graph over suppliers: one edge each, two for every fifth one."""
    m = t.rows("supplier")
    order = F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey")
    ends = t.lineitem.groupBy("l_suppkey").agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    both = F.when(F.col("l_suppkey") % 5 == 0, F.array("lo", "hi")).otherwise(F.array("lo"))
    target = (F.col("e") % 1_000_000_000 * 7 + 3) % m
    return (
        ends.select("l_suppkey", F.explode(both).alias("e"))
        .select(
            _tag("supplier", F.col("l_suppkey")).alias("source_id"),
            _tag("supplier", target).alias("target_id"),
            F.lit("calls").alias("kind"),
        )
        .distinct()
    )


def ring_edges(t: Tables) -> DataFrame:
    """Rings of fifteen suppliers each, with three chords: cycles of 12 to 15, eight to each ring."""
    k, m = F.col("s_suppkey"), t.rows("supplier")
    following = F.when((k % 15 == 14) | (k + 1 == m), k - k % 15).otherwise(k + 1)
    chord = F.when((k % 5 == 0) & (k + 2 < m), k + 2)
    return (
        t.supplier.select(k, F.explode(F.array_compact(F.array(following, chord))).alias("next"))
        .select(
            _tag("supplier", F.col("s_suppkey")).alias("source_id"),
            _tag("supplier", F.col("next")).alias("target_id"),
            F.lit("calls").alias("kind"),
        )
        .distinct()
    )


def graph_s_symbols(t: Tables) -> DataFrame:
    return graph_p_symbols(t).where(F.col("id").startswith("supplier::"))


def copied_symbols(t: Tables) -> DataFrame:
    """Symbol rows with many copies of an id: one row per line item."""
    k = F.col("l_partkey")
    start = F.col("l_linenumber").cast("long") * 10 + F.col("l_suppkey") % 10
    kind = F.when(F.col("l_linenumber") % 3 == 0, "method").otherwise("function")
    return t.lineitem.select(
        _tag("part", k).alias("id"),
        F.concat(F.lit("f_"), k).alias("name"),
        kind.alias("kind"),
        F.concat(F.lit("src/p"), F.floor(k / 40), F.lit(".py")).alias("file_path"),
        start.alias("line_start"),
        (start + F.col("l_suppkey") % 7).alias("line_end"),
        F.concat(kind, F.lit(" f_"), k).alias("signature"),
        F.lit(None).cast("string").alias("docstring"),
        F.lit("null").alias("properties"),
    )


# The folders and extensions of the listing.
LISTING_FOLDERS = ("api", "src2", "node_modules", "core", ".git", "core/node")
LISTING_SUFFIXES = ("py", "ts", "tsx", "rs", "js", "jsx", "go", "md", "PY")


def listing(t: Tables) -> DataFrame:
    """One path per part."""
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    return t.part.select(
        F.concat(
            F.lit("src/"), pick(LISTING_FOLDERS, 6), F.lit("/f"), k, F.lit("."),
            pick(LISTING_SUFFIXES, 9),
        ).alias("path")
    )
