"""Point and prefix lookups over ``symbols`` and ``edges``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.functions.text import folded_prefix_like, like_ascii, prefix_like
from cartograph.schema import ROW_COLUMNS, SYMBOLS
from cartograph.sources.search import Lookups, plain_grams

#: Up to so many names are literals of a scan; more are joined.
NAMES = 1000


def symbol_rows(symbols: DataFrame) -> DataFrame:
    return symbols.select(*ROW_COLUMNS)


def search_symbol(
    symbols: DataFrame,
    query: str,
    kind: str | None = None,
    fuzzy: bool = False,
    limit: int = 50,
) -> DataFrame:
    """Symbols by name, exact or as a contained pattern; first ``limit`` by (name, id)."""
    name = F.col("name")
    hits = symbols.where(like_ascii(name, f"%{query}%") if fuzzy else name == F.lit(query))
    if kind:
        hits = hits.where(F.col("kind") == F.lit(kind))
    return symbol_rows(hits).orderBy("name", "id").limit(limit)


def search_fuzzy(lookups: Lookups, query: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """:func:`search_symbol` with a contained pattern, over the postings of the pattern's rarest gram.

    A pattern without three plain characters in a row scans the symbols. Otherwise the first ``limit``
    names that match hold the first ``limit`` symbols, as every name in the postings has one of its
    kind; their rows are read by name.
    """
    grams = plain_grams(query)
    if not grams:
        return search_symbol(lookups.by_name, query, kind, fuzzy=True, limit=limit)
    # At most one row for each character of the pattern.
    counts = {r["gram"]: r["n"] for r in lookups.grams.where(F.col("gram").isin(grams)).collect()}
    rarest = min(grams, key=lambda gram: (counts.get(gram, 0), gram))
    found = lookups.postings.where(F.col("gram") == rarest).where(like_ascii(F.col("name"), f"%{query}%"))
    hits = lookups.by_name
    if kind:
        found = found.where(F.col("kind") == F.lit(kind))
        hits = hits.where(F.col("kind") == F.lit(kind))
    names = found.select("name").distinct().orderBy("name").limit(limit)
    if limit <= NAMES:
        hits = hits.where(F.col("name").isin([r["name"] for r in names.collect()]))
    else:
        hits = hits.join(names, "name", "left_semi")
    return symbol_rows(hits).orderBy("name", "id").limit(limit)


def get_symbol(symbols: DataFrame, symbol_id: str) -> DataFrame:
    return symbols.where(F.col("id") == F.lit(symbol_id)).select(*SYMBOLS.names)


def list_symbols_in_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbol_rows(symbols.where(F.col("file_path") == F.lit(path))).orderBy("line_start", "id")


def file_summary(symbols: DataFrame, path: str) -> DataFrame:
    """One row per kind in a file: count, and the symbols in line order as an array."""
    row = F.struct(F.col("line_start"), F.col("line_end"), F.col("name"), F.col("id"))
    return (
        symbols.where(F.col("file_path") == F.lit(path))
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(row)).alias("members"))
    )


def list_files(symbols: DataFrame) -> DataFrame:
    return symbols.select("file_path").distinct().orderBy("file_path")


def find_definition(symbols: DataFrame, sources: DataFrame, symbol_id: str) -> DataFrame:
    """The symbol with the source lines of its range.

    The symbol is looked up first, so that its path is a literal which the scan of the sources can
    use; a join key is not pushed into a scan.
    """
    hit = get_symbol(symbols, symbol_id).withColumnRenamed("file_path", "path")
    # One row: ids are unique.
    paths = [r["path"] for r in hit.select("path").collect()]
    sources = sources.where(F.col("path").isin(paths))
    lines = F.slice(
        F.split("content", "\n"),
        F.col("line_start").cast("int"),
        (F.col("line_end") - F.col("line_start") + 1).cast("int"),
    )
    return hit.join(sources, "path").select(
        "id",
        "name",
        "kind",
        F.col("path").alias("file_path"),
        "line_start",
        "line_end",
        F.array_join(lines, "\n").alias("text"),
    )


def under_path(symbols: DataFrame, path: str) -> DataFrame:
    """Symbols whose file path starts with ``path`` (as text: ``src`` also takes ``src2/``).

    With a ``folded_path``, as in ``Lookups.by_path``, the prefix is one range of the scan.
    """
    path = path.rstrip("/")
    if "folded_path" in symbols.columns:
        return symbols.where(folded_prefix_like(F.col("folded_path"), path))
    return symbols.where(prefix_like(F.col("file_path"), path))


def architecture_rows(symbols: DataFrame, path: str) -> DataFrame:
    return symbol_rows(under_path(symbols, path)).orderBy("kind", "name", "id")


def subgraph(edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``node_ids(id)``; the membership list is never collected."""
    ids = node_ids.select("id")
    return edges.join(
        ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi"
    ).join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(
        "source_id", "target_id", "kind"
    )


def internal_edges(edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    return subgraph(edges, node_ids).agg(F.count(F.lit(1)).alias("internal_edges"))


def architecture_by_kind(symbols: DataFrame, path: str) -> DataFrame:
    return under_path(symbols, path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def architecture(symbols: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """One row: path, total symbols, and the edges that stay inside."""
    inside = under_path(symbols, path)
    total = inside.agg(F.count(F.lit(1)).alias("total_symbols"), F.lit(1).alias("k"))
    within = internal_edges(edges, inside).withColumn("k", F.lit(1))
    return total.join(within, "k").select(
        F.lit(path).alias("path"), "total_symbols", "internal_edges"
    )


def index_status(symbols: DataFrame, edges: DataFrame, meta: DataFrame) -> DataFrame:
    """Meta values next to live counts; the live symbol count replaces the stored one."""

    def value(key: str):
        return F.max(F.when(F.col("key") == key, F.col("value"))).alias(key)

    one = F.lit(1).alias("k")
    stored = meta.agg(value("schema_version"), value("project_root"), value("indexed_at"),
                      value("file_count"), one)
    live = symbols.agg(
        F.count(F.lit(1)).alias("symbol_count"),
        F.countDistinct("file_path").alias("indexed_file_count"),
        one,
    )
    n_edges = edges.agg(F.count(F.lit(1)).alias("edge_count"), one)
    # Each side is a single aggregate row.
    return stored.join(live, "k").join(n_edges, "k").drop("k")


def result_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text, null fields left out."""
    return rows.select("id", F.to_json(F.struct(*rows.columns)).alias("json"))
