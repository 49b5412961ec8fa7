"""From raw edges to the graph: node table, name index, resolution, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.schema import SYMBOLS
from cartograph.session import stage


def dedup_nodes(symbols: DataFrame) -> DataFrame:
    """One row per id: a method before others, then the smallest line range.

    An aggregate rather than a window, so that many copies of one id shrink before the shuffle.
    The number of copies is kept in ``properties`` when there is more than one.
    """
    rank = F.struct(
        F.when(F.col("kind") == "method", 0).otherwise(1),
        "line_start",
        "line_end",
        "kind",
        F.coalesce("signature", F.lit("")),
        F.coalesce("docstring", F.lit("")),
    )
    others = [c for c in SYMBOLS.names if c not in ("id", "properties")]
    best = symbols.groupBy("id").agg(
        F.min_by(F.struct(*others, "properties"), rank).alias("row"),
        F.count(F.lit(1)).alias("copies"),
    )
    marked = F.when(
        F.col("copies") > 1, F.concat(F.lit('{"duplicates":'), F.col("copies"), F.lit("}"))
    ).otherwise(F.col("row.properties"))
    return best.select("id", *[F.col(f"row.{c}") for c in others], marked.alias("properties"))


def name_index(symbols: DataFrame) -> DataFrame:
    """One id per name: the first by (file_path, line_start, id)."""
    return symbols.groupBy("name").agg(
        F.min_by("id", F.struct("file_path", "line_start", "id")).alias("id")
    )


_RAW = ("source", "target", "kind")


def key_lookup(ids: DataFrame, names: DataFrame) -> DataFrame:
    """(key, exact_id, named_id): what each id and each name stands for, one row per key; staged.

    ``ids``: column ``id``; ``names``: name, id, one row per name. Spark splits a skewed join only
    between two plain shuffles. An aggregate on one side would be reused for the join and rule that
    out, so it is written first.
    """
    none = F.lit(None).cast("string")
    exact = ids.select(F.col("id").alias("key"), F.col("id").alias("exact"), none.alias("named"))
    named = names.select(F.col("name").alias("key"), none.alias("exact"), F.col("id").alias("named"))
    keys = exact.unionByName(named).groupBy("key")
    return stage(keys.agg(F.max("exact").alias("exact_id"), F.max("named").alias("named_id")), "lookup").df


def _lookup(symbols: DataFrame) -> DataFrame:
    return key_lookup(symbols, name_index(symbols))


def _resolved(raw_edges: DataFrame, lookup: DataFrame) -> DataFrame:
    """Distinct raw edges with a known source, and their target id or null.

    The lookup has one row per key, so no join fans out. A popular target, or a source with very
    many edges, makes the edge side skewed, which the adaptive skew join splits.
    """
    sources = lookup.where("exact_id IS NOT NULL").select(F.col("key").alias("source"))
    known = raw_edges.select(*_RAW).distinct().join(sources, "source", "left_semi")
    return known.join(lookup.withColumnRenamed("key", "target"), "target", "left").select(
        *_RAW, F.coalesce("exact_id", "named_id").alias("target_id")
    )


def resolved_rows(raw_edges: DataFrame, lookup: DataFrame) -> DataFrame:
    """All rows of ``raw_edges`` with ``target_id``: null if the source or the target is unknown."""
    sources = lookup.where("exact_id IS NOT NULL").select(F.col("key").alias("source"), F.lit(True).alias("known"))
    told = raw_edges.join(sources, "source", "left").join(lookup.withColumnRenamed("key", "target"), "target", "left")
    return told.select(
        *raw_edges.columns, F.when(F.col("known"), F.coalesce("exact_id", "named_id")).alias("target_id")
    )


def resolve_edges(raw_edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges between known ids: exact id first, then name; unresolved ones are left out."""
    return (
        _resolved(raw_edges, _lookup(symbols))
        .where(F.col("target_id").isNotNull())
        .select(F.col("source").alias("source_id"), "target_id", "kind")
        .distinct()
    )


def unresolved_edges(raw_edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct raw edges that :func:`resolve_edges` drops, with the reason."""
    lookup = _lookup(symbols)
    ids = lookup.where("exact_id IS NOT NULL").select(F.col("key").alias("source"))
    orphans = raw_edges.select(*_RAW).distinct().join(ids, "source", "left_anti")
    unknown = _resolved(raw_edges, lookup).where(F.col("target_id").isNull())
    return orphans.select("source", "target", "kind", F.lit("source").alias("missing")).unionByName(
        unknown.select("source", "target", "kind", F.lit("target").alias("missing"))
    )


def imports_of(raw_edges: DataFrame) -> DataFrame:
    """Import edges (file -> module); they never resolve, so they are read from the raw table."""
    return (
        raw_edges.where(F.col("kind") == "imports")
        .select(F.col("source").alias("file_path"), F.col("target").alias("module"))
        .distinct()
    )


def edge_dedup(edges: DataFrame) -> DataFrame:
    return edges.select("source_id", "target_id", "kind").distinct()


def valid_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    ids = symbols.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(
        ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi"
    )


def dangling_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with a missing end, and which end it is."""
    ids = symbols.select("id")
    no_source = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    no_target = edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    cols = ("source_id", "target_id", "kind")
    return no_source.select(*cols, F.lit("source").alias("missing")).unionByName(
        no_target.select(*cols, F.lit("target").alias("missing"))
    )


def out_adjacency(edges: DataFrame) -> DataFrame:
    """Outgoing edges of every node in long form, with the node's degree.

    Long form on purpose: a hub's neighbours stay spread over rows instead of one huge array.
    The degree table is staged and joined back, not computed by a window over the hub, so that the
    join is between two plain shuffles and a hub can be split.
    """
    return _adjacency(edges, "source_id", "target_id")


def in_adjacency(edges: DataFrame) -> DataFrame:
    return _adjacency(edges, "target_id", "source_id")


def _adjacency(edges: DataFrame, node: str, neighbour: str) -> DataFrame:
    degree = stage(edges.groupBy(node).agg(F.count(F.lit(1)).alias("degree")), "degree").df
    return edges.join(degree, node).select(
        F.col(node).alias("node_id"), F.col(neighbour).alias("neighbour_id"), "kind", "degree"
    )


def neighbours(edges: DataFrame, node_id: str, outgoing: bool = True) -> DataFrame:
    """Edges of one node."""
    near, far = ("source_id", "target_id") if outgoing else ("target_id", "source_id")
    return edges.where(F.col(near) == F.lit(node_id)).select(
        F.col(near).alias("node_id"), F.col(far).alias("neighbour_id"), "kind"
    )
