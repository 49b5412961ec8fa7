"""Caller and callee traversals as level loops.

Each level is one staged job: frontier join edges, then ``distinct``. A recursive CTE would make
one row per walk; the distinct frontier makes one row per (seed, symbol, level), which is the same
result set. Over a bucketed :class:`Adjacency` a level shuffles its frontier only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.operators.lookup import symbol_rows
from cartograph.session import Visited, stage
from cartograph.sources.adjacency import Adjacency

CALLERS, CALLEES = "callers", "callees"


class _Plain:
    """Hops of an edge table in any layout."""

    def __init__(self, hops: DataFrame) -> None:
        self.hops = hops

    def step(self, frontier: DataFrame) -> DataFrame:
        return frontier.join(self.hops, "id")

    def of(self, node: str) -> DataFrame:
        return self.hops.where(F.col("id") == F.lit(node))


def ends(direction: str) -> tuple[str, str]:
    """The near and the far end of an edge in the direction of a traversal."""
    return ("target_id", "source_id") if direction == CALLERS else ("source_id", "target_id")


def _hops(edges: DataFrame, direction: str) -> DataFrame:
    near, far = ends(direction)
    calls = edges.where(F.col("kind") == "calls")
    return calls.select(F.col(near).alias("id"), F.col(far).alias("next"))


def _with_symbols(reached: DataFrame, symbols: DataFrame, *extra: str) -> DataFrame:
    rows = symbol_rows(symbols)
    return reached.join(rows, "id").select(*rows.columns, *extra)


def walk_levels(
    edges: DataFrame | Adjacency,
    seeds: str | DataFrame,
    direction: str,
    depth: int,
    first_visit_only: bool = False,
) -> DataFrame:
    """Rows (seed_id, id, depth) reached in ``max(depth, 1)`` levels.

    ``seeds`` is one id or a frame with a ``seed_id`` column. With ``first_visit_only`` each id
    is kept at its smallest depth; the seed itself is not marked as visited, so a seed on a cycle
    appears in its own result. ``edges`` may be an :class:`Adjacency` of that direction.
    """
    hops = edges if isinstance(edges, Adjacency) else _Plain(_hops(edges, direction))
    if isinstance(seeds, str):
        # A literal filter reaches the scan; no join is needed for the first level.
        start = hops.of(seeds).select(F.lit(seeds).alias("seed_id"), F.col("next").alias("id"))
    else:
        first = seeds.select("seed_id", F.col("seed_id").alias("id")).distinct()
        start = hops.step(first).select("seed_id", F.col("next").alias("id"))
    levels: list[DataFrame] = []
    visited = Visited()
    reached = start
    for k in range(1, max(depth, 1) + 1):
        fresh = reached.distinct()
        if first_visit_only and levels:
            fresh = fresh.join(visited.all(), ["seed_id", "id"], "left_anti")
        level = stage(fresh.withColumn("depth", F.lit(k).cast("long")), "level")
        levels.append(level.df)
        if level.rows == 0:
            break
        if first_visit_only:
            visited.add(level.df.select("seed_id", "id"))
        reached = hops.step(level.df).select("seed_id", F.col("next").alias("id"))
    return reduce(DataFrame.unionByName, levels)


def trace(
    symbols: DataFrame, edges: DataFrame, symbol_id: str, direction: str, depth: int = 1
) -> DataFrame:
    """Symbols reached over calls. Depth 1 has no depth column; other depths have one.

    One row per (symbol, walk length).
    """
    if depth == 1:
        hops = _hops(edges, direction).where(F.col("id") == F.lit(symbol_id))
        reached = hops.select(F.col("next").alias("id")).distinct()
        return _with_symbols(reached, symbols).orderBy("name", "id")
    reached = walk_levels(edges, symbol_id, direction, depth)
    return _with_symbols(reached, symbols, "depth").orderBy("depth", "name", "id")


def trace_callers(symbols, edges, symbol_id: str, depth: int = 1) -> DataFrame:
    return trace(symbols, edges, symbol_id, CALLERS, depth)


def trace_callees(symbols, edges, symbol_id: str, depth: int = 1) -> DataFrame:
    return trace(symbols, edges, symbol_id, CALLEES, depth)


find_callers = trace_callers


def trace_min_depth(
    symbols: DataFrame, edges: DataFrame, symbol_id: str, direction: str, depth: int
) -> DataFrame:
    """One row per symbol, at its smallest depth."""
    reached = walk_levels(edges, symbol_id, direction, depth, first_visit_only=True)
    return _with_symbols(reached, symbols, "depth").orderBy("depth", "name", "id")


def trace_batch(
    symbols: DataFrame, edges: DataFrame | Adjacency, seeds: DataFrame, direction: str, depth: int
) -> DataFrame:
    """The traversal for a whole table of seeds at once; rows carry their ``seed_id``.

    With an :class:`Adjacency` and symbols in buckets by id neither table is shuffled.
    """
    reached = walk_levels(edges, seeds, direction, depth)
    return _with_symbols(reached, symbols, "depth", "seed_id")


def find_references(symbols: DataFrame, edges: DataFrame, symbol_id: str) -> DataFrame:
    """Every symbol with an edge of any kind to ``symbol_id``."""
    incoming = edges.where(F.col("target_id") == F.lit(symbol_id)).select(
        F.col("source_id").alias("id"), F.col("kind").alias("edge_kind")
    )
    return _with_symbols(incoming, symbols, "edge_kind").orderBy("edge_kind", "name", "id")
