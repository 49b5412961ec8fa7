"""Graph analytics over the simple digraph of all edge kinds."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.session import Staged, Visited, stage


def simple_digraph(edges: DataFrame) -> DataFrame:
    """At most one edge per ordered pair; kinds are merged."""
    return edges.select("source_id", "target_id").distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class _Front:
    """Levels of a breadth-first search over hops (prev, id), each (id, depth, prev).

    ``prev`` is the smallest predecessor on the level before.
    """

    def __init__(self, first: DataFrame, hops: DataFrame) -> None:
        start = first.select("id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("prev"))
        self.hops, self.visited, self.levels = hops, Visited(), [stage(start, "bfs")]

    @property
    def last(self) -> Staged:
        return self.levels[-1]

    def grow(self) -> None:
        depth = len(self.levels)
        self.visited.add(self.last.df.select("id"))
        fresh = (
            self.last.df.select(F.col("id").alias("prev"))
            .join(self.hops, "prev")
            .groupBy("id")
            .agg(F.min("prev").alias("prev"))
            .join(self.visited.all(), "id", "left_anti")
            .select("id", F.lit(depth).cast("long").alias("depth"), "prev")
        )
        self.levels.append(stage(fresh, "bfs"))


def _hops(edges: DataFrame, near: str, far: str) -> DataFrame:
    return edges.select(F.col(near).alias("prev"), F.col(far).alias("id"))


def call_chain_depth(
    symbols: DataFrame, edges: DataFrame, start: str, max_depth: int | None = 10
) -> DataFrame:
    """(id, depth) of everything reachable from ``start``, itself at 0; empty when unknown."""
    front = _Front(symbols.where(F.col("id") == F.lit(start)), _hops(edges, "source_id", "target_id"))
    while front.last.rows and (max_depth is None or len(front.levels) <= max_depth):
        front.grow()
    return _union([level.df for level in front.levels]).select("id", "depth")


def shortest_call_path(
    symbols: DataFrame,
    edges: DataFrame,
    start: str,
    goal: str,
    edges_by_target: DataFrame | None = None,
) -> DataFrame:
    """(step, id) of a path with the fewest edges; no rows when there is none.

    Two searches run, one from either end, and the smaller frontier grows, so a hub far from both is
    not reached. From the level where they meet on, the nodes between it and the goal get their
    predecessors level by level. The way back is read one row a step: no plan grows with the path.
    Ties take the smallest predecessor, so the result is deterministic. ``edges_by_target`` may hold
    the same edges in a layout for the search from the goal.
    """
    spark = symbols.sparkSession
    forth = _Front(symbols.where(F.col("id") == F.lit(start)).limit(1), _hops(edges, "source_id", "target_id"))
    into = edges if edges_by_target is None else edges_by_target
    back = _Front(spark.range(1).select(F.lit(goal).alias("id")), _hops(into, "target_id", "source_id"))
    nothing = spark.createDataFrame([], "step long, id string")
    while True:
        if not forth.last.rows or not back.last.rows:
            return nothing
        # Both levels are the newest of their side: they meet when the depths add up to the distance.
        meeting = stage(forth.last.df.select("id").join(back.last.df, "id", "left_semi"), "meeting")
        if meeting.rows:
            break
        min(forth, back, key=lambda side: side.last.rows).grow()
    before = []
    on_path = meeting.df
    for level in reversed(back.levels[:-1]):
        found = (
            on_path.select(F.col("id").alias("prev"))
            .join(forth.hops, "prev")
            .join(level.df, "id", "left_semi")
            .groupBy("id")
            .agg(F.min("prev").alias("prev"))
        )
        on_path = stage(found, "on_path").df
        before.append(on_path)
    path = [goal]
    for step in [*reversed(before), *(level.df for level in reversed(forth.levels[1:]))]:
        path.append(step.where(F.col("id") == F.lit(path[-1])).first()["prev"])
    return spark.createDataFrame(list(enumerate(reversed(path))), "step long, id string")


class TooManyPaths(RuntimeError):
    """A search for cycles passed the number of open paths it was given."""


def peel(graph: DataFrame, rounds: int | None = None) -> Staged:
    """Drop edges that lie on no cycle because an end has in- or out-degree 0, until stable.

    Exact for cycle search whether or not ``rounds`` stops it early.
    """
    current = stage(graph, "peel")
    while current.rows and rounds != 0:
        g = current.df
        entered = g.select(F.col("target_id").alias("source_id"))
        left = g.select(F.col("source_id").alias("target_id"))
        smaller = stage(
            g.join(entered, "source_id", "left_semi")
            .join(left, "target_id", "left_semi")
            .select("source_id", "target_id"),
            "peel",
        )
        done = smaller.rows == current.rows
        current = smaller
        if done:
            break
        rounds = None if rounds is None else rounds - 1
    return current


def find_cycles(
    edges: DataFrame,
    max_len: int | None = None,
    peel_rounds: int | None = None,
    max_paths: int | None = None,
) -> DataFrame:
    """(length, cycle): each elementary cycle once, written from its smallest id, joined by ``>``.

    Paths grow from a root over larger ids only and close on the root. ``max_len`` bounds the
    number of nodes in a cycle; without it the search runs until no path can grow. The number of
    elementary cycles can be exponential, which is a property of the question: ``max_paths`` is a
    guard that raises :class:`TooManyPaths` when more paths than that are open at one length, instead
    of returning a part of the cycles.
    """
    graph = stage(simple_digraph(edges), "digraph").df
    loops = graph.where(F.col("source_id") == F.col("target_id")).select(
        F.lit(1).cast("long").alias("length"), F.col("source_id").alias("cycle")
    )
    core = peel(graph.where(F.col("source_id") != F.col("target_id")), peel_rounds)
    if max_len is not None and max_len < 2 or not core.rows:
        return loops
    hops = core.df.select(F.col("source_id").alias("last"), F.col("target_id").alias("next"))
    paths = core.df.where(F.col("target_id") > F.col("source_id")).select(
        F.col("source_id").alias("root"),
        F.col("target_id").alias("last"),
        F.array("source_id", "target_id").alias("path"),
    )
    found = [loops]
    length = 2
    while True:
        grown = stage(paths, "paths")
        if not grown.rows:
            break
        if max_paths is not None and grown.rows > max_paths:
            raise TooManyPaths(f"{grown.rows} open paths of {length} nodes, {max_paths} allowed")
        closing = core.df.select(
            F.col("source_id").alias("last"), F.col("target_id").alias("root")
        )
        found.append(
            grown.df.join(closing, ["last", "root"]).select(
                F.lit(length).cast("long").alias("length"),
                F.array_join("path", ">").alias("cycle"),
            )
        )
        if length == max_len:
            break
        paths = (
            grown.df.join(hops, "last")
            .where((F.col("next") > F.col("root")) & ~F.array_contains("path", F.col("next")))
            .select(
                "root",
                F.col("next").alias("last"),
                F.array_append("path", F.col("next")).alias("path"),
            )
        )
        length += 1
    return _union(found)


def _spread_max(labels: DataFrame, graph: DataFrame) -> DataFrame:
    """Every node takes the largest label that reaches it along ``graph`` (source_id, target_id)."""
    current = stage(labels, "labels").df
    while True:
        spread = current.select("id", F.col("label").alias("own"), "label")
        # Two steps to a job: half the jobs, and the plan stays short.
        for _ in range(2):
            pushed = spread.select(F.col("id").alias("source_id"), "label").join(graph, "source_id")
            spread = (
                spread.unionByName(
                    pushed.select(
                        F.col("target_id").alias("id"), F.lit(None).cast("string").alias("own"), "label"
                    )
                )
                .groupBy("id")
                .agg(F.max("own").alias("own"), F.max("label").alias("label"))
            )
        moved = F.sum(F.when(F.col("label") > F.col("own"), 1).otherwise(0))
        step = stage(spread, "labels", moved=moved)
        current = step.df.select("id", "label")
        if not step.metrics["moved"]:
            return current


def _reach_back(graph: DataFrame, colours: DataFrame) -> DataFrame:
    """Nodes of each colour that lead back to the colour's own root: one component per root."""
    same = (
        graph.join(colours.select(F.col("id").alias("source_id"), F.col("label").alias("a")), "source_id")
        .join(colours.select(F.col("id").alias("target_id"), F.col("label").alias("b")), "target_id")
        .where(F.col("a") == F.col("b"))
        .select("source_id", "target_id")
    )
    inner = stage(same, "colour").df
    level = stage(colours.where(F.col("id") == F.col("label")).select("id", "label"), "back")
    visited = Visited()
    while level.rows:
        visited.add(level.df)
        fresh = (
            level.df.withColumnRenamed("id", "target_id")
            .join(inner, "target_id")
            .select(F.col("source_id").alias("id"), "label")
            .distinct()
            .join(visited.all().select("id"), "id", "left_anti")
        )
        level = stage(fresh, "back")
    return visited.all()


def _trimmed(graph: DataFrame) -> Staged:
    """The edges whose source is entered and whose target is left by some edge."""
    entered = graph.select(F.col("target_id").alias("source_id"))
    left = graph.select(F.col("source_id").alias("target_id"))
    return stage(
        graph.join(entered, "source_id", "left_semi")
        .join(left, "target_id", "left_semi")
        .select("source_id", "target_id"),
        "trim",
    )


class _Contracted(NamedTuple):
    """A graph without its chains: ``members`` (id, source_id, target_id) lay on the edge named,
    ``rings`` (id, component) were cycles of chain nodes alone, ``loops`` (id) now lead to themselves."""

    edges: DataFrame
    members: DataFrame
    rings: DataFrame
    loops: DataFrame


def _contract(graph: DataFrame) -> _Contracted | None:
    """Chains, nodes with one way in and one way out, become edges; None if there are none.

    Each chain node learns the end of its chain by pointer doubling: the reach of a pointer doubles
    with every job. One that is still on the way after as many steps as there are chain nodes goes
    round in a ring, and has met every node of it.
    """
    one, none = F.lit(1), F.lit(0)
    ends = graph.select(F.col("source_id").alias("id"), none.alias("i"), one.alias("o")).unionByName(
        graph.select(F.col("target_id").alias("id"), one.alias("i"), none.alias("o"))
    )
    degrees = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    chain = stage(degrees.where("i = 1 AND o = 1").select("id"), "chain")
    if not chain.rows:
        return None
    onward = chain.df.select(F.col("id").alias("next"), F.lit(True).alias("open"))
    is_open = F.coalesce("open", F.lit(False)).alias("open")
    first = (
        graph.withColumnsRenamed({"source_id": "id", "target_id": "next"})
        .join(chain.df, "id", "left_semi")
        .join(onward, "next", "left")
        .select("id", F.col("id").alias("last"), "next", F.col("id").alias("best"), is_open)
    )
    count = F.sum(F.col("open").cast("int"))
    pointers = stage(first, "pointers", open=count)
    for _ in range(chain.rows.bit_length()):
        if not pointers.metrics["open"]:
            break
        ahead = pointers.df.select(*(F.col(c).alias(f"a_{c}") for c in pointers.df.columns))
        moved = pointers.df.join(ahead, F.col("open") & (F.col("next") == F.col("a_id")), "left").select(
            "id",
            F.coalesce("a_last", "last").alias("last"),
            F.coalesce("a_next", "next").alias("next"),
            F.greatest("best", "a_best").alias("best"),
            F.coalesce("a_open", "open").alias("open"),
        )
        pointers = stage(moved, "pointers", open=count)
    closed = pointers.df.where("NOT open").select("id", "last", F.col("next").alias("end"))
    others = graph.join(chain.df.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    heads = stage(
        others.join(closed.withColumnRenamed("id", "target_id"), "target_id").select("source_id", "last", "end"),
        "heads",
    ).df
    plain = others.join(chain.df.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    edges = stage(
        plain.select("source_id", "target_id")
        .unionByName(heads.select("source_id", F.col("end").alias("target_id")))
        .distinct(),
        "contracted",
    ).df
    members = closed.select("id", "last").join(heads, "last")
    return _Contracted(
        edges.where("source_id <> target_id"),
        stage(members.select("id", "source_id", F.col("end").alias("target_id")), "members").df,
        pointers.df.where("open").select("id", F.col("best").alias("component")),
        edges.where("source_id = target_id").select(F.col("source_id").alias("id")),
    )


def _colour(graph: DataFrame) -> list[DataFrame]:
    """(id, component) of the cycles of a graph, found by colouring.

    The largest id that reaches a node is its colour; the nodes of a colour that lead back to the
    colour's root form one component. Components found are removed and the rest is peeled again,
    until nothing is left.
    """
    found, rest = [], peel(graph)
    while rest.rows:
        nodes = rest.df.select(F.col("source_id").alias("id")).unionByName(
            rest.df.select(F.col("target_id").alias("id"))
        )
        colours = _spread_max(nodes.distinct().withColumn("label", F.col("id")), rest.df)
        components = stage(_reach_back(rest.df, colours), "component").df
        sizes = components.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(
            components.join(sizes, "label", "left_semi").select(
                "id", F.col("label").alias("component")
            )
        )
        gone = components.select("id")
        rest = peel(
            rest.df.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
            .join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
            .select("source_id", "target_id")
        )
    return found


def cyclic_symbols(edges: DataFrame) -> DataFrame:
    """(id, component): symbols that lie on a cycle, labelled by their strongly connected component.

    Dead ends are trimmed and chains contracted in turn, which takes few rounds however long they
    are; what is left, where every node branches, is coloured. Then the chains are unfolded, last
    one first: their nodes lie on a cycle if both ends of the chain are in one component. The
    component label is its largest id.
    """
    graph = stage(simple_digraph(edges), "digraph").df
    loops = graph.where("source_id = target_id").select(F.col("source_id").alias("id"))
    levels: list[_Contracted] = []
    rest, size = graph.where("source_id <> target_id"), -1
    while True:
        trimmed = _trimmed(rest)
        if not trimmed.rows:
            found = []
            break
        contracted = _contract(trimmed.df)
        if contracted is not None:
            levels.append(contracted)
            rest, size = contracted.edges, -1
        elif trimmed.rows == size:
            found = _colour(trimmed.df)
            break
        else:
            rest, size = trimmed.df, trimmed.rows
    known = graph.where(F.lit(False)).select(F.col("source_id").alias("id"), F.col("target_id").alias("component"))
    known = _union([known, *found])
    for level in reversed(levels):
        known = _with_loops(known.unionByName(level.rings), level.loops)
        a = known.select(F.col("id").alias("source_id"), "component")
        b = known.select(F.col("id").alias("target_id"), F.col("component").alias("other"))
        inside = level.members.join(a, "source_id").join(b, "target_id").where("component = other")
        known = stage(known.unionByName(inside.select("id", "component")), "cyclic").df
    known = stage(_with_loops(known, loops), "cyclic").df
    names = known.groupBy("component").agg(F.max("id").alias("name"))
    return known.join(names, "component").select("id", F.col("name").alias("component"))


def _with_loops(known: DataFrame, loops: DataFrame) -> DataFrame:
    """A node that leads to itself is a component, unless it is in a larger one."""
    alone = loops.join(known.select("id"), "id", "left_anti")
    return known.unionByName(alone.select("id", F.col("id").alias("component")))


def top_symbols_by_calls(symbols: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Symbols by in-degree, descending, id as the tie-break; uncalled symbols count as 0.

    The top is taken on the degree table, so only ``limit`` rows meet the symbol table. Uncalled
    symbols are looked up only when there are fewer called ones than ``limit``.
    """
    wanted = ("id", "name", "kind", "file_path")
    degrees = simple_digraph(edges).groupBy(F.col("target_id").alias("id")).agg(
        F.count(F.lit(1)).alias("callers")
    )
    top = stage(degrees.orderBy(F.desc("callers"), "id").limit(limit), "top")
    called = top.df.join(symbols.select(*wanted), "id").select(*wanted, "callers")
    if top.rows < limit:
        uncalled = (
            symbols.join(edges.select(F.col("target_id").alias("id")), "id", "left_anti")
            .orderBy("id")
            .limit(limit - top.rows)
        )
        called = called.unionByName(
            uncalled.select(*wanted, F.lit(0).cast("long").alias("callers"))
        )
    return called.orderBy(F.desc("callers"), "id")
