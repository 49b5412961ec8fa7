"""Lookups, traversals and analytics on small graphs with known answers, and general properties."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cartograph.operators import analytics, lookup, resolve, trace
from cartograph.schema import SYMBOLS
from cartograph.sources import adjacency


def make_symbols(spark, rows):
    """rows: (id, name, kind, file_path, line_start)"""
    full = [(i, n, k, p, line, line + 1, f"{k} {n}", None, "null") for i, n, k, p, line in rows]
    return spark.createDataFrame(full, SYMBOLS)


def make_edges(spark, pairs, kind="calls"):
    rows = [p if len(p) == 3 else (*p, kind) for p in pairs]
    return spark.createDataFrame(rows, "source_id string, target_id string, kind string")


@pytest.fixture(scope="module")
def graph(spark):
    nodes = "abcdefxy"
    symbols = make_symbols(spark, [(n, f"fn_{n}", "function", "src/m.py", i + 1) for i, n in enumerate(nodes)])
    # a -> b -> c -> a is a cycle, c -> d -> e, e -> e a loop, a -> d also by defines, x -> a.
    edges = make_edges(
        spark,
        [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "e"), ("x", "a"),
         ("a", "b", "defines"), ("a", "d", "defines")],
    )
    return symbols, edges


def pairs(rows, *cols):
    return sorted(tuple(r[c] for c in cols) for r in rows.collect())


def test_direct_callers_and_callees(graph):
    symbols, edges = graph
    assert pairs(trace.trace_callers(symbols, edges, "a"), "id") == [("c",), ("x",)]
    assert pairs(trace.trace_callees(symbols, edges, "c"), "id") == [("a",), ("d",)]
    assert trace.trace_callers(symbols, edges, "nobody").count() == 0


def test_depths_keep_one_row_per_walk_length(graph):
    symbols, edges = graph
    got = pairs(trace.trace_callees(symbols, edges, "a", 4), "id", "depth")
    assert got == [("a", 3), ("b", 1), ("b", 4), ("c", 2), ("d", 3), ("e", 4)]
    assert pairs(trace.trace_callees(symbols, edges, "a", 0), "id", "depth") == [("b", 1)]
    assert pairs(trace.trace_callees(symbols, edges, "e", 3), "id", "depth") == [
        ("e", 1), ("e", 2), ("e", 3)]


def test_min_depth_holds_the_seed_on_a_cycle(graph):
    symbols, edges = graph
    got = pairs(trace.trace_min_depth(symbols, edges, "a", trace.CALLEES, 12), "id", "depth")
    assert got == [("a", 3), ("b", 1), ("c", 2), ("d", 3), ("e", 4)]


def test_batch_equals_single_traversals(graph, spark):
    symbols, edges = graph
    seeds = spark.createDataFrame([("a",), ("d",), ("nobody",)], "seed_id string")
    batch = trace.trace_batch(symbols, edges, seeds, trace.CALLEES, 3)
    single = [
        (seed, *row) for seed in ("a", "d")
        for row in pairs(trace.trace_callees(symbols, edges, seed, 3), "id", "depth")
    ]
    assert pairs(batch, "seed_id", "id", "depth") == sorted(single)


@pytest.mark.parametrize("direction", [trace.CALLERS, trace.CALLEES])
@pytest.mark.parametrize("hub", [1, adjacency.HUB])
def test_buckets_give_the_same_traversal(graph, spark, tmp_path, direction, hub):
    symbols, edges = graph
    seeds = spark.createDataFrame([("a",), ("d",), ("e",), ("nobody",)], "seed_id string")
    hops = adjacency.write_adjacency(edges, *trace.ends(direction), f"{tmp_path}/hops", hub=hub)
    # Where a bucket takes one edge a node, those with more are hubs.
    count = Counter(r[trace.ends(direction)[0]] for r in edges.where("kind = 'calls'").collect())
    assert {r["id"] for r in hops.hubs.collect()} == {n for n, k in count.items() if k > hub}
    by_id = adjacency.write_symbols(symbols, f"{tmp_path}/symbols")
    want = pairs(trace.trace_batch(symbols, edges, seeds, direction, 4), "seed_id", "id", "depth", "name")
    assert pairs(trace.trace_batch(by_id, hops, seeds, direction, 4), "seed_id", "id", "depth", "name") == want
    again = adjacency.open_adjacency(spark, f"{tmp_path}/hops", 8)
    assert pairs(trace.walk_levels(again, "a", direction, 3), "id", "depth") == pairs(
        trace.walk_levels(edges, "a", direction, 3), "id", "depth")


def exchanges_above(plan: str, table: str) -> list[str]:
    """The operators over the scan of ``table``, up to the join it feeds, that move rows."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "Scan" in line and table in line)
    column, found = len(lines[at]) - len(lines[at].lstrip(" :+-*(0123456789)")), []
    for line in reversed(lines[:at]):
        depth = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        if depth < column:
            column = depth
            if "Join" in line:
                break
            found.append(line)
    return [line for line in found if "Exchange" in line]


def test_a_level_shuffles_the_frontier_only(graph, spark, tmp_path):
    symbols, edges = graph
    hops = adjacency.write_adjacency(edges, *trace.ends(trace.CALLERS), f"{tmp_path}/hops")
    by_id = adjacency.write_symbols(symbols, f"{tmp_path}/symbols")
    frontier = spark.createDataFrame([("a", "a"), ("b", "a")], "id string, seed_id string")
    name = lambda frame: frame._jdf.queryExecution().analyzed().toString().split("spark_catalog.default.")[1][:43]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table, joined in ((hops.plain, hops.step(frontier)), (by_id, trace._with_symbols(frontier, by_id))):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
            assert "Exchange hashpartitioning" in plan
            assert exchanges_above(plan, name(table)) == [], plan
        # The same question to a table without buckets moves its edges.
        flat = trace._Plain(trace._hops(edges, trace.CALLERS)).step(frontier)
        assert flat._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_loop_equals_recursive_sql(graph, spark):
    symbols, edges = graph
    edges.createOrReplaceTempView("edges_v")
    rows = spark.sql("""
      WITH RECURSIVE walk(id, depth) AS (
        SELECT target_id, 1 FROM edges_v WHERE source_id = 'x' AND kind = 'calls'
        UNION ALL SELECT e.target_id, depth + 1 FROM walk JOIN edges_v e ON e.source_id = walk.id
        WHERE e.kind = 'calls' AND depth < 5)
      SELECT DISTINCT id, depth FROM walk""")
    assert pairs(trace.trace_callees(symbols, edges, "x", 5), "id", "depth") == pairs(rows, "id", "depth")


def test_shortest_path(graph):
    symbols, edges = graph
    path = lambda a, b: [r.id for r in analytics.shortest_call_path(symbols, edges, a, b).orderBy("step").collect()]
    assert path("x", "e") == ["x", "a", "d", "e"]
    assert path("a", "a") == ["a"]
    assert path("e", "a") == []
    assert path("nobody", "a") == path("a", "nobody") == []


def test_paths_from_both_ends_against_brute_force(spark):
    rng = random.Random(8)
    for size in (6, 9):
        nodes = [chr(97 + i) for i in range(size)]
        links = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(2 * size)})
        symbols = make_symbols(spark, [(n, n, "function", "m.py", 1) for n in nodes])
        edges = make_edges(spark, links)
        start, depth = nodes[0], {nodes[0]: 0}
        for k in range(size):
            for a, b in links:
                if depth.get(a) == k:
                    depth.setdefault(b, k + 1)
        for goal in nodes[1:4]:
            want = [goal] if goal in depth else []
            while want and want[0] != start:
                want.insert(0, min(a for a, b in links if b == want[0] and depth.get(a) == depth[b] - 1))
            got = analytics.shortest_call_path(symbols, edges, start, goal)
            assert pairs(got, "step", "id") == list(enumerate(want))


def test_a_long_path_does_not_make_a_long_plan(spark):
    nodes = [f"n{i:02}" for i in range(25)]
    symbols = make_symbols(spark, [(n, n, "function", "m.py", 1) for n in nodes])
    path = analytics.shortest_call_path(symbols, make_edges(spark, list(zip(nodes, nodes[1:]))), nodes[0], nodes[-1])
    assert pairs(path, "step", "id") == list(enumerate(nodes))
    assert "Join" not in path._jdf.queryExecution().executedPlan().toString()


def test_path_length_is_bfs_depth(graph):
    symbols, edges = graph
    depths = dict(pairs(analytics.call_chain_depth(symbols, edges, "x"), "id", "depth"))
    assert depths == {"x": 0, "a": 1, "b": 2, "d": 2, "c": 3, "e": 3}
    assert dict(pairs(analytics.call_chain_depth(symbols, edges, "x", 1), "id", "depth")) == {"x": 0, "a": 1}
    assert analytics.call_chain_depth(symbols, edges, "nobody").count() == 0
    for goal, depth in depths.items():
        assert analytics.shortest_call_path(symbols, edges, "x", goal).count() == depth + 1


def test_cycles(graph, spark):
    _, edges = graph
    assert pairs(analytics.find_cycles(edges), "length", "cycle") == [(1, "e"), (3, "a>b>c")]
    dense = make_edges(spark, [(a, b) for a in "abcd" for b in "abcd" if a != b])
    cycles = [r.cycle.split(">") for r in analytics.find_cycles(dense).collect()]
    # Elementary cycles of the complete digraph on 4 nodes: 6 pairs, 8 triangles, 6 of length 4.
    assert len(cycles) == len({tuple(c) for c in cycles}) == 20
    edge_set = {(a, b) for a in "abcd" for b in "abcd" if a != b}
    for c in cycles:
        assert c[0] == min(c) and len(set(c)) == len(c)
        assert all((x, y) in edge_set for x, y in zip(c, c[1:] + c[:1]))
    assert analytics.find_cycles(dense, max_len=2).count() == 6
    assert analytics.find_cycles(dense, max_paths=100).count() == 20
    with pytest.raises(analytics.TooManyPaths):
        analytics.find_cycles(dense, max_paths=5)
    assert analytics.find_cycles(dense, max_len=3, peel_rounds=0).count() == 14


def test_cyclic_symbols(graph, spark):
    _, edges = graph
    assert pairs(analytics.cyclic_symbols(edges), "id", "component") == [
        ("a", "c"), ("b", "c"), ("c", "c"), ("e", "e")]
    # Two cycles joined by a bridge are two components, and the bridge is in none.
    two = make_edges(spark, [("a", "b"), ("b", "a"), ("b", "m"), ("m", "p"), ("p", "q"), ("q", "p")])
    assert pairs(analytics.cyclic_symbols(two), "id", "component") == [
        ("a", "b"), ("b", "b"), ("p", "q"), ("q", "q")]


def test_long_chain_and_ring(spark):
    ring = [(f"n{i:02d}", f"n{(i + 1) % 12:02d}") for i in range(12)]
    tail = [(f"t{i:02d}", f"t{i + 1:02d}") for i in range(12)] + [("t12", "n00")]
    edges = make_edges(spark, ring + tail)
    symbols = make_symbols(spark, [(n, n, "function", "f.py", 1) for n in {x for e in ring + tail for x in e}])
    assert analytics.cyclic_symbols(edges).count() == 12
    assert analytics.call_chain_depth(symbols, edges, "t00", 100).count() == 25
    assert analytics.find_cycles(edges).count() == 1


def test_top_symbols_counts_pairs_once_and_fills_with_zero(graph):
    symbols, edges = graph
    top = [(r.id, r.callers) for r in analytics.top_symbols_by_calls(symbols, edges, 4).collect()]
    assert top == [("a", 2), ("d", 2), ("e", 2), ("b", 1)]
    every = [(r.id, r.callers) for r in analytics.top_symbols_by_calls(symbols, edges).collect()]
    assert every[-3:] == [("f", 0), ("x", 0), ("y", 0)] and len(every) == 8


def test_like_semantics(spark):
    names = ["get_item", "GETTER", "getXitem", "back\\slash", "percent%sign", "É", "é", "plain"]
    symbols = make_symbols(spark, [(n, n, "function", "a.py", 1) for n in names])
    hits = lambda q: {r.name for r in lookup.search_symbol(symbols, q, fuzzy=True).collect()}
    assert hits("get") == {"get_item", "GETTER", "getXitem"}
    assert hits("GET_ITEM") == {"get_item", "getXitem"}
    assert hits("\\") == {"back\\slash"}
    assert hits("t%sign") == {"percent%sign"}
    assert hits("é") == {"é"}
    assert {r.name for r in lookup.search_symbol(symbols, "getter").collect()} == set()
    assert lookup.search_symbol(symbols, "", fuzzy=True, limit=3).count() == 3
    assert lookup.search_symbol(symbols, "plain", kind="class").count() == 0


def test_prefix_takes_text_not_components(spark):
    paths = ["src/a.py", "SRC/b.py", "src2/c.py", "lib/src/d.py", "s_c/e.py"]
    symbols = make_symbols(spark, [(p, p, "function", p, 1) for p in paths])
    under = lambda p: {r.file_path for r in lookup.under_path(symbols, p).collect()}
    assert under("src/") == {"src/a.py", "SRC/b.py", "src2/c.py"}
    assert under("s_c") == {"src/a.py", "SRC/b.py", "src2/c.py", "s_c/e.py"}
    assert under("") == set(paths)


def test_resolution_order(spark):
    symbols = make_symbols(
        spark,
        [("b.py::run", "run", "function", "b.py", 1), ("a.py::run", "run", "function", "a.py", 9),
         ("a.py::main", "main", "function", "a.py", 1), ("odd", "a.py::main", "function", "z.py", 1)],
    )
    raw = spark.createDataFrame(
        [("a.py::main", "run", "calls"), ("b.py::run", "a.py::main", "calls"), ("a.py", "os", "imports"),
         ("a.py::main", "gone", "calls"), ("a.py::main", "run", "calls")],
        "source string, target string, kind string",
    )
    got = pairs(resolve.resolve_edges(raw, symbols), "source_id", "target_id")
    assert got == [("a.py::main", "a.py::run"), ("b.py::run", "a.py::main")]
    lost = pairs(resolve.unresolved_edges(raw, symbols), "source", "target", "missing")
    assert lost == [("a.py", "os", "source"), ("a.py::main", "gone", "target")]
    assert resolve.imports_of(raw).count() == 1


def test_duplicate_ids_prefer_the_method(spark):
    rows = [("i", "f", "function", "a.py", 1), ("i", "f", "method", "a.py", 5), ("i", "f", "method", "a.py", 3)]
    kept = resolve.dedup_nodes(make_symbols(spark, rows)).collect()
    assert [(r.kind, r.line_start, r.properties) for r in kept] == [("method", 3, '{"duplicates":3}')]


def test_subgraph_and_dangling(graph, spark):
    symbols, edges = graph
    ids = spark.createDataFrame([("a",), ("b",), ("d",)], "id string")
    assert pairs(lookup.subgraph(edges, ids), "source_id", "target_id", "kind") == [
        ("a", "b", "calls"), ("a", "b", "defines"), ("a", "d", "defines")]
    broken = edges.unionByName(make_edges(spark, [("a", "zz"), ("zz", "a")]))
    assert pairs(resolve.dangling_edges(broken, symbols), "source_id", "target_id", "missing") == [
        ("a", "zz", "target"), ("zz", "a", "source")]
    assert resolve.valid_edges(broken, symbols).count() == edges.count()


def test_hub_node(spark):
    """A third of all edges on one node: traversal and counts stay whole."""
    n = 3000
    hub = spark.range(n).select(F.format_string("s%04d", "id").alias("source_id"), F.lit("hub").alias("target_id"))
    rest = spark.range(2 * n).select(
        F.format_string("s%04d", F.col("id") % n).alias("source_id"),
        F.format_string("s%04d", (F.col("id") * 7 + 1) % n).alias("target_id"))
    edges = hub.unionByName(rest).withColumn("kind", F.lit("calls")).distinct()
    symbols = make_symbols(spark, [(f"s{i:04d}", "s", "function", "f.py", 1) for i in range(n)] + [("hub", "hub", "function", "f.py", 1)])
    assert trace.trace_callers(symbols, edges, "hub").count() == n
    assert analytics.top_symbols_by_calls(symbols, edges, 1).first().callers == n


def test_hot_keys_of_resolution_are_split(spark):
    """With 80% of the rows on one key the final plan splits that partition of the join."""
    low = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in low}
    n = 200_000
    hot = F.when(F.col("id") % 5 == 0, F.concat(F.lit("f"), F.col("id") % 1000)).otherwise(F.lit("len"))
    symbols = spark.range(1000).select(
        F.concat(F.lit("m.py::f"), "id").alias("id"), F.concat(F.lit("f"), "id").alias("name"), F.lit("function").alias("kind"),
        F.lit("m.py").alias("file_path"), F.col("id").alias("line_start"), F.col("id").alias("line_end"),
        F.lit("").alias("signature"), F.lit(None).cast("string").alias("docstring"), F.lit("").alias("properties"),
    )
    symbols = symbols.unionByName(symbols.limit(1).withColumns({"id": F.lit("m.py::len"), "name": F.lit("len")}))
    source = F.concat(F.lit("m.py::f"), F.col("id") % 1000)
    raw = spark.range(n).select(
        source.alias("source"), hot.alias("target"), F.concat(F.lit("k"), "id").alias("kind"), F.lit("m.py").alias("file_path")
    )
    edges = raw.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "kind")
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        for frame in (resolve.resolve_edges(raw, symbols), resolve.in_adjacency(edges)):
            frame.write.format("noop").mode("overwrite").save()
            frame.collect()
            assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_of_a_long_ring_and_tail_take_few_jobs(spark, monkeypatch):
    n = 1000
    ring = [(f"r{i:04d}", f"r{(i + 1) % n:04d}") for i in range(n)]
    tail = [(f"t{i:04d}", f"t{i + 1:04d}") for i in range(n)] + [("r0007", "t0000"), ("x", "r0003"), ("x", "x")]
    lone = [(f"p{i}", f"p{(i + 1) % 7}") for i in range(7)]
    jobs, real = [], analytics.stage
    monkeypatch.setattr(analytics, "stage", lambda *a, **k: jobs.append(1) or real(*a, **k))
    got = pairs(analytics.cyclic_symbols(make_edges(spark, ring + tail + lone)), "id", "component")
    assert got == sorted([(f"r{i:04d}", "r0999") for i in range(n)] + [(f"p{i}", "p6") for i in range(7)] + [("x", "x")])
    assert len(jobs) <= 30


def test_components_against_brute_force(spark):
    import random

    rng = random.Random(8)
    for size, links in ((30, 40), (60, 70), (25, 80)):
        edges = {(f"n{rng.randrange(size)}", f"n{rng.randrange(size)}") for _ in range(links)}
        reach = {a: {t for s, t in edges if s == a} for a, _ in edges}
        for _ in range(size):
            reach = {a: r | {y for x in r for y in reach.get(x, ())} for a, r in reach.items()}
        want = sorted(
            (a, max(b for b in r if a in reach.get(b, ()))) for a, r in reach.items() if a in r
        )
        assert pairs(analytics.cyclic_symbols(make_edges(spark, sorted(edges))), "id", "component") == want
