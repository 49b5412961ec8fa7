"""Catalog entries for lookups, traversals, resolution and analytics (graphs P, R and S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.operators import analytics, lookup, resolve, trace
from cartograph.plans import derived
from cartograph.plans.catalog import query
from cartograph.plans.derived import Tables
from cartograph.session import new_path
from cartograph.sources import adjacency, search, store

# ---------------------------------------------------------------- stored graphs

_stored: dict[tuple[str, str, str], str] = {}


def _index(spark: SparkSession, sf_dir: str, graph: str) -> store.Index:
    """Graph P or S as a store, written once per application and scale, then read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir, graph)
    if key not in _stored:
        t = Tables(spark, sf_dir)
        path = new_path(spark, f"graph-{graph}")
        if graph == "P":
            symbols, edges = derived.graph_p_symbols(t), derived.graph_p_edges(t)
        else:
            symbols, edges = derived.graph_s_symbols(t), derived.graph_s_edges(t)
        raw = edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "kind")
        raw = raw.join(
            symbols.select(F.col("id").alias("source"), "file_path").distinct(), "source"
        )
        files = symbols.select(F.col("file_path").alias("path")).distinct()
        store.write_index(path, symbols, edges, raw, files, "/project")
        _stored[key] = path
    return store.load_index(spark, _stored[key])


def graph_p(spark: SparkSession, sf_dir: str) -> store.Index:
    return _index(spark, sf_dir, "P")


def graph_s(spark: SparkSession, sf_dir: str) -> store.Index:
    return _index(spark, sf_dir, "S")


_buckets: dict[tuple[str, str], tuple[DataFrame, adjacency.Adjacency]] = {}


def _bucketed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, adjacency.Adjacency]:
    """Symbols and callers of graph P in buckets, written once per application and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _buckets:
        p, path = graph_p(spark, sf_dir), new_path(spark, "buckets-P")
        near, far = trace.ends(trace.CALLERS)
        callers = adjacency.write_adjacency(p.edges_by_target, near, far, f"{path}/callers")
        _buckets[key] = adjacency.write_symbols(p.symbols, f"{path}/symbols"), callers
    return _buckets[key]


_searches: dict[tuple[str, str], str] = {}


def lookups_p(spark: SparkSession, sf_dir: str) -> search.Lookups:
    """Lookup layouts of graph P, written once per application and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _searches:
        path = new_path(spark, "lookups-P")
        search.write_lookups(graph_p(spark, sf_dir).symbols, path)
        _searches[key] = path
    return search.open_lookups(spark, _searches[key])


# ---------------------------------------------------------------- SQL of the same graphs

def _sym(table: str, kind: str, prefix: str, key: str, name: str, path: str) -> str:
    return f"""
  SELECT '{prefix}::' || {key} AS id, {name} AS name, '{kind}' AS kind, {path} AS file_path,
    CAST(({key} % 5000) * 10 + 1 AS BIGINT) AS line_start,
    CAST(({key} % 5000) * 10 + 1 + {key} % 9 AS BIGINT) AS line_end,
    '{kind} ' || {name} AS signature,
    CASE WHEN {key} % 2 = 0 THEN 'doc ' || {name} END AS docstring, 'null' AS properties
  FROM {table}"""


P_SYMBOLS = "psym AS (" + " UNION ALL ".join(
    [
        _sym("part", "function", "part", "p_partkey", "replace(p_name, ' ', '_')",
             "'src/part/' || replace(p_brand, '#', '_') || '/m' || (p_partkey // 5000) || '.py'"),
        _sym("supplier", "class", "supplier", "s_suppkey", "replace(s_name, '#', '_')",
             "'src/supplier/nation_' || s_nationkey || '/m' || (s_suppkey // 5000) || '.ts'"),
        _sym("customer", "struct", "customer", "c_custkey", "replace(c_name, '#', '_')",
             "'src/customer/' || c_mktsegment || '/m' || (c_custkey // 1000) || '.rs'"),
        _sym("nation", "interface", "nation", "n_nationkey", "n_name",
             "'src/nation/region_' || n_regionkey || '.go'"),
        _sym("region", "method", "region", "r_regionkey", "r_name", "'src/region/all.go'"),
    ]
) + ")"

_NP = "((l_partkey * 5 + l_suppkey * 3 + l_linenumber) % (SELECT count(*) FROM part))"

P_EDGES = f"""pedge AS (
  SELECT 'part::' || l_partkey AS source_id, 'part::' || {_NP} AS target_id, 'calls' AS kind FROM lineitem
  UNION SELECT 'customer::' || o_custkey, 'part::' || (o_orderkey % (SELECT count(*) FROM part)), 'calls' FROM orders
  UNION SELECT 'supplier::' || l_suppkey, 'part::' || l_partkey, 'defines' FROM lineitem WHERE l_linenumber = 1
  UNION SELECT 'nation::' || n_nationkey, 'region::' || n_regionkey, 'defines' FROM nation)"""

R_RAW = f"""raw AS (
  SELECT CASE WHEN l_linenumber % 4 = 3 THEN 'src/part/p' || l_partkey || '.py' ELSE 'part::' || l_partkey END AS source,
    CASE l_linenumber % 4 WHEN 0 THEN 'supplier::' || l_suppkey
      WHEN 1 THEN (SELECT replace(p_name, ' ', '_') FROM part WHERE p_partkey = {_NP})
      WHEN 2 THEN 'ext_' || l_suppkey ELSE 'mod_' || l_suppkey END AS target,
    CASE WHEN l_linenumber % 4 = 3 THEN 'imports' ELSE 'calls' END AS kind
  FROM lineitem)"""

S_EDGES = """sedge AS (
  SELECT DISTINCT 'supplier::' || l_suppkey AS source_id,
    'supplier::' || ((e % 1000000000 * 7 + 3) % (SELECT count(*) FROM supplier)) AS target_id, 'calls' AS kind
  FROM (SELECT l_suppkey, min(l_orderkey * 1000000000 + l_partkey) AS e FROM lineitem GROUP BY l_suppkey
        UNION ALL
        SELECT l_suppkey, max(l_orderkey * 1000000000 + l_partkey) FROM lineitem
        WHERE l_suppkey % 5 = 0 GROUP BY l_suppkey))"""

RING_EDGES = """ring AS (
  SELECT 'supplier::' || k AS source_id, 'supplier::' || t AS target_id, 'calls' AS kind FROM (
    SELECT s_suppkey AS k, CASE WHEN s_suppkey % 15 = 14 OR s_suppkey + 1 = (SELECT count(*) FROM supplier)
      THEN s_suppkey - s_suppkey % 15 ELSE s_suppkey + 1 END AS t FROM supplier
    UNION SELECT s_suppkey, s_suppkey + 2 FROM supplier
    WHERE s_suppkey % 5 = 0 AND s_suppkey + 2 < (SELECT count(*) FROM supplier)))"""

COPIES = """copies AS (
  SELECT 'part::' || l_partkey AS id, 'f_' || l_partkey AS name,
    CASE WHEN l_linenumber % 3 = 0 THEN 'method' ELSE 'function' END AS kind,
    'src/p' || (l_partkey // 40) || '.py' AS file_path,
    CAST(l_linenumber * 10 + l_suppkey % 10 AS BIGINT) AS line_start,
    CAST(l_linenumber * 10 + l_suppkey % 10 + l_suppkey % 7 AS BIGINT) AS line_end
  FROM lineitem)"""

ROW = "id, name, kind, file_path, line_start, line_end, signature, docstring"
SROW = ", ".join("s." + c for c in ROW.split(", "))


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


_P = with_(P_SYMBOLS)
_PE = with_(P_SYMBOLS, P_EDGES)

# ---------------------------------------------------------------- resolution


@query("node_dedup", with_(COPIES) + """
SELECT id, name, kind, file_path, line_start, line_end, kind || ' ' || name AS signature,
  CAST(NULL AS VARCHAR) AS docstring,
  CASE WHEN n > 1 THEN '{"duplicates":' || n || '}' ELSE 'null' END AS properties
FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n,
  row_number() OVER (PARTITION BY id ORDER BY CASE WHEN kind = 'method' THEN 0 ELSE 1 END, line_start, line_end, kind) AS rn
  FROM copies) WHERE rn = 1""")
def node_dedup(spark, sf):
    return resolve.dedup_nodes(derived.copied_symbols(Tables(spark, sf)))


@query("name_index", _P + """
SELECT name, id FROM (SELECT name, id,
  row_number() OVER (PARTITION BY name ORDER BY file_path, line_start, id) AS rn FROM psym) WHERE rn = 1""")
def name_index(spark, sf):
    return resolve.name_index(graph_p(spark, sf).symbols)


_RESOLVE = """
, ni AS (SELECT name, id FROM (SELECT name, id,
    row_number() OVER (PARTITION BY name ORDER BY file_path, line_start, id) AS rn FROM psym) WHERE rn = 1),
draw AS (SELECT DISTINCT source, target, kind FROM raw),
res AS (SELECT r.source, r.target, r.kind, coalesce(x.id, ni.id) AS target_id
  FROM draw r JOIN psym s ON s.id = r.source LEFT JOIN psym x ON x.id = r.target LEFT JOIN ni ON ni.name = r.target)
"""
_PR = with_(P_SYMBOLS, R_RAW) + _RESOLVE


@query("resolve_edges", _PR + "SELECT DISTINCT source AS source_id, target_id, kind FROM res WHERE target_id IS NOT NULL")
def resolve_edges(spark, sf):
    return resolve.resolve_edges(derived.raw_edges_r(Tables(spark, sf)), graph_p(spark, sf).symbols)


@query("unresolved_edges", _PR + """
SELECT source, target, kind, 'target' AS missing FROM res WHERE target_id IS NULL
UNION ALL SELECT source, target, kind, 'source' FROM draw WHERE source NOT IN (SELECT id FROM psym)""")
def unresolved_edges(spark, sf):
    return resolve.unresolved_edges(derived.raw_edges_r(Tables(spark, sf)), graph_p(spark, sf).symbols)


@query("imports", with_(R_RAW) + "SELECT DISTINCT source AS file_path, target AS module FROM raw WHERE kind = 'imports'")
def imports(spark, sf):
    return resolve.imports_of(derived.raw_edges_r(Tables(spark, sf)))


@query("edge_dedup", f"""
SELECT DISTINCT 'part::' || l_partkey AS source_id, 'part::' || {_NP} AS target_id, 'calls' AS kind FROM lineitem""")
def edge_dedup(spark, sf):
    t = Tables(spark, sf)
    rows = t.lineitem.select(
        derived._tag("part", F.col("l_partkey")).alias("source_id"),
        derived._tag("part", derived._next_part(t)).alias("target_id"),
        F.lit("calls").alias("kind"),
    )
    return resolve.edge_dedup(rows)


@query("dangling_edges", with_(P_SYMBOLS, R_RAW) + """
SELECT source AS source_id, target AS target_id, kind, 'source' AS missing FROM (SELECT DISTINCT * FROM raw)
WHERE source NOT IN (SELECT id FROM psym)
UNION ALL SELECT source, target, kind, 'target' FROM (SELECT DISTINCT * FROM raw)
WHERE target NOT IN (SELECT id FROM psym)""")
def dangling_edges(spark, sf):
    raw = derived.raw_edges_r(Tables(spark, sf)).distinct()
    edges = raw.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "kind")
    return resolve.dangling_edges(edges, graph_p(spark, sf).symbols)


def _adjacency_sql(node: str, other: str) -> str:
    return with_(P_EDGES) + f"""
SELECT {node} AS node_id, {other} AS neighbour_id, kind, count(*) OVER (PARTITION BY {node}) AS degree FROM pedge"""


@query("out_adjacency", _adjacency_sql("source_id", "target_id"))
def out_adjacency(spark, sf):
    return resolve.out_adjacency(graph_p(spark, sf).edges)


@query("in_adjacency", _adjacency_sql("target_id", "source_id"))
def in_adjacency(spark, sf):
    return resolve.in_adjacency(graph_p(spark, sf).edges_by_target)


# ---------------------------------------------------------------- store


@query("store_roundtrip", with_(P_SYMBOLS) + """
SELECT id, name, kind, file_path, line_start, line_end, signature, docstring, properties FROM psym""")
def store_roundtrip(spark, sf):
    return graph_p(spark, sf).symbols


@query("meta_rows", with_(P_SYMBOLS) + """
SELECT 'schema_version' AS key, '1' AS value UNION ALL SELECT 'project_root', '/project'
UNION ALL SELECT 'file_count', CAST((SELECT count(DISTINCT file_path) FROM psym) AS VARCHAR)
UNION ALL SELECT 'symbol_count', CAST((SELECT count(*) FROM psym) AS VARCHAR)""")
def meta_rows(spark, sf):
    return graph_p(spark, sf).meta.where("key <> 'indexed_at'")


# ---------------------------------------------------------------- lookups


@query("search_exact", _P + f"SELECT {ROW} FROM psym WHERE name = 'blue_ring' ORDER BY name, id LIMIT 50")
def search_exact(spark, sf):
    return lookup.search_symbol(graph_p(spark, sf).symbols_by_name, "blue_ring")


@query("search_fuzzy", _P + f"""SELECT {ROW} FROM psym
WHERE translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%blue_r%ng%' ORDER BY name, id LIMIT 50""")
def search_fuzzy(spark, sf):
    return lookup.search_fuzzy(lookups_p(spark, sf), "BLUE_r%ng")


@query("search_kind", _P + f"""SELECT {ROW} FROM psym
WHERE lower(name) LIKE '%00%' AND kind = 'class' ORDER BY name, id LIMIT 20""")
def search_kind(spark, sf):
    return lookup.search_fuzzy(lookups_p(spark, sf), "00", kind="class", limit=20)


@query("get_symbol", _P + "SELECT * FROM psym WHERE id = 'part::7'")
def get_symbol(spark, sf):
    return lookup.get_symbol(lookups_p(spark, sf).by_id, "part::7")


@query("symbols_in_file", _P + f"SELECT {ROW} FROM psym WHERE file_path = 'src/nation/region_1.go'")
def symbols_in_file(spark, sf):
    return lookup.list_symbols_in_file(graph_p(spark, sf).symbols, "src/nation/region_1.go")


@query("file_summary", _P + """
SELECT kind, count(*) AS n, string_agg(name, ',' ORDER BY line_start, line_end, name, id) AS names
FROM psym WHERE file_path = 'src/part/Brand_7/m0.py' GROUP BY kind""")
def file_summary(spark, sf):
    rows = lookup.file_summary(graph_p(spark, sf).symbols, "src/part/Brand_7/m0.py")
    return rows.select("kind", "n", F.array_join("members.name", ",").alias("names"))


@query("list_files", _P + "SELECT DISTINCT file_path FROM psym")
def list_files(spark, sf):
    return lookup.list_files(graph_p(spark, sf).symbols)


@query("index_status", _PE + """
SELECT '1' AS schema_version, '/project' AS project_root, CAST(count(DISTINCT file_path) AS VARCHAR) AS file_count,
  count(*) AS symbol_count, count(DISTINCT file_path) AS indexed_file_count,
  (SELECT count(*) FROM pedge) AS edge_count FROM psym""")
def index_status(spark, sf):
    p = graph_p(spark, sf)
    return lookup.index_status(p.symbols, p.edges, p.meta).drop("indexed_at")


_ARCH = "SRC/Part/Brand_1"
_INSIDE = ", inside AS (SELECT * FROM psym WHERE lower(file_path) LIKE 'src/part/brand_1%')\n"


@query("architecture", _PE + _INSIDE + f"""
SELECT '{_ARCH}/' AS path, (SELECT count(*) FROM inside) AS total_symbols, count(*) AS internal_edges FROM pedge
WHERE source_id IN (SELECT id FROM inside) AND target_id IN (SELECT id FROM inside)""")
def architecture(spark, sf):
    return lookup.architecture(lookups_p(spark, sf).by_path, graph_p(spark, sf).edges, _ARCH + "/")


@query("architecture_by_kind", _P + """
SELECT kind, count(*) AS n FROM psym WHERE lower(file_path) LIKE 'src/%' GROUP BY kind""")
def architecture_by_kind(spark, sf):
    return lookup.architecture_by_kind(lookups_p(spark, sf).by_path, "src")


@query("architecture_rows", _P + _INSIDE + f"SELECT {ROW} FROM inside")
def architecture_rows(spark, sf):
    return lookup.architecture_rows(lookups_p(spark, sf).by_path, _ARCH)


_SMALL = ", small AS (SELECT id FROM psym WHERE line_start % 30 = 1)\n"


def _small(p: store.Index) -> DataFrame:
    return p.symbols.where("line_start % 30 = 1")


@query("internal_edges", _PE + _SMALL + """
SELECT count(*) AS internal_edges FROM pedge
WHERE source_id IN (SELECT id FROM small) AND target_id IN (SELECT id FROM small)""")
def internal_edges(spark, sf):
    p = graph_p(spark, sf)
    return lookup.internal_edges(p.edges, _small(p))


@query("subgraph", _PE + _SMALL + """
SELECT source_id, target_id, kind FROM pedge
WHERE source_id IN (SELECT id FROM small) AND target_id IN (SELECT id FROM small)""")
def subgraph(spark, sf):
    p = graph_p(spark, sf)
    return lookup.subgraph(p.edges, _small(p))


@query("result_json", _P + """
SELECT id, '{"id":"' || id || '","name":"' || name || '","kind":"' || kind || '","file_path":"' || file_path
  || '","line_start":' || line_start || ',"line_end":' || line_end || ',"signature":"' || signature || '"'
  || CASE WHEN docstring IS NULL THEN '' ELSE ',"docstring":"' || docstring || '"' END || '}' AS json
FROM psym""")
def result_json(spark, sf):
    return lookup.result_json(lookup.symbol_rows(graph_p(spark, sf).symbols))


# ---------------------------------------------------------------- traversals

_SEED = "part::7"


def _one_level(near: str, far: str) -> str:
    return _PE + f"""
SELECT {SROW} FROM psym s JOIN pedge e ON s.id = e.{far} WHERE e.{near} = '{_SEED}' AND e.kind = 'calls'"""


def _levels(near: str, far: str, depth: int) -> str:
    walk = f"""walk AS (
  SELECT {far} AS id, 1 AS depth FROM pedge WHERE {near} = '{_SEED}' AND kind = 'calls'
  UNION SELECT e.{far}, w.depth + 1 FROM walk w JOIN pedge e ON e.{near} = w.id
  WHERE e.kind = 'calls' AND w.depth < {depth})"""
    return with_(P_SYMBOLS, P_EDGES, walk, recursive=True)


def _all_depths(near: str, far: str, depth: int) -> str:
    return _levels(near, far, depth) + f"""
SELECT {SROW}, CAST(w.depth AS BIGINT) AS depth FROM psym s JOIN (SELECT DISTINCT id, depth FROM walk) w ON w.id = s.id"""


def _min_depth(near: str, far: str, depth: int) -> str:
    return _levels(near, far, depth) + f"""
SELECT {SROW}, CAST(w.depth AS BIGINT) AS depth FROM psym s
JOIN (SELECT id, min(depth) AS depth FROM walk GROUP BY id) w ON w.id = s.id"""


@query("callers_1", _one_level("target_id", "source_id"))
def callers_1(spark, sf):
    p = graph_p(spark, sf)
    return trace.trace_callers(p.symbols, p.edges_by_target, _SEED)


@query("callees_1", _one_level("source_id", "target_id"))
def callees_1(spark, sf):
    p = graph_p(spark, sf)
    return trace.trace_callees(p.symbols, p.edges, _SEED)


@query("callers_depth", _all_depths("target_id", "source_id", 3))
def callers_depth(spark, sf):
    p = graph_p(spark, sf)
    return trace.trace_callers(p.symbols, p.edges_by_target, _SEED, 3)


@query("callees_depth", _all_depths("source_id", "target_id", 3))
def callees_depth(spark, sf):
    p = graph_p(spark, sf)
    return trace.trace_callees(p.symbols, p.edges, _SEED, 3)


@query("callers_depth0", _all_depths("target_id", "source_id", 1))
def callers_depth0(spark, sf):
    p = graph_p(spark, sf)
    return trace.trace_callers(p.symbols, p.edges_by_target, _SEED, 0)


@query("callers_min_depth", _min_depth("target_id", "source_id", 3))
def callers_min_depth(spark, sf):
    p = graph_p(spark, sf)
    return trace.trace_min_depth(p.symbols, p.edges_by_target, _SEED, trace.CALLERS, 3)


@query("callees_min_depth", _min_depth("source_id", "target_id", 3))
def callees_min_depth(spark, sf):
    p = graph_p(spark, sf)
    return trace.trace_min_depth(p.symbols, p.edges, _SEED, trace.CALLEES, 3)


@query("find_references", _PE + f"""
SELECT {SROW}, e.kind AS edge_kind FROM psym s JOIN pedge e ON s.id = e.source_id WHERE e.target_id = '{_SEED}'""")
def find_references(spark, sf):
    p = graph_p(spark, sf)
    return trace.find_references(p.symbols, p.edges_by_target, _SEED)


@query("callers_batch", with_(P_SYMBOLS, P_EDGES, """walk AS (
  SELECT e.target_id AS seed_id, e.source_id AS id, 1 AS depth FROM pedge e
  WHERE e.kind = 'calls' AND e.target_id IN (SELECT id FROM psym WHERE name = 'blue_ring')
  UNION SELECT w.seed_id, e.source_id, w.depth + 1 FROM walk w JOIN pedge e ON e.target_id = w.id
  WHERE e.kind = 'calls' AND w.depth < 2)""", recursive=True) + f"""
SELECT {SROW}, CAST(w.depth AS BIGINT) AS depth, w.seed_id FROM psym s JOIN walk w ON w.id = s.id""")
def callers_batch(spark, sf):
    """Callers to depth 2 of every symbol of one name."""
    p = graph_p(spark, sf)
    seeds = p.symbols.where("name = 'blue_ring'").select(F.col("id").alias("seed_id"))
    symbols, callers = _bucketed(spark, sf)
    return trace.trace_batch(symbols, callers, seeds, trace.CALLERS, 2)


# ---------------------------------------------------------------- analytics

_S = with_(P_SYMBOLS, S_EDGES)


def _s_bfs(depth: int) -> str:
    return with_(S_EDGES, f"""walk AS (SELECT 'supplier::0' AS id, 0 AS depth
  UNION SELECT e.target_id, w.depth + 1 FROM walk w JOIN sedge e ON e.source_id = w.id WHERE w.depth < {depth}),
dist AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)""", recursive=True)


@query("chain_depth", _s_bfs(10) + "SELECT id, CAST(depth AS BIGINT) AS depth FROM dist")
def chain_depth(spark, sf):
    s = graph_s(spark, sf)
    return analytics.call_chain_depth(s.symbols, s.edges, "supplier::0", 10)


# The two ends of the path question on graph P.
_FROM, _TO = "part::0", "part::11"

_P_DIST = with_(P_EDGES, f"""g AS (SELECT DISTINCT source_id, target_id FROM pedge),
walk AS (SELECT '{_FROM}' AS id, 0 AS depth
  UNION SELECT e.target_id, w.depth + 1 FROM walk w JOIN g e ON e.source_id = w.id WHERE w.depth < 6),
dist AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)""", recursive=True)


@query("shortest_path", _P_DIST + f"""
SELECT '{_FROM}' AS start_id, '{_TO}' AS goal_id, CAST(depth AS BIGINT) AS edges FROM dist WHERE id = '{_TO}'""")
def shortest_path(spark, sf):
    steps = shortest_path_steps(spark, sf)
    return steps.groupBy().agg((F.count(F.lit(1)) - 1).alias("edges")).where("edges >= 0").select(
        F.lit(_FROM).alias("start_id"), F.lit(_TO).alias("goal_id"), "edges"
    )


@query("shortest_path_steps", with_(P_EDGES, f"""g AS (SELECT DISTINCT source_id, target_id FROM pedge),
walk AS (SELECT '{_FROM}' AS id, 0 AS depth
  UNION SELECT e.target_id, w.depth + 1 FROM walk w JOIN g e ON e.source_id = w.id WHERE w.depth < 6),
dist AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id),
parent AS (SELECT d.id, d.depth, min(p.id) AS prev FROM dist d JOIN g ON g.target_id = d.id
  JOIN dist p ON p.id = g.source_id AND p.depth = d.depth - 1 GROUP BY d.id, d.depth),
back AS (SELECT id, depth FROM dist WHERE id = '{_TO}'
  UNION SELECT p.prev, p.depth - 1 FROM back b JOIN parent p ON p.id = b.id)""", recursive=True) + """
SELECT CAST(depth AS BIGINT) AS step, id FROM back""")
def shortest_path_steps(spark, sf):
    p = graph_p(spark, sf)
    return analytics.shortest_call_path(p.symbols, p.edges, _FROM, _TO, p.edges_by_target)


@query("find_cycles", with_(RING_EDGES, """p AS (
  SELECT source_id AS root, target_id AS last, [source_id, target_id] AS path FROM ring WHERE target_id > source_id
  UNION ALL SELECT p.root, e.target_id, list_append(p.path, e.target_id) FROM p JOIN ring e ON e.source_id = p.last
  WHERE e.target_id > p.root AND NOT list_contains(p.path, e.target_id))""", recursive=True) + """
SELECT CAST(1 AS BIGINT) AS length, source_id AS cycle FROM ring WHERE source_id = target_id
UNION ALL SELECT CAST(len(path) AS BIGINT), array_to_string(path, '>')
FROM p JOIN ring e ON e.source_id = p.last AND e.target_id = p.root""")
def find_cycles(spark, sf):
    """All elementary cycles of a graph whose number of cycles grows with its nodes."""
    return analytics.find_cycles(derived.ring_edges(Tables(spark, sf)), peel_rounds=1)


@query("cyclic_symbols", with_(S_EDGES, """reach AS (
  SELECT source_id AS a, target_id AS b FROM sedge
  UNION SELECT r.a, e.target_id FROM reach r JOIN sedge e ON e.source_id = r.b)""", recursive=True) + """
SELECT x.a AS id, max(y.b) AS component FROM reach x JOIN reach y ON x.a = y.a JOIN reach z ON z.a = y.b AND z.b = x.a
WHERE x.a = x.b GROUP BY x.a""")
def cyclic_symbols(spark, sf):
    return analytics.cyclic_symbols(graph_s(spark, sf).edges)


@query("top_called", with_(P_SYMBOLS, P_EDGES) + """
SELECT s.id, s.name, s.kind, s.file_path, count(d.source_id) AS callers FROM psym s
LEFT JOIN (SELECT DISTINCT source_id, target_id FROM pedge) d ON d.target_id = s.id
GROUP BY s.id, s.name, s.kind, s.file_path ORDER BY callers DESC, s.id LIMIT 20""")
def top_called(spark, sf):
    p = graph_p(spark, sf)
    return analytics.top_symbols_by_calls(p.symbols, p.edges_by_target)
