"""Indexing what changed: new versions of a bucketed store, with resolution of the difference only.

A change replaces the rows of some files. What their symbols were and are now tells which keys (ids
and names) stand for something else than before: ids that came or went, and names whose first symbol
is another one. Only raw edges of the changed files, and those elsewhere that name such a key, are
resolved again; all others keep their target. The buckets these rows are in are written anew.

Reads: the buckets of the changed files and of the names in them, and of the raw edges of all other
files the target and the path. A full index is the change of an empty store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.operators.extract import Extraction, extract
from cartograph.operators.resolve import dedup_nodes, key_lookup, name_index, resolved_rows
from cartograph.schema import META, RAW_EDGES, SYMBOLS
from cartograph.session import stage
from cartograph.sources import buckets, discovery, store

_KEY = ("source_id", "target_id", "kind")


def create(
    spark: SparkSession, sources: DataFrame, base: str, files: DataFrame | None = None, n_buckets: int = buckets.BUCKETS
) -> buckets.Store:
    """Version 0 of a store; ``files`` are all that were discovered, if more than ``sources``."""
    listed = stage(store.file_rows(sources if files is None else files), "listed").df
    return _next(buckets.empty(spark, base, n_buckets), extract(sources), listed.select("path"), listed)


def replace_paths(before: buckets.Store, sources: DataFrame) -> buckets.Store:
    """The next version: exactly the files in ``sources`` are replaced; a null content deletes one."""
    files = stage(store.file_rows(sources.withColumn("deleted", F.col("content").isNull())), "listed").df
    found = extract(sources.where("content IS NOT NULL"))
    return _next(before, found, files.select("path"), files)


def replace_scope(before: buckets.Store, sources: DataFrame, scope: str) -> buckets.Store:
    """The next version: the files below one folder are those of ``sources``, and others stay."""
    inside = sources.where(discovery.in_scope(F.col("path"), scope))
    files = stage(store.file_rows(inside), "listed").df
    was = before.read("files").where(discovery.in_scope(F.col("path"), scope)).select("path")
    return _next(before, extract(inside), files.select("path").unionByName(was).distinct(), files)


def as_index(held: buckets.Store, project_root: str = "") -> store.Index:
    """The tables of a version, for lookups, traversals and analytics. Counts come from the manifest."""
    rows = store.meta_rows(held.rows("symbols"), held.rows("files"), project_root)
    read = held.read
    return store.Index(
        read("symbols"),
        read("symbols_by_name"),
        read("edges_by_source"),
        read("edges_by_target"),
        read("raw_edges").select(*RAW_EDGES.names),
        read("files"),
        held.spark.createDataFrame(rows, META),
    )


def _without(rows: DataFrame, path: str, changed: DataFrame) -> DataFrame:
    return rows.join(changed, rows[path] == changed["changed"], "left_anti")


def _next(before: buckets.Store, found: Extraction, paths: DataFrame, files: DataFrame) -> buckets.Store:
    """The version in which all rows of ``paths`` are those of ``found`` and ``files``."""
    after = before._replace(version=before.version + 1)
    changed = stage(paths.select(F.col("path").alias("changed")).distinct(), "changed").df
    fresh = stage(dedup_nodes(found.symbols).select(*SYMBOLS.names), "symbols").df
    raw = stage(found.raw_edges.select(*RAW_EDGES.names).distinct(), "raw").df
    mine = after.dirty("files", changed)

    after = after.write(
        "files", _without(before.read("files", mine), "path", changed).unionByName(files), mine, ~F.col("deleted")
    )
    old = before.read("symbols", mine)
    gone = stage(old.join(changed, old["file_path"] == changed["changed"], "left_semi"), "gone").df
    after = after.write("symbols", _without(old, "file_path", changed).unionByName(fresh), mine)

    names = stage(gone.select("name").unionByName(fresh.select("name")).distinct(), "names").df
    named = after.dirty("symbols_by_name", names)
    was = before.read("symbols_by_name", named)
    after = after.write("symbols_by_name", _without(was, "file_path", changed).unionByName(fresh), named)

    moved = stage(_moved_keys(was, after.read("symbols_by_name", named), names, gone, fresh), "moved").df
    stays = _without(before.read("raw_edges"), "file_path", changed)
    again = stays.join(moved, stays["target"] == moved["key"], "left_semi").select(*RAW_EDGES.names)
    todo = stage(raw.unionByName(again), "unresolved").df
    touched = mine | after.dirty("raw_edges", todo.select("file_path"))
    kept = _without(before.read("raw_edges", touched), "file_path", changed)
    kept = kept.join(moved, kept["target"] == moved["key"], "left_anti")
    after = after.write("raw_edges", kept.unionByName(_resolve(after, todo)), touched)

    edges = (
        after.read("raw_edges", touched)
        .where("target_id IS NOT NULL")
        .select(F.col("source").alias("source_id"), "target_id", "kind")
        .distinct()
    )
    edges = stage(edges, "edges").df
    replaced = before.read("edges_by_source", touched)
    after = after.write("edges_by_source", edges, touched)
    return _retarget(before, after, replaced, edges).commit()


def _moved_keys(was: DataFrame, now: DataFrame, names: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """(key): ids that came or went, and names of which another symbol is the first one now."""

    def first(rows: DataFrame, as_name: str) -> DataFrame:
        return name_index(rows.join(names, "name", "left_semi")).withColumnRenamed("id", as_name)

    both = first(was, "old").join(first(now, "new"), "name", "full")
    by_name = both.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.col("name").alias("key"))
    came, went = fresh.select(F.col("id").alias("key")), gone.select(F.col("id").alias("key"))
    by_id = came.join(went, "key", "left_anti").unionByName(went.join(came, "key", "left_anti"))
    return by_name.unionByName(by_id).distinct()


def _resolve(held: buckets.Store, raw: DataFrame) -> DataFrame:
    """Raw edges with their target's id; reads only the buckets that can hold their keys."""
    targets = stage(raw.select(F.col("target").alias("key")).distinct(), "targets").df
    keys = stage(targets.unionByName(raw.select(F.col("source").alias("key"))).distinct(), "keys").df
    homes = held.dirty("symbols", keys.where(F.col("key").contains("::")).select(buckets.path_of(F.col("key")).alias("path")))
    ids = held.read("symbols", homes).select("id")
    ids = ids.join(keys, ids["id"] == keys["key"], "left_semi")
    named = held.read("symbols_by_name", held.dirty("symbols_by_name", targets))
    named = named.join(targets, named["name"] == targets["key"], "left_semi")
    return resolved_rows(raw, key_lookup(ids, name_index(named)))


def _retarget(before: buckets.Store, after: buckets.Store, old: DataFrame, new: DataFrame) -> buckets.Store:
    """The copy that is sorted by target: edges that went are taken out of their buckets, others put in."""
    went = stage(old.join(new, list(_KEY), "left_anti"), "edges-gone").df
    came = stage(new.join(old, list(_KEY), "left_anti"), "edges-new").df
    touched = after.dirty("edges_by_target", went.select("target_id").unionByName(came.select("target_id")))
    kept = before.read("edges_by_target", touched).join(went, list(_KEY), "left_anti")
    return after.write("edges_by_target", kept.unionByName(came), touched)
