"""The index pipeline: sources -> symbols and raw edges -> graph -> store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.functions.text import language_of
from cartograph.operators.extract import Extraction, extract
from cartograph.operators.resolve import dedup_nodes, resolve_edges
from cartograph.operators.tokens import ALL_LANGUAGES
from cartograph.schema import SYMBOLS
from cartograph.session import stage
from cartograph.sources import discovery, store


def newest_sources(versions: DataFrame) -> DataFrame:
    """One row per path: the latest of ``versions(path, content, modified)``.

    An aggregate, so many versions of one path shrink before the shuffle. Of two versions of one
    time a text wins over a deletion (a null content), and the larger text over the smaller.
    """
    latest = F.max(F.struct("modified", "content"))
    return versions.groupBy("path").agg(latest.alias("v")).select("path", "v.content", "v.modified")


def extract_status(sources: DataFrame, quarantine: DataFrame | None = None) -> DataFrame:
    """(path, lang, status) for every discovered file: extracted, unsupported or not text."""
    lang = language_of(F.col("path"))
    rows = sources.select(
        "path",
        lang.alias("lang"),
        F.when(lang.isNull(), "unsupported extension").otherwise("ok").alias("status"),
    )
    if quarantine is not None:
        rows = rows.unionByName(
            quarantine.select("path", lang.alias("lang"), F.col("reason").alias("status"))
        )
    return rows


def extract_summary(sources: DataFrame, found: Extraction) -> DataFrame:
    """(lang, files, symbols, raw_edges)."""
    files = sources.select(language_of(F.col("path")).alias("lang")).where("lang IS NOT NULL").groupBy(
        "lang"
    ).agg(F.count(F.lit(1)).alias("files"))
    symbols = found.symbols.groupBy(language_of(F.col("file_path")).alias("lang")).agg(
        F.count(F.lit(1)).alias("symbols")
    )
    edges = found.raw_edges.groupBy(language_of(F.col("file_path")).alias("lang")).agg(
        F.count(F.lit(1)).alias("raw_edges")
    )
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    # One row per language on every side.
    return files.join(symbols, "lang", "left").join(edges, "lang", "left").select(
        "lang", "files", zero("symbols"), zero("raw_edges")
    )


def index_sources(
    sources: DataFrame,
    out: str,
    project_root: str = "",
    files: DataFrame | None = None,
    languages: tuple[str, ...] = ALL_LANGUAGES,
) -> store.Index:
    """Full index of a source table, written to ``out``; ``files`` are all that were discovered."""
    found = extract(sources, languages)
    symbols = stage(dedup_nodes(found.symbols), "symbols").df
    raw = stage(found.raw_edges, "raw").df
    listed = sources if files is None else files
    return store.write_index(out, symbols, resolve_edges(raw, symbols), raw, listed, project_root)


def index_directory(
    spark: SparkSession, root: str, out: str, scope: str | None = None, use_ignore_files: bool = True
) -> tuple[store.Index, DataFrame]:
    """Discover, read and index the files below ``root``; returns the index and the quarantine."""
    walked = discovery.walk(spark, root)
    files = discovery.select_files(walked, root, scope)
    if use_ignore_files:
        files = discovery.drop_ignored(files, discovery.read_ignore_files(root, walked))
    files = stage(files, "files")
    good, bad = discovery.read_sources(root, files.df)
    # The listing has the files' times as timestamps, which are not versions.
    return index_sources(good, out, root, files.df.select("path")), bad


def reindex_scope(
    index: store.Index, sources: DataFrame, scope: str, out: str, project_root: str = ""
) -> store.Index:
    """Replace the rows of one folder by those of ``sources`` and keep the rest.

    ``sources`` are the folder's present files; what they no longer hold disappears.
    """

    def outside(rows: DataFrame, path: str) -> DataFrame:
        return rows.where(~discovery.in_scope(F.col(path), scope))

    inside = sources.where(discovery.in_scope(F.col("path"), scope))
    return _rebuild(index, outside, inside, inside, out, project_root)


def reindex_paths(
    index: store.Index, sources: DataFrame, out: str, project_root: str = ""
) -> store.Index:
    """Replace the rows of exactly the files in ``sources``.

    A null content deletes the file. A ``modified`` column is kept in the file table.
    """
    files = store.file_rows(sources.withColumn("deleted", F.col("content").isNull()))
    paths = files.select(F.col("path").alias("changed"))

    def others(rows: DataFrame, path: str) -> DataFrame:
        return rows.join(paths, rows[path] == paths["changed"], "left_anti")

    return _rebuild(index, others, sources.where("content IS NOT NULL"), files, out, project_root)


def _rebuild(index: store.Index, keep, sources: DataFrame, files: DataFrame, out: str, project_root: str) -> store.Index:
    """The rows of ``index`` that ``keep(rows, path column)`` leaves, and those of ``sources``.

    Resolution is global, so an edge outside the replaced files may get another target.
    """
    found = extract(sources)
    fresh = dedup_nodes(found.symbols).select(*SYMBOLS.names)
    symbols = stage(keep(index.symbols, "file_path").unionByName(fresh), "symbols").df
    raw = stage(keep(index.raw_edges, "file_path").unionByName(found.raw_edges), "raw").df
    listed = keep(index.files, "path").unionByName(store.file_rows(files))
    return store.write_index(out, symbols, resolve_edges(raw, symbols), raw, listed, project_root)
