"""The Parquet store: write and read."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.schema import EDGES, FILES, META, RAW_EDGES, SCHEMA_VERSION, SYMBOLS
from cartograph.session import stage

# Second keys split a frequent first key over several files.
_LAYOUTS = {
    "symbols": (SYMBOLS, ("file_path", "line_start", "id")),
    "symbols_by_name": (SYMBOLS, ("name", "id")),
    "raw_edges": (RAW_EDGES, ("file_path", "source", "target")),
    "files": (FILES, ("path",)),
    "edges_by_source": (EDGES, ("source_id", "target_id")),
    "edges_by_target": (EDGES, ("target_id", "source_id")),
}


class Index(NamedTuple):
    symbols: DataFrame
    symbols_by_name: DataFrame
    edges: DataFrame
    edges_by_target: DataFrame
    raw_edges: DataFrame
    files: DataFrame
    meta: DataFrame


def meta_rows(symbols: int, files: int, project_root: str) -> list[tuple[str, str]]:
    """The five key/value rows; files are those discovered, with or without symbols."""
    return [
        ("schema_version", SCHEMA_VERSION),
        ("project_root", project_root),
        ("indexed_at", str(int(time.time()))),
        ("file_count", str(files)),
        ("symbol_count", str(symbols)),
    ]


def _write(frame: DataFrame, path: str, table: str) -> None:
    schema, order = _LAYOUTS[table]
    (
        frame.select(*schema.names)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .parquet(f"{path}/{table}")
    )


def write_index(
    path: str,
    symbols: DataFrame,
    edges: DataFrame,
    raw_edges: DataFrame,
    files: DataFrame,
    project_root: str = "",
) -> Index:
    """Write all tables; of ``files`` a missing ``modified`` or ``deleted`` is filled in. Edges are written twice, sorted by either end, so lookups prune both ways."""
    spark = symbols.sparkSession
    # Range partitioning samples its input first; a staged one is not computed twice for that.
    edges = stage(edges, "edges").df
    _write(symbols, path, "symbols")
    # Sorted by name, a lookup by exact name reads the row groups that hold it.
    _write(spark.read.schema(SYMBOLS).parquet(f"{path}/symbols"), path, "symbols_by_name")
    _write(raw_edges, path, "raw_edges")
    _write(edges, path, "edges_by_source")
    _write(spark.read.schema(EDGES).parquet(f"{path}/edges_by_source"), path, "edges_by_target")
    _write(file_rows(files), path, "files")
    written = spark.read.schema(SYMBOLS).parquet(f"{path}/symbols").count()
    present = spark.read.schema(FILES).parquet(f"{path}/files").where("NOT deleted").count()
    meta = spark.createDataFrame(meta_rows(written, present, project_root), META)
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return load_index(spark, path)


def file_rows(files: DataFrame) -> DataFrame:
    """(path, modified, deleted) of a table that may have the path only."""
    missing = {"modified": F.lit(None).cast("long"), "deleted": F.lit(False)}
    return files.select("path", *(F.col(c) if c in files.columns else v.alias(c) for c, v in missing.items()))


def load_index(spark: SparkSession, path: str) -> Index:
    read = lambda table, schema: spark.read.schema(schema).parquet(f"{path}/{table}")
    return Index(
        read("symbols", SYMBOLS),
        read("symbols_by_name", SYMBOLS),
        read("edges_by_source", EDGES),
        read("edges_by_target", EDGES),
        read("raw_edges", RAW_EDGES),
        read("files", FILES),
        read("meta", META),
    )
