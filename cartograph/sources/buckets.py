"""Copy-on-write buckets: a version of the store rewrites the buckets it changes and shares the rest.

Every table is cut into buckets by the hash of one column. A version writes the buckets it changes
below ``table/v=<version>/bucket=<number>``, and a manifest that says for every bucket of every table
which version holds it and how many rows that has. Files are never changed after they are written,
so readers of an older version are not disturbed, and a version that is written again after a failure
is the same. A manifest has at most as many rows as there are tables times buckets.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartograph.schema import EDGES, FILES, RAW_EDGES, SYMBOLS
from cartograph.session import stage

#: Raw edges with what their target stands for, or null.
RESOLVED = T.StructType([*RAW_EDGES.fields, T.StructField("target_id", T.StringType(), True)])


class Layout(NamedTuple):
    """Schema, the column whose hash is the bucket, and the order inside a bucket."""

    schema: T.StructType
    key: str
    order: tuple[str, ...]


LAYOUTS = {
    "symbols": Layout(SYMBOLS, "file_path", ("file_path", "line_start", "id")),
    "symbols_by_name": Layout(SYMBOLS, "name", ("name", "id")),
    "raw_edges": Layout(RESOLVED, "file_path", ("file_path", "source", "target")),
    "files": Layout(FILES, "path", ("path",)),
    # The bucket of an edge is that of its source's file, so a file's edges are distinct in one bucket.
    "edges_by_source": Layout(EDGES, "source_id", ("source_id", "target_id")),
    "edges_by_target": Layout(EDGES, "target_id", ("target_id", "source_id")),
}
MANIFEST = "name string, bucket int, held_by long, rows long"
BUCKETS = 32


def path_of(symbol_id: Column) -> Column:
    """The file of a symbol id: all before the last ``::``."""
    return F.regexp_extract(symbol_id, r"^([\s\S]*)::", 1)


class Store(NamedTuple):
    """One version: for each table, the version and the rows of every bucket."""

    spark: SparkSession
    base: str
    version: int
    buckets: int
    held: dict[str, dict[int, tuple[int, int]]]

    def bucket(self, table: str, key: Column | None = None) -> Column:
        key = F.col(LAYOUTS[table].key) if key is None else key
        if table == "edges_by_source":
            key = path_of(key)
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def dirty(self, table: str, keys: DataFrame) -> set[int]:
        """Buckets of the values in the one column of ``keys``."""
        (name,) = keys.columns
        return {r[0] for r in keys.select(self.bucket(table, F.col(name))).distinct().collect()}

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows of the table, or those of some buckets; other buckets' files are not listed."""
        held, schema = self.held[table], LAYOUTS[table].schema
        wanted = held if buckets is None else sorted(set(buckets) & set(held))
        paths = [f"{self.base}/{table}/v={held[b][0]}/bucket={b}" for b in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, table: str) -> int:
        return sum(rows for _, rows in self.held[table].values())

    def write(self, table: str, rows: DataFrame, buckets: set[int], counted: Column | None = None) -> Store:
        """This version with ``buckets`` of the table replaced by ``rows``, which belong to them.

        ``counted`` says which rows the manifest counts, if not all. A large bucket is split over
        several files by the second keys.
        """
        layout, to = LAYOUTS[table], f"{self.base}/{table}/v={self.version}"
        # Range partitioning samples its input first; a staged one is not computed twice for that.
        staged = stage(rows.select(*layout.schema.names, self.bucket(table).alias("bucket")), f"bucket-{table}")
        placed = dict(self.held[table])
        for b in buckets:
            placed.pop(b, None)
        if staged.rows:
            order = ["bucket", *layout.order]
            staged.df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(
                "bucket"
            ).parquet(to)
            # One row for each bucket.
            many = F.count(F.lit(1) if counted is None else F.when(counted, 1))
            for b, n in staged.df.groupBy("bucket").agg(many).collect():
                if b not in buckets:
                    raise ValueError(f"bucket {b} of {table} was not to be replaced")
                placed[b] = (self.version, n)
        return self._replace(held={**self.held, table: placed})

    def commit(self) -> Store:
        """Write the manifest: from now on this version can be loaded."""
        rows = [(t, b, v, n) for t, held in self.held.items() for b, (v, n) in held.items()]
        rows.append(("", self.buckets, self.version, 0))
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            manifest_path(self.base, self.version)
        )
        return self


def manifest_path(base: str, version: int) -> str:
    return f"{base}/manifest/v={version:09d}"


def empty(spark: SparkSession, base: str, buckets: int = BUCKETS) -> Store:
    """A store before its first version."""
    return Store(spark, base, -1, buckets, {t: {} for t in LAYOUTS})


def load(spark: SparkSession, base: str, version: int) -> Store:
    """A version that was committed; any other is an error."""
    rows = spark.read.schema(MANIFEST).parquet(manifest_path(base, version)).collect()
    held: dict[str, dict[int, tuple[int, int]]] = {t: {} for t in LAYOUTS}
    buckets = BUCKETS
    for r in rows:
        if r["name"]:
            held[r["name"]][r["bucket"]] = (r["held_by"], r["rows"])
        else:
            buckets = r["bucket"]
    return Store(spark, base, version, buckets, held)
