"""Bucketed layouts for traversals: what stays in place while the frontier is shuffled.

The edges of a traversal are written in buckets of the hash of their near end, symbols in buckets of
their id. A level joins on that column, so only the frontier moves. A bucket can't be split, which
hub nodes would need: the edges of nodes with more than ``HUB`` of them are a table of their own,
ordered by both ends, whose joins Spark may split or broadcast as it sees fit.

The files are Parquet at a path of the caller's; the buckets are known to the session by a table that
is registered when the layout is opened, in any later session as well.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.schema import SYMBOLS
from cartograph.session import stage

#: Edges of one node that a bucket may hold; a few hundred megabytes of ids at most.
HUB = 1 << 20


class Adjacency(NamedTuple):
    """Hops (id, next) of one direction: those of ordinary nodes in buckets, those of hubs apart."""

    plain: DataFrame
    hubs: DataFrame

    def step(self, frontier: DataFrame) -> DataFrame:
        """``frontier``, a frame with an ``id``, with the ``next`` of each of its hops."""
        return frontier.join(self.plain, "id").unionByName(frontier.join(self.hubs, "id"))

    def of(self, node: str) -> DataFrame:
        """The hops of one node; the literal reaches both scans, and one bucket is read."""
        near = F.col("id") == F.lit(node)
        return self.plain.where(near).unionByName(self.hubs.where(near))


def write_bucketed(frame: DataFrame, path: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write ``frame`` in ``buckets`` by the hash of ``key``, sorted in each, and open it.

    The default is the session's number of shuffle partitions: with fewer Spark would rather
    shuffle both sides of a join.
    """
    spark = frame.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"cartograph_{uuid.uuid4().hex}"
    # One task a bucket, so a bucket is one file.
    by_key = frame.repartition(buckets, key)
    by_key.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """What :func:`write_bucketed` wrote with these arguments, also by another session."""
    name = f"cartograph_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
        f"INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def write_adjacency(
    edges: DataFrame, near: str, far: str, path: str, kind: str = "calls", hub: int = HUB, buckets: int | None = None
) -> Adjacency:
    """The hops from ``near`` to ``far`` over edges of one kind."""
    spark = edges.sparkSession
    hops = edges.where(F.col("kind") == kind).select(F.col(near).alias("id"), F.col(far).alias("next"))
    # At most one row for every ``hub`` edges: small enough to be told to all tasks, which Spark sees.
    many = stage(hops.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub).select("id"), "hubs").df
    plain = write_bucketed(hops.join(many, "id", "left_anti"), f"{path}/plain", "id", buckets)
    of_hubs = hops.join(many, "id", "left_semi").repartitionByRange("id", "next").sortWithinPartitions("id", "next")
    of_hubs.write.parquet(f"{path}/hubs")
    return Adjacency(plain, spark.read.schema(of_hubs.schema).parquet(f"{path}/hubs"))


def open_adjacency(spark: SparkSession, path: str, buckets: int) -> Adjacency:
    schema = "id STRING, next STRING"
    return Adjacency(
        open_bucketed(spark, f"{path}/plain", schema, "id", buckets), spark.read.schema(schema).parquet(f"{path}/hubs")
    )


def write_symbols(symbols: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Symbols in buckets by id, for lookups of many ids at once."""
    return write_bucketed(symbols.select(*SYMBOLS.names), path, "id", buckets)
