"""Shared-folder staging: how iterative jobs cut their lineage.

A level of a loop is written once as Parquet below the folder the cluster names in
``spark.checkpoint.dir`` and read back. That survives lost executors, gives later joins true
sizes (so Catalyst itself decides when a side is small enough to broadcast), and keeps the plan
of each level short.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own only on a local master."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="cartograph-")
    return _own_dirs[sc.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Staged(NamedTuple):
    df: DataFrame
    rows: int
    metrics: dict


def stage(df: DataFrame, label: str = "stage", **metrics: Column) -> Staged:
    """Write ``df`` to the shared folder in one job, counting its rows on the way.

    ``metrics`` are further aggregates taken during the same write.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    seen = Observation()
    aggregates = [F.count(F.lit(1)).alias("rows")] + [c.alias(n) for n, c in metrics.items()]
    # Staged copies of whole texts are large; this codec keeps them a third smaller.
    df.observe(seen, *aggregates).write.option("compression", "zstd").parquet(path)
    found = seen.get
    return Staged(spark.read.schema(df.schema).parquet(path), found["rows"], found)


class Visited:
    """What a level loop has reached so far.

    Levels stay as they were staged; every eighth one folds the lot into one table, so that an
    anti-join reads a few folders however long the loop runs, and rows are rewritten rarely.
    """

    FOLD = 8

    def __init__(self) -> None:
        self._frames: list[DataFrame] = []

    def add(self, frame: DataFrame) -> None:
        self._frames.append(frame)
        if len(self._frames) > self.FOLD:
            self._frames = [stage(self.all(), "visited").df]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self._frames)
