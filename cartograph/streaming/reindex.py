"""Keep a store up to date from a stream of file versions.

Each micro-batch takes the newest version of every path in it, leaves out those that are not newer
than the version in the store, and replaces the rows of the others; a null content deletes the
file. Every batch is a version of one bucketed store: it writes the buckets that its files change and
shares the rest with the version before. A replayed batch writes the same again, and a missing
predecessor is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartograph.plans import incremental
from cartograph.plans.index import newest_sources
from cartograph.session import stage
from cartograph.sources import buckets, store

VERSIONS = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("content", T.StringType(), True),
        T.StructField("modified", T.LongType(), False),
    ]
)


def latest(spark: SparkSession, base: str) -> store.Index:
    """The store after the last batch that was written in whole."""
    done = spark.read.schema("batch long").parquet(f"{base}/done").agg(F.max("batch")).first()[0]
    return incremental.as_index(buckets.load(spark, base, done))


def _newer(batch: DataFrame, files: DataFrame) -> DataFrame:
    known = files.select(F.col("path").alias("known"), F.col("modified").alias("before"))
    joined = batch.join(known, batch["path"] == known["known"], "left")
    return joined.where("before IS NULL OR modified > before").select("path", "content", "modified")


def apply_batch(base: str):
    """``foreachBatch`` function: version n is version n - 1 with the batch's files replaced.

    It reads only the version before, so running a batch twice gives the same result.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = newest_sources(batch)
        if batch_id == 0:
            incremental.replace_paths(buckets.empty(spark, base), stage(versions, "batch").df)
        else:
            before = buckets.load(spark, base, batch_id - 1)
            known = before.read("files", before.dirty("files", batch.select("path")))
            incremental.replace_paths(before, stage(_newer(versions, known), "batch").df)
        spark.createDataFrame([(batch_id,)], "batch long").write.mode("append").parquet(f"{base}/done")

    return run


def start(spark: SparkSession, versions_dir: str, base: str, checkpoint: str, files_per_batch: int = 1000):
    """Process everything that has arrived in ``versions_dir`` (Parquet of :data:`VERSIONS`)."""
    stream = (
        spark.readStream.schema(VERSIONS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(versions_dir)
    )
    return (
        stream.writeStream.foreachBatch(apply_batch(base))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
