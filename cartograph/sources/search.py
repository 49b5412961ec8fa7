"""Layouts for lookups: what a search reads instead of every symbol.

``by_id`` has the symbols in the order of their ids, ``by_path`` in the order of their folded paths, so
that a literal range skips files and row groups. ``postings`` has one row for each group of three
characters (gram) of each folded name, in the order of the grams, and ``grams`` says how many. A
pattern with three plain characters in a row reads the postings of its rarest gram; as they carry the
name, the exact pattern is applied to them at once and nothing has to be intersected.

Second sort keys split a frequent gram, such as that of a common prefix, over several files.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartograph.functions.text import ascii_fold, folded
from cartograph.schema import SYMBOLS

GRAM = 3

_BY_PATH = T.StructType([*SYMBOLS.fields, T.StructField("folded_path", T.StringType(), False)])
_POSTINGS = "gram STRING, name STRING, kind STRING"
_GRAMS = "gram STRING, n BIGINT"


class Lookups(NamedTuple):
    by_id: DataFrame
    by_name: DataFrame
    by_path: DataFrame
    postings: DataFrame
    grams: DataFrame


def _write(frame: DataFrame, path: str, *order: str) -> None:
    frame.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def grams_of(name: Column) -> Column:
    """The distinct grams of the folded name; none of a name with fewer characters."""
    text = ascii_fold(name)
    places = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    cut = F.array_distinct(F.transform(places, lambda at: F.substring(text, at, F.lit(GRAM))))
    return F.when(F.length(text) >= GRAM, cut)


def plain_grams(pattern: str) -> list[str]:
    """The grams that every match of the pattern has: those of its runs without ``%`` and ``_``."""
    runs = folded(pattern).replace("_", "%").split("%")
    return sorted({run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})


def write_lookups(symbols: DataFrame, path: str) -> Lookups:
    """Write the layouts of ``symbols``, a table that is read several times, below ``path``."""
    spark = symbols.sparkSession
    symbols = symbols.select(*SYMBOLS.names)
    _write(symbols, f"{path}/by_id", "id")
    _write(symbols, f"{path}/by_name", "name", "id")
    by_path = symbols.withColumn("folded_path", ascii_fold(F.col("file_path")))
    _write(by_path, f"{path}/by_path", "folded_path", "line_start", "id")
    # Names repeat, so they are counted out before they are cut.
    names = symbols.select("name", "kind").distinct()
    cut = names.select(F.explode(grams_of(F.col("name"))).alias("gram"), "name", "kind")
    _write(cut, f"{path}/postings", "gram", "name", "kind")
    postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    _write(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), f"{path}/grams", "gram")
    return open_lookups(spark, path)


def open_lookups(spark: SparkSession, path: str) -> Lookups:
    """What :func:`write_lookups` wrote, also by another session."""

    def read(table: str, schema: T.StructType | str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/{table}")

    return Lookups(
        read("by_id", SYMBOLS),
        read("by_name", SYMBOLS),
        read("by_path", _BY_PATH),
        read("postings", _POSTINGS),
        read("grams", _GRAMS),
    )
