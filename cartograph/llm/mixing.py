"""Mixing sources to target weights: fixed-length blocks, drawn by shard, joined by index.

1. Targets. Sources take their weights in turn and share ``share`` times all words; a target stops
   at ``cap`` times its source's words, and what it leaves is shared again by weight until no target
   is above. Every round of that is one aggregate over the table of sources.
2. Blocks. The words of a source, document after document, are cut into blocks of ``block`` words;
   only its last one is shorter. A document's place in its source is a running sum: sums inside the
   partitions of one sort by (source, document), then a sum over partitions, so a source with a third
   of all rows spreads over a third of the partitions.
3. Draw. A source's slots are as many blocks as its target asks for. Output shards of ``SLOTS`` slots
   draw their multinomial counts of the sources one after the other, given what is left of the
   quotas, in draws of ``SHARDS`` shards that each hold an equal part of every quota. So the shards
   are random, but the totals are not: each source comes to its target to the word (the last slot is
   cut), and a capped one does not go beyond its cap.
4. Slots. Slot j of a source is block ``p(j mod n)`` of its n blocks, with one pseudorandom
   permutation p for each pass over them: a Feistel network on the index, which needs no sort.
   Slots and pieces of documents then meet in an equi-join on (source, block).

The result depends on the rows alone, not on how they are partitioned or where a task is repeated.

Cases: a null or empty text has no words and nothing is taken from it; a null source is a source of
its own, the last one; repeated rows are documents of their own, next to each other, and each gets a
row; a source without words has the target 0; an empty table gives an empty result; names of further
columns are free. A text of any length is cut into as many pieces as it needs. More than ``SOURCES``
sources are drawn in groups of that many, each with shards of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cartograph.session import stage

BLOCK = 128
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SLOTS = 4096
SHARDS = 64
SOURCES = 10_000
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"

_ROUNDS = 6


# ---------------------------------------------------------------- permutations


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every number (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray, back: bool = False) -> np.ndarray:
    """Place of ``index`` in the permutation of range(size) that ``seed`` names; ``back`` inverts it.

    The network works on the next power of four; a result beyond ``size`` goes through it again.
    """
    index, size, seed = (np.asarray(a, np.int64).astype(np.uint64) for a in (index, size, seed))
    if (index >= size).any():
        raise ValueError("an index beyond its permutation")
    # Half of the bits that hold size - 1, one at least.
    bits = np.frexp((size - np.uint64(1)).astype(np.float64))[1]
    half = np.maximum((bits + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.copy()
    todo = np.arange(len(out))
    rounds = range(_ROUNDS)
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, s = half[todo], mask[todo], seed[todo]
            left, right = out[todo] >> h, out[todo] & m
            for r in reversed(rounds) if back else rounds:
                salt = s + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)
                if back:
                    left, right = right ^ (_mixed(left ^ salt) & m), left
                else:
                    left, right = right, left ^ (_mixed(right ^ salt) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _permute(back: bool):
    @F.pandas_udf("long")
    def place(index: pd.Series, size: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), size.to_numpy(), seed.to_numpy(), back))

    return place


# ---------------------------------------------------------------- sources and targets


def ranked(frame: DataFrame, order: Column, name: str) -> DataFrame:
    """``frame`` with the place of each row in the order, without gathering it in one task."""
    spark = frame.sparkSession
    inside = F.monotonically_increasing_id()
    # The upper bits of that number are the partition, the lower 33 the row in it.
    sorted_ = frame.repartitionByRange(order).sortWithinPartitions(order).select(
        "*", F.shiftright(inside, 33).alias("part"), inside.bitwiseAND(F.lit((1 << 33) - 1)).alias("inside")
    )
    placed = stage(sorted_, "ranked").df
    # One row for each partition.
    counts, before, total = placed.groupBy("part").count().orderBy("part").collect(), [], 0
    for part, count in counts:
        before.append((part, total))
        total += count
    starts = spark.createDataFrame(before, "part long, before long")
    return placed.join(starts, "part").withColumn(name, F.col("before") + F.col("inside")).drop("part", "before", "inside")


def with_targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """``sources`` (rank, source_size, ...) with the column ``target``."""
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    known = stage(sources.withColumn("weight", turn.cast("double")), "mix-sources").df
    most = F.col("source_size") * cap
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") >= most if capped >= 0 else F.lit(False)
        sums = known.agg(
            F.count(F.when(full, 1)).alias("capped"),
            F.sum(F.when(full, most)).alias("held"),
            F.sum(F.when(~full, F.col("weight"))).alias("free"),
        ).first()
        if sums["capped"] == capped or not sums["free"]:
            break
        capped = sums["capped"]
        level = (share * total - (sums["held"] or 0.0)) / sums["free"]
    # With no free source left every one is at its cap.
    reached = F.least(most, F.lit(level) * F.col("weight")) if sums["free"] else most
    return known.withColumn("target", reached)


def with_quotas(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds n_blocks, tail (words of the last block), passes, slots and cut (words the last slot lacks)."""
    size, b = F.col("source_size"), F.lit(block).cast("long")
    whole = F.floor("target").cast("long")
    passes = F.when(size > 0, F.expr("floor(target) div source_size")).otherwise(0).cast("long")
    counted = sources.select(
        "*",
        F.ceil(size / b).cast("long").alias("n_blocks"),
        passes.alias("passes"),
        (whole - passes * size).alias("rest"),
    ).withColumn("tail", size - (F.col("n_blocks") - 1) * b)
    # Where the short block comes up in the pass that is not complete.
    last = F.greatest(F.col("n_blocks") - 1, F.lit(0))
    at = _permute(True)(last, F.greatest("n_blocks", F.lit(1)), pass_seed(F.col("rank"), F.col("passes")))
    placed = counted.withColumn("tail_at", F.when(F.col("n_blocks") > 0, at).otherwise(0))
    few = F.ceil(F.col("rest") / b).cast("long")
    short = F.when(F.col("tail_at") < few, b - F.col("tail")).otherwise(0)
    more = F.when(few * b - short < F.col("rest"), 1).otherwise(0)
    # One block more, if it is needed, is a full one: the short one is among the first already.
    words = few * b - short + more * b
    return placed.select(
        *sources.columns, "n_blocks", "tail",
        (F.col("passes") * F.col("n_blocks") + few + more).alias("slots"),
        (words - F.col("rest")).alias("cut"),
    )


def pass_seed(rank: Column, number: Column) -> Column:
    return F.xxhash64(F.lit(SEED), rank, number.cast("long"))


# ---------------------------------------------------------------- documents as pieces of blocks


def document_offsets(docs: DataFrame) -> DataFrame:
    """Adds ``offset``, the words of the source before the document. ``docs``: rid, doc_id, rank, size, ..."""
    order = ["rank", "doc_id", "size", "rid"]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("part", F.spark_partition_id())
    schema = T.StructType([*ordered.schema.fields, T.StructField("local", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rank, size = np.asarray(batch["rank"]), np.asarray(batch["size"])
            before = np.cumsum(size) - size
            heads = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            runs = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(rank)]))
            local = before - before[heads][runs]
            if rank[0] == last:
                local[runs == 0] += carried
            last, carried = rank[-1], int(local[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], schema=arrow)

    placed = stage(ordered.mapInArrow(run, schema), "mix-docs").df
    # One row for each partition and source in it; the sort leaves few sources in a partition.
    sums = placed.groupBy("rank", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        sums.select("rank", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")), "mix-starts"
    ).df
    return placed.join(starts, ["rank", "part"]).withColumn("offset", F.col("before") + F.col("local")).drop(
        "part", "before", "local"
    )


def block_pieces(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rank, block, at, rid, start, length): the part of each document in each block of its source."""
    first = F.expr(f"offset div {block}")
    last = F.expr(f"(offset + size - 1) div {block}")
    spread = docs.where("size > 0").select("rank", "rid", "offset", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest("offset", F.col("block") * block)
    end = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block)
    return spread.select(
        "rank", "block", (begin - F.col("block") * block).alias("at"), "rid",
        (begin - F.col("offset")).alias("start"), (end - begin).alias("length"),
    )


# ---------------------------------------------------------------- draws and slots


DRAWN = "shard long, rank long, first long, drawn long, shard_slots long, shard_before long, n_blocks long, tail long, slots long, cut long"


def draw(quotas: np.ndarray, slots: int, seed: list[int]) -> list[np.ndarray]:
    """Counts of every source for one shard after the other, until the quotas are used up."""
    rng, left, made = np.random.default_rng(seed), quotas.astype(np.int64), []
    while left.sum():
        counts = rng.multivariate_hypergeometric(left, min(slots, int(left.sum())), method="marginals")
        left = left - counts
        made.append(counts)
    return made


def shard_counts(sources: DataFrame, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """One row (``DRAWN``) for each shard and source in it: its slots of the source, from ``first`` on."""
    grouped = sources.where("slots > 0").withColumn("team", F.expr(f"rank div {SOURCES}"))
    sums = grouped.groupBy("team").agg(F.ceil(F.sum("slots") / (slots * shards)).cast("long").alias("draws"))
    spread = grouped.join(sums, "team").select("*", F.explode(F.expr("sequence(0L, draws - 1)")).alias("draw"))

    def until(k: str) -> str:
        """Slots before draw ``k``: an equal part of the quota, without a product that overflows."""
        return f"(slots div draws) * ({k}) + ((slots % draws) * ({k})) div draws"

    spread = spread.select(
        "team", "draw", "rank", "n_blocks", "tail", "slots", "cut",
        F.expr(until("draw")).alias("first"), F.expr(f"{until('draw + 1')} - ({until('draw')})").alias("quota"),
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ignore_index=True)
        team, number = map(int, key)
        first, made = rows["first"].to_numpy(), []
        for i, counts in enumerate(draw(rows["quota"].to_numpy(), slots, [SEED, team, number])):
            some = np.flatnonzero(counts)
            got = rows.loc[some, ["rank", "n_blocks", "tail", "slots", "cut"]].copy()
            got["shard"] = (team << 40) + number * (shards + 1) + i
            got["first"], got["drawn"] = first[some], counts[some]
            got["shard_slots"], got["shard_before"] = counts.sum(), np.cumsum(counts[some]) - counts[some]
            first = first + counts
            made.append(got)
        names = [c.split()[0] for c in DRAWN.split(", ")]
        return pd.concat(made)[names] if made else pd.DataFrame(columns=names)

    return spread.groupBy("team", "draw").applyInPandas(run, DRAWN)


def shard_slots(drawn: DataFrame, block: int = BLOCK) -> DataFrame:
    """(shard, place, rank, block, words): which block of which source every slot takes."""
    place = _permute(False)
    slot = drawn.select("*", F.explode(F.expr("sequence(first, first + drawn - 1)")).alias("slot"))
    number = F.expr("slot div n_blocks")
    made = slot.select(
        "*",
        place(F.col("slot") % F.col("n_blocks"), "n_blocks", pass_seed(F.col("rank"), number)).alias("block"),
        place(
            F.col("shard_before") + F.col("slot") - F.col("first"), "shard_slots", F.xxhash64(F.lit(SEED + 1), "shard")
        ).alias("place"),
    )
    held = F.when(F.col("block") == F.col("n_blocks") - 1, F.col("tail")).otherwise(block)
    lacks = F.when(F.col("slot") == F.col("slots") - 1, F.col("cut")).otherwise(0)
    return made.select("shard", "place", "rank", "block", (held - lacks).alias("words"))


class Mixture(NamedTuple):
    """``documents``: rid, doc_id, size, source_size, target, offset. ``slots``: shard, place, rank,
    block, words. ``pieces``: shard, place, at, rid, start, length, the words of documents in slots."""

    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame


def mix(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    block: int = BLOCK,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    slots: int = SLOTS,
    shards: int = SHARDS,
) -> Mixture:
    """Which words of which documents go where in the mixed output."""
    words = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long")
    sized = stage(
        docs.select(
            docs[doc_id].alias("doc_id"), docs[source].alias("source"), words.alias("size"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "mix-sizes",
    ).df
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ranked(by_source, F.col("source").asc_nulls_last(), "rank")
    known = stage(with_quotas(with_targets(placed, weights, share, cap), block), "mix-quotas").df
    name = known.select(F.col("source").alias("name"), "rank", "source_size", "target")
    named = sized.join(name, sized["source"].eqNullSafe(name["name"])).drop("source", "name")
    documents = stage(document_offsets(named), "mix-offsets").df
    slot_table = stage(shard_slots(shard_counts(known, slots, shards), block), "mix-slots").df
    met = slot_table.join(block_pieces(documents, block), ["rank", "block"]).where("at < words")
    pieces = met.select(
        "shard", "place", "at", "rid", "start", F.least(F.col("length"), F.col("words") - F.col("at")).alias("length")
    )
    return Mixture(documents, slot_table, pieces)


def taken(mixture: Mixture) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document."""
    got = mixture.pieces.groupBy("rid").agg(F.sum("length").alias("taken"))
    return mixture.documents.join(got, "rid", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
