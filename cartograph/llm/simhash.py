"""Near-duplicates by SimHash, with pivot distance tables.

A fingerprint has one bit per bit of the shingles' 64-bit hashes: set if it is set in over half of
them. Fingerprints are linked at ``max_bits`` differing bits or fewer, and linked ones are one group.

Search. Distances to a table of pivots (reference fingerprints) are computed once for each distinct
fingerprint. By the triangle inequality two fingerprints whose distances to any pivot differ by
more than ``max_bits`` are not linked, so a pair is discarded by its largest coordinate difference
before the bits are compared. Pairs come from an equi-join, never from all pairs: of ``BLOCKS`` bit
blocks at most ``max_bits`` can hold a difference, so two linked fingerprints agree on all the
others, and the rows meet on each choice of that many blocks. Copies share a fingerprint and are
one row here.

Cases: a null or empty text, or one without words, has the fingerprint 0 and is linked like any
other; null ids are grouped too but name no group while another id is there; repeated rows share a
group; an empty table gives an empty result; a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartograph.llm.components import components
from cartograph.llm.words import free_name, map_slices, plain
from cartograph.session import stage

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: With 6 blocks and 3 bits the join keys have 30 to 33 bits.
BLOCKS = 6
PIVOTS = 16
_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    whole = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    first = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    last = ends[width - 1 :]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(first), _CHUNK):
        spans = zip(first[at : at + _CHUNK].tolist(), last[at : at + _CHUNK].tolist(), strict=True)
        digests = b"".join([xxhash.xxh64_digest(whole[a:b], SEED) for a, b in spans])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(first)).tobytes(), "big", signed=True)


def fingerprints(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE
) -> tuple[DataFrame, str]:
    """The columns ``keep`` (all, if none are named) and a fingerprint; the latter's name."""
    keep = docs.columns if keep is None else keep
    name = free_name(docs.columns, "fingerprint")
    whole = free_name([*docs.columns, name], "whole_text")
    source = docs.select(*(docs[c] for c in keep), docs[text].alias(whole))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(name, T.LongType())])

    def work(batch: pa.RecordBatch) -> dict:
        texts = plain(batch[whole]).cast(pa.binary())
        made = [fingerprint(t.as_py(), shingle) for t in texts]
        return {**{c: batch[c] for c in keep}, name: pa.array(made, pa.int64())}

    return map_slices(source, whole, work, schema), name


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of the numbers from 0."""
    made = (xxhash.xxh64_intdigest(str(i), SEED) for i in range(count))
    return [x - (1 << 64) if x >> 63 else x for x in made]


def pivot_table(fp: Column, count: int = PIVOTS) -> list[Column]:
    """Distances to the pivots, eight to a long, one in each byte."""
    known = pivots(count)
    packed = []
    for at in range(0, count, 8):
        long = F.lit(0).cast("long")
        for k, p in enumerate(known[at : at + 8]):
            long = long.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), 8 * k))
        packed.append(long)
    return packed


def _largest_difference(a: list[Column], b: list[Column], count: int) -> Column:
    def coordinate(packed: list[Column], i: int) -> Column:
        return F.shiftrightunsigned(packed[i // 8], 8 * (i % 8)).bitwiseAND(F.lit(127))

    return F.greatest(*(F.abs(coordinate(a, i) - coordinate(b, i)) for i in range(count)))


def block_keys(fp: Column, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> list[Column]:
    """One key per choice of the blocks that must agree: the fingerprint with the others cleared."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = []
    for chosen in combinations(masks, blocks - max_bits):
        mask = sum(chosen)
        keys.append(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return keys


def links(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """(low, high): linked pairs of distinct fingerprints, each once. ``prints``: column ``fp``."""
    tables = pivot_table(F.col("fp"))
    names = [f"t{i}" for i in range(len(tables))]
    keyed = prints.select(
        "fp",
        *(t.alias(n) for t, n in zip(tables, names, strict=True)),
        F.posexplode(F.array(*block_keys(F.col("fp"), max_bits, blocks))).alias("choice", "key"),
    )
    other = keyed.select("choice", "key", F.col("fp").alias("fp_b"), *(F.col(n).alias(f"{n}_b") for n in names))
    apart = _largest_difference(
        [F.col(n) for n in names], [F.col(f"{n}_b") for n in names], 8 * len(names)
    )
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= max_bits
    # ``greatest`` of the coordinates comes first: a pair beyond it is never compared bit by bit.
    return (
        keyed.join(other, ["choice", "key"])
        .where((F.col("fp") < F.col("fp_b")) & (apart <= max_bits) & near)
        .select(F.col("fp").alias("low"), F.col("fp_b").alias("high"))
        .distinct()
    )


def groups(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, root): the group of every distinct fingerprint, named by its smallest one."""
    distinct = prints.select("fp").distinct()
    roots = components(links(distinct, max_bits, blocks))
    return distinct.join(roots.select(F.col("node").alias("fp"), "low"), "fp", "left").select(
        "fp", F.coalesce("low", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fp, component_id) of every row; the id of a group is its smallest document id."""
    made, name = fingerprints(docs, text, [doc_id], shingle)
    prints = stage(made.select(F.col(doc_id).alias("doc_id"), F.col(name).alias("fp")), "prints").df
    # One row per fingerprint: copies are counted out before anything is joined on it.
    first = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints").df
    grouped = stage(groups(first, max_bits).join(first, "fp"), "groups").df
    named = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(grouped.join(named, "root").select("fp", "component_id"), "named").df
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row of each group, the one with the smallest id, with the columns it came with.

    Of repeated rows, the one that was read first stays. The rows that go are found first and
    removed by an anti-join on a row number, so a group of any size is spread over all tasks.
    """
    made, name = fingerprints(docs, text, None, shingle)
    row = free_name(made.columns, "row")
    marked = stage(made.withColumn(row, F.monotonically_increasing_id()), "marked").df
    slim = marked.select(F.col(name).alias("fp"), F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("id"), F.col(row).alias("row")).alias("at"))
    first = stage(slim.groupBy("fp").agg(F.min("at").alias("first")), "distinct-prints").df
    grouped = stage(groups(first, max_bits).join(first, "fp"), "groups").df
    stays = grouped.groupBy("root").agg(F.min("first.n").alias("n"), F.min("first").alias("first"))
    stays = stays.select(F.col("first.row").alias(row))
    return marked.join(
        stage(slim.select(F.col("at.row").alias(row)).join(stays, row, "left_anti"), "dropped").df,
        row,
        "left_anti",
    ).select(*docs.columns)
