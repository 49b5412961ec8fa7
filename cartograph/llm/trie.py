"""Prefix trie of conversations: range partitions of sorted paths below a broadcast skeleton.

A conversation is a path: one key of 32 bytes for each turn, in order. The key is 224 bits of a hash of
role and text and the number of words of the text, so equal turns have equal keys, a path sorts as a
byte string, and texts never leave the scan. A trie node is a distinct prefix of paths.

1. Paths are sorted by (path, conversation). Copies are folded to one row of counts and id lists
   before they meet, in pieces of ``ID_CHUNK`` ids, so a group of copies of any size stays spread.
2. Splitters are drawn from a sample, each cut after the first turn that tells it from the sampled
   path before it. Members of one node lie in two ranges only if the node is a prefix of the
   splitter between them, so the trie of the splitters (the skeleton, which is broadcast) holds all
   nodes that no single shard can finish. It has at most ``SHARDS * SPLIT_TURNS`` nodes.
3. Each shard is sorted and walked once with a stack of open nodes. Nodes outside the skeleton are
   finished there; for skeleton nodes a shard gives partial aggregates, which one reduction combines.
4. A second walk in reverse order tells each node the smallest member of its parent.

Walks stream: a task holds the stack of one path, not its shard.

Cases: null roles and texts are empty; null turns come first; rows of equal turn are ordered by
their key, so repeated rows are turns of their own; rows with a null conversation id belong to no
conversation and make no node; an empty table has no nodes, not even a root; names of further
columns are free. The keys of one conversation (32 bytes a turn) are one cell, whatever its length.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cartograph.session import stage

KEY = 32
#: Distinct paths a shard aims at, and the most shards; a larger table has larger shards.
SHARD = 2048
SHARDS = 2048
#: Sampled paths for each splitter, and how many turns of them are looked at.
OVERSAMPLE = 16
SPLIT_TURNS = 64
#: Ids of copies that travel as one string.
ID_CHUNK = 1 << 16
_BATCH = 1 << 13

WORD = r"[^\x20\x09-\x0D]+"


def paths(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, path): the keys of every conversation's turns, one after the other."""
    role_, text_ = F.coalesce(turns[role], F.lit("")), F.coalesce(turns[text], F.lit(""))
    told = F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_)
    words = F.lower(F.lpad(F.hex(F.regexp_count(text_, F.lit(WORD)).cast("long")), 8, "0"))
    keyed = turns.select(
        turns[conv].cast("long").alias("conv_id"),
        F.struct(turns[turn].alias("turn"), F.concat(F.substring(F.sha2(told, 256), 1, 56), words).alias("key")).alias("at"),
    )
    in_order = F.sort_array(F.collect_list("at"))
    return (
        keyed.where("conv_id IS NOT NULL")
        .groupBy("conv_id")
        .agg(F.unhex(F.array_join(F.transform(in_order, lambda t: t["key"]), "")).alias("path"))
    )


def borrow_heads(own: DataFrame, every: int = 20, lengths: int = 4) -> DataFrame:
    """(conv_id, path): the first h turns of conversation ``c - c % every``, then c's own after its first h.

    h is ``crc32(c as text) % lengths``. Only the few keys of a head are joined.
    """
    own = stage(own, "trie-own").df
    most = KEY * (lengths - 1)
    heads = own.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.substring("path", 1, most).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % lengths * KEY).cast("int")
    led = own.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    none = F.lit(b"")
    return led.join(heads, "base", "left").select(
        "conv_id",
        F.concat(
            F.substring(F.coalesce("head", none), F.lit(1), F.col("h")),
            F.substring(F.col("path"), F.col("h") + 1, F.length("path")),
        ).alias("path"),
    )


# ---------------------------------------------------------------- copies


FOLDED = T.StructType(
    [
        T.StructField("path", T.BinaryType()),
        T.StructField("first", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("ids", T.StringType()),
    ]
)


def _batches(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded length."""
    arrow = to_arrow_schema(schema)
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow
            )
            held = []
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow
        )


def fold_copies(rebuilt: DataFrame) -> DataFrame:
    """(path, first, n, ids): runs of conversations with the same path, ids ascending."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        path, ids = None, []
        for batch in batches:
            for conv, p in zip(batch["conv_id"].to_pylist(), batch["path"].to_pylist(), strict=True):
                if p != path or len(ids) == ID_CHUNK:
                    if ids:
                        yield path, ids[0], len(ids), ",".join(map(str, ids))
                    path, ids = p, []
                ids.append(conv)
        if ids:
            yield path, ids[0], len(ids), ",".join(map(str, ids))

    ordered = rebuilt.select("conv_id", "path").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(lambda batches: _batches(runs(batches), FOLDED), FOLDED)


# ---------------------------------------------------------------- skeleton


def shared_turns(a: bytes, b: bytes) -> int:
    """How many first turns two paths share."""
    size = min(len(a), len(b)) // KEY * KEY
    if a[:size] == b[:size]:
        return size // KEY
    x, y = np.frombuffer(a, np.uint8, size), np.frombuffer(b, np.uint8, size)
    return int(np.argmax(x != y)) // KEY


class Skeleton(NamedTuple):
    """Splitters in order, and the trie of their prefixes: node 0 is the root."""

    splitters: list[bytes]
    children: dict[tuple[int, bytes], int]
    parent: list[int]
    words: list[int]
    depth: list[int]


def key_words(key: bytes) -> int:
    return int.from_bytes(key[-4:], "big")


def skeleton(sample: list[bytes], shards: int) -> Skeleton:
    """Splitters for ``shards`` ranges, and their trie. ``sample``: paths, in any order."""
    sample = sorted(set(sample))
    picked = sorted({i * len(sample) // shards for i in range(1, shards)} - {0}) if sample else []
    splitters = [sample[i][: KEY * (shared_turns(sample[i - 1], sample[i]) + 1)] for i in picked]
    made = Skeleton(splitters, {}, [-1], [0], [0])
    for s in splitters:
        at = 0
        for k in range(0, len(s), KEY):
            key = s[k : k + KEY]
            child = made.children.get((at, key))
            if child is None:
                child = made.children[at, key] = len(made.parent)
                made.parent.append(at)
                made.words.append(key_words(key))
                made.depth.append(made.depth[at] + 1)
            at = child
    return made


def draw_skeleton(folded: DataFrame, rows: int, shard: int) -> Skeleton:
    shards = max(1, min(SHARDS, -(-rows // shard)))
    if shards == 1:
        return skeleton([], 1)
    part = min(1.0, OVERSAMPLE * shards / rows)
    drawn = folded.select(F.substring("path", 1, KEY * SPLIT_TURNS).alias("path"))
    return skeleton([r[0] for r in drawn.sample(part, seed=11).collect()], shards)


# ---------------------------------------------------------------- the walks


WALKED = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        # Node of the skeleton these partial sums are of; null for a finished node.
        T.StructField("bone", T.IntegerType()),
        # Node of the skeleton that is the parent; null if the parent is finished by the shard too.
        T.StructField("anchor", T.IntegerType()),
        T.StructField("conv_id", T.LongType()),
        T.StructField("depth", T.LongType()),
        T.StructField("n_convs", T.LongType()),
        T.StructField("n_children", T.LongType()),
        T.StructField("n_leaves", T.LongType()),
        T.StructField("saved_tokens", T.LongType()),
        T.StructField("ends_sha256", T.StringType()),
    ]
)
NODES = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("depth", T.LongType()),
        T.StructField("parent_conv_id", T.LongType()),
        *[f for f in WALKED.fields if f.name in ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")],
    ]
)
NO_END = hashlib.sha256(b"").hexdigest()


class _Open:
    """A node on the stack: what is known of its members so far."""

    __slots__ = ("bone", "children", "ends", "least", "leaves", "n", "saved", "words")

    def __init__(self, bone: int | None, words: int) -> None:
        self.bone, self.words = bone, words
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends = None

    def member(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None or least < self.least else self.least


def walk(rows: Iterator[tuple[int, bytes, int, int, str]], bones: dict[tuple[int, bytes], int]) -> Iterator[tuple]:
    """Rows of ``WALKED`` from (shard, path, first, n, ids) in order, children before their parent."""
    stack: list[_Open] = []
    shard, last, seq = None, b"", 0

    def close() -> tuple:
        nonlocal seq
        node = stack.pop()
        depth, above = len(stack), stack[-1] if stack else None
        if node.bone is None:
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.words
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
        if above is not None:
            above.member(node.n, node.least)
        seq += 1
        anchor = above.bone if node.bone is None else None
        ends = NO_END if node.ends is None else node.ends.hexdigest()
        return shard, seq, node.bone, anchor, node.least, depth, node.n, node.children, node.leaves, node.saved, ends

    for at, path, first, n, ids in rows:
        if at != shard:
            while stack:
                yield close()
            shard, last, seq = at, b"", 0
            stack.append(_Open(0, 0))
        shared = shared_turns(last, path)
        while len(stack) > shared + 1:
            yield close()
        for k in range(shared * KEY, len(path), KEY):
            key, bone = path[k : k + KEY], stack[-1].bone
            stack.append(_Open(None if bone is None else bones.get((bone, key)), key_words(key)))
        end = stack[-1]
        if end.ends is None:
            end.ends = hashlib.sha256(ids.encode())
        else:
            end.ends.update(b"," + ids.encode())
        end.member(n, first)
        last = path
    while stack:
        yield close()


def _finished_bones(spark: SparkSession, bone: Skeleton, walked: DataFrame) -> tuple[DataFrame, list[int]]:
    """Skeleton nodes from the reduction of all shards' partial sums, and their smallest members."""
    partial = (
        walked.where("bone IS NOT NULL")
        .groupBy("bone")
        .agg(
            F.min("conv_id").alias("least"),
            F.sum("n_convs").alias("n"),
            F.sum("n_children").alias("children"),
            F.sum("n_leaves").alias("leaves"),
            F.sum("saved_tokens").alias("saved"),
            # A path ends in one shard only; elsewhere the node has no end.
            F.max(F.when(F.col("ends_sha256") != NO_END, F.col("ends_sha256"))).alias("ends"),
        )
    )
    # At most one row for each node of the skeleton, whose size is bounded.
    sums = {r["bone"]: r.asDict() for r in partial.collect()}
    made = []
    for i in reversed(range(len(bone.parent))):
        if i not in sums:
            continue
        s = sums[i]
        leaves = s["leaves"] if s["children"] else 1
        saved = s["saved"] + (s["n"] - 1) * bone.words[i]
        above = sums.get(bone.parent[i])
        if above is not None:
            above["children"] += 1
            above["leaves"] += leaves
            above["saved"] += saved
        made.append(
            (s["least"], bone.depth[i], above and above["least"], s["n"], s["children"], leaves, saved, s["ends"] or NO_END)
        )
    least = [sums[i]["least"] if i in sums else -1 for i in range(len(bone.parent))]
    return spark.createDataFrame(made, NODES), least


def trie_nodes(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node from (conv_id, path): smallest member, depth, the parent's smallest member,
    members, children, leaves below, tokens saved below, and a digest of the members that end there."""
    spark = conversations.sparkSession
    rebuilt = stage(conversations, "trie-paths").df
    folded = stage(fold_copies(rebuilt), "trie-folded")
    bone = draw_skeleton(folded.df, folded.rows, shard)
    told = spark.sparkContext.broadcast((bone.splitters, bone.children))

    @F.pandas_udf("int")
    def shard_of(path):
        splitters = told.value[0]
        return path.map(lambda p: bisect_right(splitters, bytes(p)))

    def first_walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("shard", "path", "first", "n", "ids")), strict=True))
        return _batches(walk(rows, told.value[1]), WALKED)

    dealt = folded.df.select(shard_of("path").alias("shard"), "*").repartition("shard")
    walked = stage(
        dealt.sortWithinPartitions("shard", "path", "first").mapInArrow(first_walk, WALKED), "trie-walked"
    ).df
    bones, least = _finished_bones(spark, bone, walked)
    least_told = spark.sparkContext.broadcast(least)

    def parents(rows: Iterator[tuple]) -> Iterator[tuple]:
        line: dict[int, int] = {}
        for anchor, conv, depth, *rest in rows:
            line[depth] = conv
            yield conv, depth, line[depth - 1] if anchor is None else least_told.value[anchor], *rest

    names = ["anchor", "conv_id", "depth", *NODES.names[3:]]

    def second_walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in names), strict=True))
        return _batches(parents(rows), NODES)

    local = walked.where("bone IS NULL").repartition("shard").sortWithinPartitions("shard", F.desc("seq"))
    return local.mapInArrow(second_walk, NODES).unionByName(bones)
