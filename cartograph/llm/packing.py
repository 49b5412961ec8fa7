"""Conflict-constrained best-fit packing of documents into sequences.

A document of more than ``CAPACITY`` tokens fills whole sequences (bins) by itself; what is left of
it, and every shorter document, is put by decreasing size into the bin with the least room that
still takes it, is free of its source and of its duplicate cluster. Bins are ordered by their
residual, and carry one bitmap of sources and one of clusters: the search goes to the next larger
residual until the tightest compatible bin is found, or opens a new one. Bins of the same residual
and the same sources are kept together, so a source that fills every bin costs one look for all of
them.

Tokens are words (runs without white space) and one end mark. Packing is a sequential choice, so
the rows are dealt to shards of about ``SHARD`` documents, by the hash of a row number, and each is
packed by itself: a third of all rows from one source, or of one cluster, spreads over all shards.
Bins of different shards share nothing, so no conflict can cross them.

The duplicate cluster is a hash of the words, that is exact copies, or with ``near`` the
near-duplicate group of the row.

Cases: a null or empty text is its end mark; a null source is a source of its own; repeated rows
are packed each, in different bins, as they are one cluster; an empty table gives no bins; ties in
size go by id. Names of further columns are free.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartograph.llm.simhash import MAX_BITS, fingerprints, groups
from cartograph.llm.words import map_slices, plain
from cartograph.session import stage

CAPACITY = 2048
SHARD = 20_000


class Bins:
    """Open bins by residual; each has a bitmap of sources and one of clusters."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = 0
        #: Bit r is set when a bin has room r.
        self.rooms = 0
        self.by_room: list[dict[int, list[tuple[int, int]]]] = [{} for _ in range(capacity + 1)]

    def _insert(self, room: int, sources: int, clusters: int, bin_id: int) -> None:
        if room:
            self.rooms |= 1 << room
            self.by_room[room].setdefault(sources, []).append((bin_id, clusters))

    def put(self, size: int, source: int, cluster: int) -> int:
        """The bin of the item; ``source`` and ``cluster`` have one bit set (no bit: no conflict)."""
        left = self.rooms >> size
        room = size
        while left:
            step = (left & -left).bit_length() - 1
            room, left = room + step, left >> step
            groups = self.by_room[room]
            for sources, members in groups.items():
                if sources & source:
                    continue
                for at, (bin_id, clusters) in enumerate(members):
                    if not clusters & cluster:
                        members.pop(at)
                        if not members:
                            del groups[sources]
                            if not groups:
                                self.rooms &= ~(1 << room)
                        self._insert(room - size, sources | source, clusters | cluster, bin_id)
                        return bin_id
            room, left = room + 1, left >> 1
        self.count += 1
        self._insert(self.capacity - size, source, cluster, self.count - 1)
        return self.count - 1


def _bits(keys: pd.Series, single: bool) -> list[int]:
    """A bit for each distinct key; with ``single``, none for keys that occur once."""
    codes = pd.factorize(keys, use_na_sentinel=False)[0]
    if single:
        often = np.bincount(codes)[codes] > 1 if len(codes) else codes
        codes = np.where(often, np.unique(np.where(often, codes, -1), return_inverse=True)[1], -1)
    return [1 << int(c) if c >= 0 else 0 for c in codes]


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """(row, piece, bin, start, size) of the documents ``row, size, source, cluster``."""
    rows = rows.sort_values(["size", "row"], ascending=[True, True], ignore_index=True)
    whole, rest = rows["size"] // capacity, rows["size"] % capacity
    bins = Bins(capacity)
    made: list[tuple[int, int, int, int, int]] = []
    order = np.lexsort((rows["row"], -rest))
    sources, clusters = _bits(rows["source"], False), _bits(rows["cluster"], True)
    for i in order.tolist():
        size = int(rest[i])
        if size:
            at = bins.put(size, sources[i], clusters[i])
            made.append((rows["row"][i], int(whole[i]), at, int(whole[i]) * capacity, size))
    for i in np.flatnonzero(whole).tolist():
        for piece in range(int(whole[i])):
            made.append((rows["row"][i], piece, bins.count, piece * capacity, capacity))
            bins.count += 1
    return pd.DataFrame(made, columns=["row", "piece", "bin", "start", "size"])


def sizes(docs: DataFrame, text: str, doc_id: str, source: str, cluster: str | None = None) -> DataFrame:
    """(doc_id, source, size, cluster): without a column ``cluster`` a hash of the words, A-Z lower-cased."""
    used = docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), docs[text].alias("text"))
    if cluster:
        used = docs.select(
            docs[doc_id].alias("doc_id"), docs[source].alias("source"), docs[text].alias("text"), docs[cluster].alias("cluster")
        )
    schema = T.StructType(
        [*used.schema.fields[:2], T.StructField("size", T.LongType()), T.StructField("cluster", T.LongType())]
    )

    def work(batch: pa.RecordBatch) -> dict:
        words = [t.as_py().lower().split() for t in plain(batch["text"]).cast(pa.binary())]
        hashes = [] if cluster else [xxhash.xxh64_intdigest(b" ".join(w)) for w in words]
        return {
            "doc_id": batch["doc_id"],
            "source": batch["source"],
            "size": [len(w) + 1 for w in words],
            "cluster": batch["cluster"] if cluster else np.array(hashes, np.uint64).view(np.int64),
        }

    return map_slices(used, "text", work, schema)


def with_near_clusters(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, size, cluster): the group of near-duplicates stands for the cluster, row by row.

    Groups are those of :mod:`cartograph.llm.simhash`: shingles of five words, linked fingerprints.
    """
    used = docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), docs[text].alias("text"))
    made, fp = fingerprints(used, "text", None)
    told = stage(sizes(made, "text", "doc_id", "source", fp), "near-sizes").df
    # One row per fingerprint: copies are counted out before anything is joined on it.
    prints = stage(told.select(F.col("cluster").alias("fp")).distinct(), "near-prints").df
    named = stage(groups(prints, MAX_BITS), "near-groups").df
    named = named.select("fp", F.col("root").alias("group"))
    return told.join(named, told["cluster"] == named["fp"]).select(
        "doc_id", "source", "size", F.col("group").alias("cluster")
    )


def pack(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    capacity: int = CAPACITY,
    shard: int = SHARD,
    near: bool = False,
) -> DataFrame:
    """(bin_id, doc_id, source, piece, start, size): where each part of each document goes.

    With ``near``, near-duplicates are one cluster, else exact copies only.
    """
    sized = with_near_clusters(docs, text, doc_id, source) if near else sizes(docs, text, doc_id, source)
    # The row numbers are staged, so they stay the same if a task has to run again.
    numbered = stage(
        sized.withColumn("row", F.monotonically_increasing_id()), "sizes"
    )
    shards = max(1, -(-numbered.rows // shard))
    dealt = numbered.df.select(
        F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "*"
    )
    kept = T.StructType([dealt.schema["doc_id"], dealt.schema["source"]])
    schema = T.StructType(
        [
            T.StructField("bin_id", T.LongType()),
            *kept.fields,
            *(T.StructField(n, T.LongType()) for n in ("piece", "start", "size")),
        ]
    )

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["row", "size", "source", "cluster"]).to_pandas()
        made = pack_shard(rows, capacity)
        base = table["shard"][0].as_py() << 32
        at = pd.Series(np.arange(len(rows)), index=rows["row"])[made["row"]].to_numpy()
        ids = table.select(["doc_id", "source"]).take(pa.array(at))
        return pa.table(
            {
                "bin_id": pa.array(made["bin"].to_numpy() + base, pa.int64()),
                "doc_id": ids["doc_id"],
                "source": ids["source"],
                **{n: pa.array(made[n].to_numpy(), pa.int64()) for n in ("piece", "start", "size")},
            }
        )

    return dealt.groupBy("shard").applyInArrow(run, schema)
