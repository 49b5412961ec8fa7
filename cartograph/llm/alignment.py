"""Cross-tokenizer alignment: windows between whitespace-token anchors, memoised by their ids.

Every text is tokenised whole by two tokenizers: A, byte-level BPE, on a space and the text; B, BPE
pieces with byte fallback, on the text, to which it adds the space. Both give the same bytes, or the
text has no alignment. An anchor is a byte at which a token of A and a token of B both start, so the
tokens before them end together, and both are marked by a space. Anchors split a document into
windows of token ids; the alignment of a window depends on its ids only, so a slice of the texts
remembers its windows by them and aligns each once. Inside a window, bytes where tokens of both sides end cut groups, and a token of
A is linked to each token of B whose bytes overlap its own.

How often a pair of ids is linked is counted over the corpus. Texts are not tokenised twice for
that: the first pass writes, for each slice of a few megabytes of text, its distinct pairs, its
distinct windows as lists of pairs, and its texts as counts of windows. Corpus-wide counts come from
the slices' pairs, which hold a pair once for each slice, and go back to the slices by joins on the
pair and on the slice. No table is broadcast by force, and the largest thing a task holds is a slice.

Cases: a null or empty text, and one whose bytes a tokenizer changes, has no tokens: zeros and an
empty digest; copies within a slice are tokenised once and counted each; repeated rows and null ids
are rows of their own; strings of special tokens are plain text; an empty table gives an empty
result; names of further columns are free. A text without anchors is one window; windows of more
than ``MEMO_TOKENS`` tokens are aligned like any other but not remembered.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartograph.llm.words import map_slices, plain
from cartograph.session import stage

FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Fixed value: how byte-level BPE of A cuts a text into words.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text of a slice: its tokens and windows are in memory at a time.
SLICE_BYTES = 4 << 20
#: Text that is given to a tokenizer at a time.
ENCODE_BYTES = 1 << 19
_B_BITS = 32


# ---------------------------------------------------------------- tokenizers


def _byte_characters() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 characters as they are, other bytes from 256 on."""
    plain_bytes = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain_bytes]
    return {chr(b): b for b in plain_bytes} | {chr(256 + i): b for i, b in enumerate(others)}


class Side(NamedTuple):
    """A tokenizer: the bytes of each id, their number, and whether they start with the space mark."""

    pieces: list[bytes]
    sizes: np.ndarray
    marked: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes]) -> Side:
        return cls(pieces, np.array([len(p) for p in pieces], np.int64), np.array([p[:1] == b" " for p in pieces]))


class Tokenizers:
    """The two tokenizers of a worker."""

    def __init__(self, folder: str) -> None:
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        with open(os.path.join(folder, FILE_A), encoding="utf-8") as file:
            given = json.load(file)
        byte_of, names = _byte_characters(), given["model"]["vocab"]
        added = {t["content"]: t["id"] for t in given["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in name): i for name, i in names.items() if name not in added}
        # Ids of this vocabulary are the order of its merges, so they serve as ranks.
        self._a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self._b = SentencePieceProcessor(model_file=os.path.join(folder, FILE_B))
        a = [b""] * (max(names.values()) + 1)
        for piece, i in ranks.items():
            a[i] = piece
        b = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.a = Side.of(a)
        self.b = Side.of(
            [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in b]
        )
        #: What each token writes: ids inside a group end with a comma, the last of A with a bar, of B with a semicolon.
        self.written = [f"{i}{end}" for side, last in ((a, "|"), (b, ";")) for i in range(len(side)) for end in (",", last)]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both sides for each text, a bounded part of the texts at a time."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= ENCODE_BYTES):
                size += len(texts[end])
                end += 1
            part = texts[at:end]
            for t, b in zip(part, self._b.encode(part, num_threads=1), strict=True):
                yield self._a.encode_ordinary(" " + t), b
            at = end

    def same_bytes(self, text: bytes, a: list[int], b: list[int]) -> bool:
        whole = b" " + text
        return whole == self._a.decode_bytes(a) and whole == b"".join(map(self.b.pieces.__getitem__, b))


@lru_cache(maxsize=1)
def tokenizers(folder: str) -> Tokenizers:
    return Tokenizers(folder)


# ---------------------------------------------------------------- windows


class Aligned(NamedTuple):
    """Alignments of windows: ``a1,a2|b1;a3|b2;`` and the number of groups of each, and the linked
    pairs of all, one for each link; window ``w`` has those from ``starts[w]`` to ``starts[w + 1]``."""

    texts: list[str]
    groups: np.ndarray
    pairs: np.ndarray
    starts: np.ndarray


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct numbers of two sorted arrays, in order; a stable sort merges the two runs."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.append(True, both[1:] != both[:-1])]


def align(keys: list[tuple[bytes, bytes]], known: Tokenizers) -> Aligned:
    """Groups and links of windows of ids (32-bit numbers); the two sides of a window cover the same bytes."""
    a, b = (np.frombuffer(b"".join([k[side] for k in keys]), np.int32).astype(np.int64) for side in (0, 1))
    many_a, many_b = (np.array([len(k[side]) // 4 for k in keys]) for side in (0, 1))
    end_a, end_b = np.cumsum(known.a.sizes[a]), np.cumsum(known.b.sizes[b])
    stop = end_a[np.cumsum(many_a) - 1]
    # Two tokens overlap on the bytes before an end of either; each such stretch is one link.
    cuts = _merged(end_a, end_b)
    pairs = a[np.searchsorted(end_a, cuts)] << _B_BITS | b[np.searchsorted(end_b, cuts)]
    shared = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
    last_a, last_b = shared[group_a] == end_a, shared[group_b] == end_b
    # Tokens are written group by group, those of A first.
    before_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])[group_a]
    before_a = (np.flatnonzero(last_a) + 1)[group_b]
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + before_b] = 2 * a + last_a
    codes[np.arange(len(b)) + before_a] = 2 * (len(known.a.pieces) + b) + last_b
    told = [known.written[c] for c in codes.tolist()]
    at = np.concatenate([[0], np.cumsum(many_a + many_b)]).tolist()
    return Aligned(
        ["".join(told[x:y]) for x, y in zip(at, at[1:], strict=False)],
        np.diff(np.searchsorted(shared, stop, side="right"), prepend=0),
        pairs,
        np.concatenate([[0], np.searchsorted(cuts, stop, side="right")]),
    )


def windows(a: np.ndarray, b: np.ndarray, side_a: Side, side_b: Side, bases: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start byte, first token of A, first token of B) of every window.

    ``a`` and ``b`` are the ids of several texts, one after the other, which start at ``bases``.
    """
    from_a, from_b = np.cumsum(side_a.sizes[a]) - side_a.sizes[a], np.cumsum(side_b.sizes[b]) - side_b.sizes[b]
    anchors = np.intersect1d(from_a[side_a.marked[a]], from_b[side_b.marked[b]], assume_unique=True)
    starts = _merged(anchors, bases)
    return starts, np.searchsorted(from_a, starts), np.searchsorted(from_b, starts)


def _runs(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from each start to the next."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def align_slice(texts: list[str], times: np.ndarray, known: Tokenizers, groups: bool) -> dict:
    """Columns of one slice; ``times`` is how many rows have each text."""
    ids_a, ids_b, used, sizes = [], [], [], []
    for k, (a, b) in enumerate(known.encode(texts)):
        whole = texts[k].encode()
        if known.same_bytes(whole, a, b):
            ids_a.append(np.array(a, np.int32))
            ids_b.append(np.array(b, np.int32))
            used.append(k)
            sizes.append(1 + len(whole))
    n = len(texts)
    made = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    told: list[str | None] = [""] * n
    if not used:
        nothing = np.zeros(0, np.int64)
        return {**made, "groups_sha256": [""] * n, "groups": told if groups else None, "text_starts": np.zeros(n + 1, np.int64),
                "window": nothing, "times": nothing, "window_starts": np.zeros(1, np.int64), "link": nothing,
                "pair": nothing, "linked": nothing}
    a, b = np.concatenate(ids_a), np.concatenate(ids_b)
    bases = np.cumsum(sizes) - sizes
    starts, first_a, first_b = windows(a, b, known.a, known.b, bases)
    bytes_a, bytes_b = a.tobytes(), b.tobytes()

    def parts(whole: bytes, first: np.ndarray) -> list[bytes]:
        cuts = [*(4 * first).tolist(), len(whole)]
        return [whole[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    # The memo: windows by their ids, in order of first use.
    number: dict[tuple[bytes, bytes], int] = defaultdict(count().__next__)
    which = np.fromiter((number[k] for k in zip(parts(bytes_a, first_a), parts(bytes_b, first_b), strict=True)), np.int64, len(starts))
    aligned = align(list(number), known)

    # Texts as strings of their windows, and as counts of them.
    cuts = np.append(np.searchsorted(starts, bases), len(starts))
    order, ends = which.tolist(), cuts.tolist()
    digests = [""] * n
    for at, k in enumerate(used):
        whole = "".join([aligned.texts[w] for w in order[ends[at] : ends[at + 1]]])[:-1]
        digests[k] = hashlib.sha256(whole.encode()).hexdigest()
        if groups:
            told[k] = whole
    owner = np.repeat(np.array(used), np.diff(cuts))
    both, seen = np.unique(owner * len(number) + which, return_counts=True)
    text_of, window_of = both // len(number), both % len(number)
    made["n_a"][used], made["n_b"][used] = [len(x) for x in ids_a], [len(x) for x in ids_b]
    made["n_groups"][used] = _runs(aligned.groups[which], cuts)

    # Windows as lists of the slice's distinct pairs, and how often each pair is linked in all rows.
    lengths = np.diff(aligned.starts)
    made["n_links"][used] = _runs(lengths[which], cuts)
    pair, link = np.unique(aligned.pairs, return_inverse=True)
    rows = np.zeros(len(number), np.int64)
    np.add.at(rows, window_of, seen * times[text_of])
    linked = np.zeros(len(pair), np.int64)
    np.add.at(linked, link, np.repeat(rows, lengths))
    return {
        **made,
        "groups_sha256": digests,
        "groups": told if groups else None,
        "text_starts": np.searchsorted(text_of, np.arange(n + 1)),
        "window": window_of,
        "times": seen,
        "window_starts": aligned.starts,
        "link": link,
        "pair": pair,
        "linked": linked,
    }


# ---------------------------------------------------------------- jobs


_LONGS = ("n_a", "n_b", "n_groups", "n_links")
PACKED = {
    "of": pa.int32(),
    **dict.fromkeys(_LONGS, pa.int64()),
    "groups_sha256": pa.string(),
    "groups": pa.string(),
    **dict.fromkeys(("text_starts", "window", "times", "window_starts", "link"), pa.int32()),
}


def aligned_slices(docs: DataFrame, text: str, doc_id: str, folder: str, groups: bool) -> DataFrame:
    """One row per slice: the ids of its rows, its distinct pairs and how often each is linked, and
    the rest packed as bytes, so that Spark moves them without unfolding millions of numbers."""
    source = docs.select(F.spark_partition_id().alias("part"), docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    schema = T.StructType(
        [
            T.StructField("slice", T.LongType()),
            T.StructField("doc_id", T.ArrayType(source.schema["doc_id"].dataType)),
            T.StructField("packed", T.BinaryType()),
            T.StructField("pair", T.ArrayType(T.LongType())),
            T.StructField("linked", T.ArrayType(T.LongType())),
        ]
    )
    # Slices of a partition are numbered as they come; the table is written once before it is read.
    last: dict[int, int] = {}

    def work(batch: pa.RecordBatch) -> dict:
        part = batch["part"][0].as_py()
        number = last[part] = last.get(part, -1) + 1
        given = plain(batch["text"]).dictionary_encode()
        names = given.dictionary.to_pylist()
        filled = [k for k, t in enumerate(names) if t]
        place = np.full(len(names), -1)
        place[filled] = np.arange(len(filled))
        of = place[np.asarray(given.indices)]
        times = np.bincount(of[of >= 0], minlength=len(filled))
        made = align_slice([names[k] for k in filled], times, tokenizers(folder), groups)
        row = {"slice": (part << 32) + number, "doc_id": batch["doc_id"], "packed": pack({"of": of, **made}), **made}
        return {c: pa.array([row[c]], type=kind) for c, kind in _arrow(schema)}

    return map_slices(source, "text", work, schema, SLICE_BYTES)


def pack(columns: dict) -> bytes:
    """The columns ``PACKED``, which differ in length, as one compressed Arrow stream."""
    row = pa.record_batch({c: pa.array([columns[c]], type=pa.list_(kind)) for c, kind in PACKED.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def unpack(packed: bytes) -> dict[str, pa.Array]:
    row = pa.ipc.open_stream(packed).read_next_batch()
    return {c: row[c].flatten() for c in PACKED}


def _arrow(schema: T.StructType) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]


def pair_counts(slices: DataFrame) -> DataFrame:
    """(pair, n, best): corpus-wide links of each pair; best: no pair with the same B id has more."""
    each = slices.select(F.explode(F.arrays_zip("pair", "linked")).alias("p")).select("p.pair", "p.linked")
    counts = stage(each.groupBy("pair").agg(F.sum("linked").alias("n")), "align-counts").df
    b_id = F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1))
    top = stage(counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("top")), "align-top").df
    return counts.join(top, b_id == F.col("b_id")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align_documents(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folder: str = FOLDER, groups: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), with ``groups`` the
    groups themselves too; and the table (a_id, b_id, n, best) of linked ids."""
    slices = stage(aligned_slices(docs, text, doc_id, folder, groups), "align-slices").df
    counted = stage(pair_counts(slices), "align-pairs").df
    of_slice = slices.select(F.col("slice").alias("of_slice"), F.posexplode("pair").alias("at", "pair"))
    told = of_slice.join(counted, "pair").select("of_slice", "at", "n", "best")
    out = T.StructType(
        [
            T.StructField("doc_id", slices.schema["doc_id"].dataType.elementType),
            *(T.StructField(c, T.LongType()) for c in (*_LONGS, "n_best", "count_sum")),
            T.StructField("groups_sha256", T.StringType()),
            *([T.StructField("groups", T.StringType())] if groups else []),
        ]
    )
    kinds = _arrow(out)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = unpack(left["packed"][0].as_py())

        def cell(name: str) -> np.ndarray:
            return np.asarray(held[name])

        at = np.asarray(right["at"])
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], best[at] = np.asarray(right["n"]), np.asarray(right["best"])
        link, ends = cell("link"), cell("window_starts")
        window, times, cuts = cell("window"), cell("times"), cell("text_starts")
        row = {c: cell(c) for c in _LONGS}
        row["n_best"] = _runs(times * _runs(best[link], ends)[window], cuts)
        row["count_sum"] = _runs(times * _runs(n[link], ends)[window], cuts)
        of = cell("of")
        made = {"doc_id": left["doc_id"].combine_chunks().flatten()}
        for c, values in row.items():
            made[c] = np.append(values, 0)[of]
        for c in ("groups_sha256", "groups") if groups else ("groups_sha256",):
            told = [*held[c].to_pylist(), ""]
            made[c] = [told[k] for k in of.tolist()]
        return pa.table({c: made[c] if isinstance(made[c], pa.Array) else pa.array(made[c], kind) for c, kind in kinds})

    rows = slices.select("slice", "doc_id", "packed").groupBy("slice").cogroup(told.groupBy("of_slice"))
    pairs = counted.select(
        F.shiftright("pair", _B_BITS).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)).alias("b_id"), "n", "best"
    )
    return rows.applyInArrow(run, out), pairs
