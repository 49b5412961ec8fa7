"""Benchmark decontamination by greedy string tiling.

A document is contaminated by a test item if tiles of at least ``TILE`` words cover at least
``COVERAGE`` of the item's words. Tiles are matches of the same words in a row; they do not overlap,
neither in the document nor in the item, and the longest free match is taken first. The order of
the tiles is free, so a passage is caught when its parts were put in another order.

Seeds are runs of ``TILE`` words: the rolling (Karp-Rabin) hashes of a document meet those of the
items, and the places where both agree, word by word, are matches along their diagonal, of which
only the first and the last seed are listed. An item of fewer words is one seed, and has to occur
as it is. The test items are told to all tasks in blocks of about ``BLOCK_BYTES`` of text, one block
after the other, and each document is read in whole. With one block no rows are shuffled; the
findings of several are staged block by block.

Words are runs of letters, digits and characters beyond ASCII, after letters of
any alphabet are lower-cased.

Cases: null texts and items have no words and match nothing; of equally long matches the first in
the document is taken, then the first in the item; a text of one word repeated costs as many rows
as it has words, not their product with those of the item; repeated documents and items are judged each; equal items are reported each; an empty table on either side
gives no finding. Names of further columns are free.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartograph.llm.words import ALNUM_FOLDED, Words, free_name, map_slices, plain, split_words
from cartograph.session import stage

TILE = 5
COVERAGE = 0.5
BLOCK_BYTES = 16 << 20

_MULTIPLY = 0x9E3779B97F4A7C15
#: What stands before the first word of a document, before that of an item, and for unknown words.
_DOC_EDGE, _ITEM_EDGE, _UNKNOWN = -2, -3, -1


def rolling(ids: np.ndarray, width: int, multiply: int = _MULTIPLY) -> np.ndarray:
    """Karp-Rabin hash of every run of ``width`` ids."""
    out = np.zeros(max(len(ids) - width + 1, 0), np.uint64)
    for k in range(width if len(out) else 0):
        out = out * np.uint64(multiply) + (ids[k : k + len(out)].astype(np.uint64) + np.uint64(1))
    return out


def folded_words(text: pa.Array) -> Words:
    return split_words(pc.utf8_lower(plain(text)), ALNUM_FOLDED)


def neighbours(ids: np.ndarray, starts: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before and the word after each word; ``edge`` where its text begins or ends."""
    before, after = np.roll(ids, 1), np.roll(ids, -1)
    full = np.diff(starts) > 0
    before[starts[:-1][full]] = edge
    after[starts[1:][full] - 1] = edge
    return before, after


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every value in each row's range."""
    size = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(low)), size)
    return row, np.arange(len(row)) + np.repeat(low - np.cumsum(size) + size, size)


class Seeds:
    """Runs of ``width`` words that start at ``at``, and where they meet those of documents.

    Equal seeds are one group. Only the first and the last seed of a match are looked up: a match
    starts where the words before differ and ends where the words after differ. Places sorted by
    (group, neighbour) give them as two ranges, so equal words in a row do not make all pairs.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, at: np.ndarray, width: int) -> None:
        self.words, self.width, self.span = words, width, int(words.max(initial=0)) + 4
        spread, self.multiply = np.arange(width), _MULTIPLY
        while True:
            hashes = rolling(words, width, self.multiply)[at]
            self.hash, first, group = np.unique(hashes, return_index=True, return_inverse=True)
            self.sample = at[first]
            # No two different seeds of the items may share a hash; other ones are compared below.
            if (words[at[:, None] + spread] == words[self.sample[group][:, None] + spread]).all():
                break
            self.multiply = (self.multiply + 2) % (1 << 64)
        self.ends = []
        for side, shift in zip(neighbours(words, starts, _ITEM_EDGE), (0, width - 1), strict=True):
            key = group * self.span + side[at + shift] - _ITEM_EDGE
            order = np.argsort(key, kind="stable")
            self.ends.append((key[order], at[order]))

    def matches(self, ids: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rows (word of the documents, word of the items, words) of the longest equal runs."""
        width = self.width
        if not len(self.hash) or len(ids) < width:
            return np.zeros((0, 3), np.int64)
        hashes = rolling(ids, width, self.multiply)
        group = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        hit = np.flatnonzero((self.hash[group] == hashes) & (owner[: len(hashes)] == owner[width - 1 :]))
        spread = np.arange(width)
        hit = hit[(ids[hit[:, None] + spread] == self.words[self.sample[group[hit]][:, None] + spread]).all(axis=1)]
        base = group[hit] * self.span
        found = []
        for side, shift, (key, at) in zip(neighbours(ids, starts, _DOC_EDGE), (0, width - 1), self.ends, strict=True):
            same = base + side[hit + shift] - _ITEM_EDGE
            low, high = np.searchsorted(key, base, "left"), np.searchsorted(key, base + self.span, "left")
            parts = [ranges(low, np.searchsorted(key, same, "left")), ranges(np.searchsorted(key, same, "right"), high)]
            row, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            p, q = hit[row], at[value]
            order = np.lexsort((p, p - q))
            found.append((p[order], q[order]))
        # On each diagonal starts and ends take turns.
        (p, q), (last, _) = found
        return np.stack([p, q, last - p + width], axis=1)


class TestItems:
    """A block of test items with their seeds; an item shorter than a tile is one seed itself."""

    def __init__(self, ids: list, texts: list[str], tile: int) -> None:
        words = folded_words(pa.array(texts, pa.string()))
        self.ids, self.tile = ids, tile
        self.vocabulary, self.starts, self.owner = words.distinct, words.starts, words.owner
        size = np.minimum(words.counts, tile)
        inside = np.arange(len(words.codes)) - words.starts[self.owner]
        self.seeds = [
            Seeds(words.codes, words.starts, np.flatnonzero((size == width)[self.owner] & (inside + width <= words.counts[self.owner])), width)
            for width in np.unique(size[size > 0]).tolist()
        ]

    def matches(self, words: Words) -> np.ndarray:
        """Rows (document, item, word of the documents, word of the items, words) of all matches."""
        known = pc.fill_null(pc.index_in(words.distinct, value_set=self.vocabulary), _UNKNOWN)
        ids, owner = np.asarray(known).astype(np.int64)[words.codes], words.owner
        met = np.concatenate([np.zeros((0, 3), np.int64), *(s.matches(ids, words.starts, owner) for s in self.seeds)])
        return np.column_stack([owner[met[:, 0]], self.owner[met[:, 1]], met])


def tiles(matches: np.ndarray, size: int, tile: int) -> list[tuple[int, int, int]]:
    """(length, word of the document, word of the item) of the tiles, longest first.

    ``matches`` are rows (word of the document, word of the item, words) of one document and an item
    of ``size`` words. Of equally long ones the first in the document is taken, then the first in
    the item. A match that is partly covered by a tile is cut to what is left of it, and waits for
    its turn.
    """
    heap = [(-n, a, b) for a, b, n in matches.tolist()]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item, left = bytearray(size), size
    found = []
    while heap and left >= tile:
        n, a, b = heapq.heappop(heap)
        n = -n
        if in_item.find(0, b, b + n) < 0:
            continue
        free = [not in_item[b + k] and a + k not in in_doc for k in range(n)]
        if all(free):
            found.append((n, a, b))
            in_doc.update(range(a, a + n))
            in_item[b : b + n] = b"\1" * n
            left -= n
            continue
        start = None
        for k, is_free in enumerate([*free, False]):
            if is_free and start is None:
                start = k
            elif not is_free and start is not None:
                if k - start >= tile:
                    heapq.heappush(heap, (start - k, a + start, b + start))
                start = None
    return found


def findings(words: Words, items: TestItems, coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(document, item, tiles, covered words, words of the item) of the contaminated documents."""
    met = items.matches(words)
    met = met[np.lexsort((met[:, 1], met[:, 0]))]
    pair = met[:, :2]
    edges = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]).any(axis=1), [True]])) if len(met) else []
    found = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        doc, item = pair[a].tolist()
        start, size = int(items.starts[item]), int(items.starts[item + 1] - items.starts[item])
        own = met[a:b, 2:] - [0, start, 0]
        # Tiles lie inside the matches: too few words in matches are too few in tiles.
        steps = np.bincount(own[:, 1], minlength=size + 1) - np.bincount(own[:, 1] + own[:, 2], minlength=size + 1)
        if (np.cumsum(steps) > 0).sum() < coverage * size:
            continue
        parts = tiles(own, size, min(items.tile, size))
        covered = sum(n for n, _, _ in parts)
        if covered >= coverage * size:
            found.append((doc, item, len(parts), covered, size))
    return found


def test_blocks(benchmark: DataFrame, item_id: str, text: str, tile: int, limit: int = BLOCK_BYTES):
    """(whether it is the only one, block) of the items, about ``limit`` bytes of text each."""
    items = benchmark.select(
        benchmark[item_id].alias("id"), F.coalesce(benchmark[text], F.lit("")).alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // limit)
    block = F.pmod(F.xxhash64("id", "text"), F.lit(max(blocks, 1)))
    for k in range(blocks):
        rows = items.where(block == k).orderBy("id", "text").collect()
        yield k == blocks - 1 == 0, TestItems([r["id"] for r in rows], [r["text"] for r in rows], tile)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    tile: int = TILE,
    coverage: float = COVERAGE,
    limit: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered_words, item_words): each contaminated document and item."""
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", source.schema["doc_id"].dataType),
            T.StructField("item_id", benchmark.schema[item_id].dataType),
            *(T.StructField(n, T.LongType()) for n in ("n_tiles", "covered_words", "item_words")),
        ]
    )
    spark, parts = docs.sparkSession, []
    for only, block in test_blocks(benchmark, item_id, item_text, tile, limit):
        shared = spark.sparkContext.broadcast(block)

        def work(batch: pa.RecordBatch, shared=shared) -> dict | None:
            items = shared.value
            found = findings(folded_words(batch["text"]), items, coverage)
            if not found:
                return None
            doc, item, *counts = zip(*found, strict=True)
            return {
                "doc_id": batch["doc_id"].take(pa.array(doc)),
                "item_id": [items.ids[i] for i in item],
                **dict(zip(("n_tiles", "covered_words", "item_words"), counts, strict=True)),
            }

        found = map_slices(source, "text", work, schema)
        if not only:
            found = stage(found, "findings").df
            shared.destroy()
        parts.append(found)
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    tile: int = TILE,
    coverage: float = COVERAGE,
    limit: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents that no item contaminates, with the columns they came with."""
    out, spark = docs, docs.sparkSession
    whole, digest = free_name(docs.columns, "whole_text"), free_name(docs.columns, "digest")
    marked = docs.select("*", docs[text].alias(whole))
    for only, block in test_blocks(benchmark, item_id, item_text, tile, limit):
        shared = spark.sparkContext.broadcast(block)

        def dirty(batch: pa.RecordBatch, shared=shared) -> np.ndarray:
            found = findings(folded_words(batch[whole]), shared.value, coverage)
            marks = np.zeros(batch.num_rows, bool)
            marks[[f[0] for f in found]] = True
            return marks

        if only:

            def work(batch: pa.RecordBatch, dirty=dirty) -> dict:
                kept = batch.filter(pa.array(~dirty(batch)))
                return {c: kept[c] for c in docs_columns}

            docs_columns = docs.columns
            return map_slices(marked, whole, work, docs.schema)

        def texts(batch: pa.RecordBatch, dirty=dirty) -> dict:
            return {whole: batch.filter(pa.array(dirty(batch)))[whole]}

        # Whether a document goes depends on its text: equal texts are one row of a small table.
        found = map_slices(marked.select(whole), whole, texts, T.StructType([T.StructField(whole, T.StringType())]))
        bad = stage(found.select(F.sha2(whole, 256).alias(digest)).distinct(), "contaminated").df
        shared.destroy()
        out = out.withColumn(digest, F.sha2(docs[text], 256)).join(bad, digest, "left_anti").select(*docs.columns)
    return out
