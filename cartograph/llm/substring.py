"""Removal of repeated passages with suffix automata over reference shards.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window that covers it
has a word sequence that also starts earlier: in a smaller document, or before it in the same one.

Each window is anchored at the smallest hash among its runs of ``ANCHOR`` words, so equal windows
have equal anchors, and consecutive windows share one. Three steps follow:

1. *Anchors.* One slim row per anchor and document finds the anchors that occur twice or more.
   A slice of documents that already sees an anchor twice sends one row for it to the others.
2. *Reference shards.* The stretch of text around each repeated anchor goes to the shard of that
   anchor. A shard is a stream of stretches in document order: each is first run through the suffix
   automaton of those before it, whose matching statistics tell the windows that occurred earlier;
   then the automaton takes it in. The windows that are new are reported: they are the first of
   their kind. Corpora have no bound, so shards are dealt out by a shuffle, next to the text that
   can match them, instead of broadcasting each to every document.
3. *Removal.* A document drops the windows with a repeated anchor that are not the first.

Words are compared as strings; hashes only choose where to look. Shards of an anchor with more than
``HOT`` occurrences are cut to single windows, dealt out by their words, so no task gets all of it.

Cases: a null text has no words. Rows that share an id are told apart and ordered by a hash of
their text; equal rows count as one document told twice and lose the same words. Null ids come
first. Fewer words than a window: nothing goes. An empty table gives an empty table; the names of
further columns are free.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartograph.llm.words import SPACED, Words, free_name, map_slices, plain, split_words
from cartograph.session import stage

WINDOW = 20
ANCHOR = 7
#: Occurrences from which an anchor's shard is split window by window.
HOT = 1_000

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class SuffixAutomaton:
    """Suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, edges: dict[str, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, parent: int, word: str, child: int) -> int:
        """The state for the shortest way from ``parent`` over ``word``, cloned if need be."""
        if self.length[child] == self.length[parent] + 1:
            return child
        clone = self._state(self.length[parent] + 1, dict(self.next[child]), self.link[child])
        self.link[child] = clone
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = clone
            parent = self.link[parent]
        return clone

    def add(self, words: list[str]) -> None:
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
                continue
            state, parent = self._state(self.length[last] + 1, {}, 0), last
            while parent >= 0 and word not in self.next[parent]:
                self.next[parent][word] = state
                parent = self.link[parent]
            if parent >= 0:
                self.link[state] = self._split(parent, word, self.next[parent][word])
            last = state

    def matching(self, words: list[str]) -> list[int]:
        """For each position, the length of the longest known sequence that ends there."""
        state, size, found = 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            found.append(size)
        return found


def anchors(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(hash, position, start): of each window, its anchor's hash and word, and its first word.

    Windows lie within one document, in order. Of equal hashes the first one is the anchor.
    """
    h = words.hashes()
    last = len(h) - window + 1
    if last < 1:
        none = np.zeros(0, np.int64)
        return none, none, none
    grams = np.zeros(len(h) - anchor + 1, np.uint64)
    for k in range(anchor):
        grams = grams * _MULTIPLY + h[k : k + len(grams)]
    grams ^= grams >> np.uint64(29)
    grams *= _MIX
    grams ^= grams >> np.uint64(32)
    least, at = grams[:last].copy(), np.arange(last)
    for k in range(1, window - anchor + 1):
        other = grams[k : k + last]
        less = other < least
        least[less] = other[less]
        at[less] = np.flatnonzero(less) + k
    owner = words.owner
    start = np.flatnonzero(owner[:last] == owner[window - 1 :])
    return least[start].view(np.int64), at[start], start


def _runs(at: np.ndarray) -> np.ndarray:
    """First index of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, int)


class Columns:
    """Names for working columns that a table does not use itself."""

    def __init__(self, taken: list[str]) -> None:
        made: list[str] = []
        for wish in ("doc_key", "whole_text", "told", "repeated", "hot", "first_at", "first_n", "kept_words"):
            made.append(free_name([*taken, *made], wish))
        self.id, self.text, self.told, self.repeated, self.hot, self.at, self.n, self.kept = made
        self.key = [self.id, self.told]

    def marked(self, docs: DataFrame, doc_id: str, text: str, keep: list[str]) -> DataFrame:
        """The columns ``keep``, the id, the text and a hash that tells rows of one id apart."""
        told = F.xxhash64(docs[text]).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
        return docs.select(
            *(docs[c] for c in keep), docs[doc_id].alias(self.id), told.alias(self.told), docs[text].alias(self.text)
        )


def _anchor_rows(marked: DataFrame, c: Columns, window: int, anchor: int) -> DataFrame:
    """(route, h, id, told, times): one row per anchor and document.

    ``times`` is how often the slice has seen the anchor. Of an anchor seen twice one row is dealt
    by the anchor, for the other slices; the rest are known to repeat and dealt out evenly.
    """
    id_type = marked.schema[c.id].dataType
    schema = T.StructType(
        [
            T.StructField("route", T.LongType()),
            T.StructField("h", T.LongType()),
            T.StructField(c.id, id_type),
            T.StructField(c.told, T.IntegerType()),
            T.StructField("times", T.LongType()),
        ]
    )

    def work(batch: pa.RecordBatch) -> dict:
        words = split_words(plain(batch[c.text]), SPACED)
        h, at, start = anchors(words, window, anchor)
        run = _runs(at)
        h, owner = h[run], words.owner[start[run]]
        # One row per anchor and document; the count is over all places.
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        times = np.bincount(group)[group] if len(h) else group
        one = new | np.concatenate([[True], owner[1:] != owner[:-1]]) if len(h) else new
        route = np.where(new, h, h * 31 + owner * 0x9E3779B1 + 1)
        return {
            "route": route[one],
            "h": h[one],
            c.id: batch[c.id].take(pa.array(owner[one])),
            c.told: batch[c.told].take(pa.array(owner[one])),
            "times": times[one],
        }

    return map_slices(marked.select(c.id, c.told, c.text), c.text, work, schema)


def _repeated(rows: DataFrame, c: Columns, hot: int) -> DataFrame:
    """(h, id, told, total) of anchors that repeat; a row with a total marks an anchor as hot.

    The rows of an anchor lie side by side, so a pass over a sorted partition tells which repeat;
    it remembers one row.
    """
    schema = T.StructType([*rows.schema.fields[1:4], T.StructField("total", T.LongType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        before, seen = False, 0
        for batch in _with_end(batches):
            if batch is None:
                if held is None:
                    return
                batch, last = held, True
            else:
                last = False
                if held is not None:
                    batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            if not n:
                continue
            route, h, times = (np.asarray(batch[k]) for k in ("route", "h", "times"))
            same = (route[1:] == route[:-1]) & (h[1:] == h[:-1])
            previous = np.concatenate([[before], same])
            repeated = previous | np.concatenate([same, [False]]) | (times > 1)
            # Occurrences so far of each row's anchor, dealt by the anchor itself.
            group = np.cumsum(np.concatenate([[0], (~same).astype(int)]))
            totals = np.bincount(group, weights=times).astype(np.int64)
            totals[0] += seen if before else 0
            ends = np.concatenate([~same, [True]])
            by_anchor = route == h
            out = n if last else n - 1
            pick = np.flatnonzero(repeated[:out])
            if len(pick):
                taken = batch.take(pa.array(pick))
                yield pa.RecordBatch.from_arrays(
                    [taken[k] for k in names[:3]] + [pa.nulls(len(pick), pa.int64())], names=names
                )
            marks = np.flatnonzero((ends & by_anchor)[:out] & (totals[group] > hot)[:out])
            if len(marks):
                taken = batch.take(pa.array(marks))
                yield pa.RecordBatch.from_arrays(
                    [
                        taken["h"],
                        pa.nulls(len(marks), taken[names[1]].type),
                        pa.nulls(len(marks), taken[names[2]].type),
                        pa.array(totals[group[marks]]),
                    ],
                    names=names,
                )
            if last:
                return
            held = batch.slice(n - 1, 1)
            before = bool(previous[-1])
            seen = int(totals[-1] - times[-1])

    return rows.repartition("route").sortWithinPartitions("route", "h").mapInArrow(run, schema)


def _with_end(items: Iterator) -> Iterator:
    yield from items
    yield None


def _candidates(starts: np.ndarray, h: np.ndarray, owner: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Which windows have an anchor in the list of their document."""
    hit = np.zeros(len(h), bool)
    edges = np.searchsorted(owner, np.arange(len(starts)))
    for d, known in enumerate(lists):
        if len(known):
            hit[edges[d] : edges[d + 1]] = np.isin(h[edges[d] : edges[d + 1]], known)
    return hit


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values, dtype=np.int64) if x.is_valid else np.zeros(0, np.int64) for x in column]


def _stretches(docs: DataFrame, c: Columns, window: int, anchor: int) -> DataFrame:
    """(route, id, told, start, stretch): the words around each repeated anchor of a document.

    Equal stretches of a slice are sent once, as the earliest one.
    """
    schema = T.StructType(
        [
            T.StructField("route", T.LongType()),
            docs.schema[c.id],
            T.StructField(c.told, T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("stretch", T.StringType()),
        ]
    )

    def work(batch: pa.RecordBatch) -> dict:
        words = split_words(plain(batch[c.text]), SPACED)
        h, at, start = anchors(words, window, anchor)
        owner = words.owner[start] if len(start) else start
        hot = _candidates(words.starts, h, owner, _lists(batch[c.hot]))
        hit = hot | _candidates(words.starts, h, owner, _lists(batch[c.repeated]))
        # Stretches: windows of one anchor; of a hot one, each window by itself.
        edge = np.concatenate([[True], (at[1:] != at[:-1]) | hot[1:]]) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(edge)
        last = np.concatenate([first[1:], [len(at)]]) - 1 if len(first) else first
        mine = hit[first] if len(first) else np.zeros(0, bool)
        first, last = first[mine], last[mine]
        distinct = words.distinct.to_pylist()
        codes = words.codes.tolist()
        ids, told = batch[c.id].to_pylist(), batch[c.told].to_pylist()
        best: dict[tuple, tuple] = {}
        for a, b, own, key, split in zip(
            start[first].tolist(), start[last].tolist(), owner[first].tolist(), h[first].tolist(), hot[first].tolist(), strict=True
        ):
            stretch = " ".join([distinct[i] for i in codes[a : b + window]])
            route = xxhash.xxh64_intdigest(stretch) - (1 << 63) if split else key
            place = (ids[own] is not None, ids[own], told[own], a - int(words.starts[own]))
            kept = best.get((route, stretch))
            if kept is None or place < kept:
                best[route, stretch] = place
        places = list(best.values())
        return {
            "route": [k[0] for k in best],
            c.id: pa.array([p[1] for p in places], batch[c.id].type),
            c.told: [p[2] for p in places],
            "start": [p[3] for p in places],
            "stretch": [k[1] for k in best],
        }

    return map_slices(docs, c.text, work, schema)


def new_windows(stretches: Iterator[tuple], window: int) -> Iterator[tuple]:
    """(*place, offset, count) of the windows that no earlier stretch of the shard has.

    ``stretches``: (shard, place, text), by shard and place. The automaton is built when a second,
    different stretch arrives: that of a single one accepts itself and nothing else.
    """
    shard: object = object()
    automaton: SuffixAutomaton | None = None
    waiting: list[str] | None = None
    seen: set[str] = set()
    for key, place, text in stretches:
        if key != shard:
            shard, automaton, waiting, seen = key, None, None, set()
        if text in seen:
            continue
        seen.add(text)
        words = text.split(" ")
        if waiting is None and automaton is None:
            waiting = words
            yield (*place, 0, len(words) - window + 1)
            continue
        if automaton is None:
            automaton = SuffixAutomaton()
            automaton.add(waiting)
        sizes = automaton.matching(words)
        automaton.add(words)
        run = None
        for i in range(len(words) - window + 1):
            if sizes[i + window - 1] < window:
                run = i if run is None else run
            elif run is not None:
                yield (*place, run, i - run)
                run = None
        if run is not None:
            yield (*place, run, len(words) - window + 1 - run)


def _firsts(stretches: DataFrame, c: Columns, window: int) -> DataFrame:
    """(id, told, first_at, first_n): runs of windows that are the first of their kind."""
    schema = T.StructType(
        [
            stretches.schema[c.id],
            T.StructField(c.told, T.IntegerType()),
            T.StructField("at", T.IntegerType()),
            T.StructField("n", T.IntegerType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch[c.id].type
                for route, doc, told, start, text in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                    yield route, (doc, told, start), text

        made: list[tuple] = []

        def flush() -> pa.RecordBatch:
            doc, told, start, offset, n = zip(*made, strict=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, kind),
                    pa.array(told, pa.int32()),
                    pa.array(np.add(start, offset), pa.int32()),
                    pa.array(n, pa.int32()),
                ],
                names=[f.name for f in schema],
            )

        for found in new_windows(rows(), window):
            made.append(found)
            if len(made) == 20_000:
                yield flush()
                made.clear()
        if made:
            yield flush()

    ordered = stretches.repartition("route").sortWithinPartitions("route", *c.key, "start")
    return ordered.mapInArrow(run, schema)


def deduplicate(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: list[str] | None = None,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    hot: int = HOT,
) -> tuple[DataFrame, str]:
    """The columns ``keep`` and a struct (n_words, n_removed, kept, kept_sha256); its name.

    ``kept`` is the text if nothing goes, else the kept words with one space between.
    """
    keep = docs.columns if keep is None else keep
    c = Columns(docs.columns)
    marked = c.marked(docs, doc_id, text, keep)
    found = stage(_repeated(_anchor_rows(marked, c, window, anchor), c, hot), "anchors", hot=F.count("total"))
    rows = found.df.where("total IS NULL").drop("total")
    if found.metrics["hot"]:
        busy = stage(found.df.where("total IS NOT NULL").select("h", F.lit(True).alias("hot")), "hot").df
        rows = rows.join(busy, "h", "left")
    else:
        rows = rows.withColumn("hot", F.lit(None).cast("boolean"))
    # A document's anchors are bounded by its length.
    lists = rows.groupBy(*c.key).agg(
        F.collect_list(F.when(F.col("hot").isNull(), F.col("h"))).alias(c.repeated),
        F.collect_list(F.when(F.col("hot"), F.col("h"))).alias(c.hot),
    )
    # Both uses of the documents below are shuffled alike, so Spark shuffles the text once.
    joined = _by_key(marked, lists, c)
    stretches = _stretches(joined.where(F.col(c.repeated).isNotNull()), c, window, anchor)
    firsts = _firsts(stretches, c, window).groupBy(*c.key).agg(
        F.collect_list("at").alias(c.at), F.collect_list("n").alias(c.n)
    )
    return _removed(_by_key(joined, firsts, c), c, keep, window, anchor), c.kept


def _by_key(left: DataFrame, right: DataFrame, c: Columns) -> DataFrame:
    """Left join on the id (null equals null) and the text's hash."""
    other = right.select(*(F.col(k).alias(f"{k}#") for k in c.key), *(x for x in right.columns if x not in c.key))
    same = left[c.id].eqNullSafe(other[f"{c.id}#"]) & (left[c.told] == other[f"{c.told}#"])
    return left.join(other, same, "left").drop(f"{c.id}#", f"{c.told}#")


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


def _removed(docs: DataFrame, c: Columns, keep: list[str], window: int, anchor: int) -> DataFrame:
    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField(c.kept, RESULT)])

    def work(batch: pa.RecordBatch) -> dict:
        texts = plain(batch[c.text])
        words = split_words(texts, SPACED)
        h, _, start = anchors(words, window, anchor)
        owner = words.owner[start] if len(start) else start
        again = _candidates(words.starts, h, owner, _lists(batch[c.repeated]))
        again |= _candidates(words.starts, h, owner, _lists(batch[c.hot]))
        dup = np.zeros(len(words.codes) + 1, np.int64)
        dup[start[again]] = 1
        for d, (at, n) in enumerate(zip(_lists(batch[c.at]), _lists(batch[c.n]), strict=True)):
            for a, m in zip((at + words.starts[d]).tolist(), n.tolist(), strict=True):
                dup[a : a + m] = 0
        # A word is covered by the windows that start at it or up to ``window - 1`` words before.
        total = np.concatenate([[0], np.cumsum(dup)])
        place = np.arange(len(words.codes))
        gone = total[place + 1] > total[np.maximum(place - window + 1, 0)]
        kept, digests, removed = [], [], []
        for d, value in enumerate(texts):
            raw = value.as_py()
            parts = raw.encode().split()
            mine = gone[words.starts[d] : words.starts[d + 1]]
            lost = int(mine.sum())
            if lost:
                parts = [p for p, g in zip(parts, mine.tolist(), strict=True) if not g]
            joined = b" ".join(parts)
            kept.append(joined.decode() if lost else raw)
            removed.append(lost)
            digests.append(hashlib.sha256(joined).hexdigest())
        made = [pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept), pa.array(digests)]
        return {**{k: batch[k] for k in keep}, c.kept: pa.StructArray.from_arrays(made, [f.name for f in RESULT])}

    used = docs.select(*dict.fromkeys([*keep, c.text, c.repeated, c.hot, c.at, c.n]))
    return map_slices(used, c.text, work, schema)


def drop_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents without their repeated passages, with the columns they came with."""
    made, name = deduplicate(docs, text, doc_id)
    return made.select(*(F.col(name)["kept"].alias(x) if x == text else made[x] for x in docs.columns))
