"""Language-model scores from a class-based bigram model (Brown et al., 1992).

The probability of a word is that of its class after the class of the word before it, times that of
the word within its class. Each text ends with an end mark, which is a class of its own and also
stands before the first word. Both parts are smoothed by adding a constant.

Classes. Every training word has one of ``CLASSES`` classes. The ``CLUSTERED`` most frequent words get
theirs by exchange clustering: each word in turn moves to the class that raises the likelihood of all
class bigrams most. It works on the bigram counts of these words over all training texts, a table
with no more than (``CLUSTERED`` + 2)^2 cells however large the corpus is; all other words are one
symbol of it. Then each other word is grouped in Spark with the classes that stand before and after
it, and goes to the class of the best gain, by the same formula, in one round over the class table of
the head. The class bigrams are counted again over all words with their classes. A word that is in no
training text has no counts to go by: these words are one further class.

Counts and classes are of all words of all training texts and stay in Spark. The ``TOP`` most frequent
words, of at most ``WORD_BYTES`` bytes each, are told to all tasks; pairs with a word that is not among
them are joined with the table of words. That changes the work and not the result.

Cases: a null or empty text is its end mark; without training texts all words are unknown; repeated
rows are counted and scored each; an empty table gives an empty table; names of further columns are
free.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartograph.llm.words import SPACED_FOLDED, Words, map_slices, plain, slices, split_words
from cartograph.session import Staged, stage

CLUSTERED = 2048
CLASSES = 64
#: The class of the end mark, that of words without one, and how many there are.
END_CLASS, OTHER, TOTAL = CLASSES, CLASSES + 1, CLASSES + 2
SWEEPS = 3
TOP = 1 << 17
WORD_BYTES = 64
#: Added to each count of a class bigram, and of a word in its class.
ADD_BIGRAM, ADD_WORD = 0.1, 0.5
_BUFFER = 4 << 20
#: Words whose gains are computed at once.
_CHUNK = 2048


class Vocabulary(NamedTuple):
    """The most frequent words, in order of their count."""

    words: pa.Array
    counts: np.ndarray
    kind: np.ndarray

    def per_word(self, distinct: pa.Array, values: np.ndarray, other: int) -> np.ndarray:
        """The value of each word, or ``other``."""
        found = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=self.words), -1)).astype(np.int64)
        return np.append(values, other)[found]


def word_counts(docs: DataFrame) -> Staged:
    """(word, n): how often each word occurs; a null word is the end mark."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def work(batch: pa.RecordBatch) -> dict:
        words = split_words(plain(batch["text"]), SPACED_FOLDED)
        times = np.bincount(words.codes, minlength=len(words.distinct))
        return {
            "word": pa.concat_arrays([words.distinct, pa.nulls(1, pa.string())]),
            "n": np.append(times, batch.num_rows),
        }

    counted = map_slices(docs, "text", work, schema).groupBy("word").agg(F.sum("n").alias("n"))
    return stage(counted, "word-counts", tokens=F.sum("n"))


def vocabulary(counts: DataFrame, first: int) -> Vocabulary:
    rows = (
        counts.where(F.octet_length("word") <= WORD_BYTES)
        .orderBy(F.desc("n"), "word")
        .limit(first)
        .toArrow()
        .combine_chunks()
    )
    kind = rows["kind"].to_numpy() if "kind" in rows.column_names else np.arange(len(rows))
    return Vocabulary(plain(rows["word"]), rows["n"].to_numpy().astype(np.int64), kind.astype(np.int64))


def _sequence(per_word: np.ndarray, words: Words, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, now) of all tokens: the symbol before each word and each end mark, and its own."""
    n = len(words.starts) - 1
    now = np.insert(per_word[words.codes], words.starts[1:], end)
    before = np.concatenate([[end], now[:-1]])[: len(now)]
    assert len(now) == len(words.codes) + n
    return before, now


def bigram_counts(docs: DataFrame, head: Vocabulary) -> DataFrame:
    """(a, b, n) over all neighbouring symbols; tasks add up what they have seen before they send."""
    shared = docs.sparkSession.sparkContext.broadcast(head)
    schema = "a int, b int, n long"
    end, other, n_symbols = CLUSTERED, CLUSTERED + 1, CLUSTERED + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            columns = [pa.array(x, t) for x, t in ((pairs // n_symbols, pa.int32()), (pairs % n_symbols, pa.int32()), (n, pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(plain(part["text"]), SPACED_FOLDED)
                symbol = shared.value.per_word(words.distinct, shared.value.kind, other)
                before, now = _sequence(symbol, words, end)
                held.append((before * n_symbols + now).astype(np.int32))
                size += len(now)
                if size >= _BUFFER:
                    size = 0
                    yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, schema).groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, clustered: int, sweeps: int = SWEEPS, classes: int = CLASSES) -> np.ndarray:
    """The class of every symbol, from the matrix of their bigram counts.

    The first ``clustered`` symbols move among ``classes`` classes; the others keep a class each.
    Starts from the order of frequency, dealt round. The gain of a move is the change of the sum of
    N log N over class bigrams less that over classes.
    """
    n = len(bigrams)
    kind = np.concatenate([np.arange(clustered) % classes, classes + np.arange(n - clustered)])
    total = classes + n - clustered
    one = np.zeros((n, total))
    one[np.arange(n), kind] = 1
    table = one.T @ bigrams @ one
    for _ in range(sweeps):
        moved = 0
        for w in range(clustered):
            old = kind[w]
            right = np.bincount(kind, bigrams[w], total)
            left = np.bincount(kind, bigrams[:, w], total)
            own = bigrams[w, w]
            if right.sum() + left.sum() == 0:
                continue
            # Take the word out of its class.
            right[old] -= own
            left[old] -= own
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= own
            rows, columns = table[:classes], table[:, :classes].T
            gain = (_xlogx(rows + right) - _xlogx(rows)).sum(1) + (_xlogx(columns + left) - _xlogx(columns)).sum(1)
            # The cell of a class with itself gets both parts and the word's own pairs.
            cell = np.diagonal(table)[:classes]
            gain -= _xlogx(cell + right[:classes]) + _xlogx(cell + left[:classes]) - _xlogx(cell)
            gain += _xlogx(cell + right[:classes] + left[:classes] + own)
            for sums, mine in ((rows.sum(1), right.sum() + own), (columns.sum(1), left.sum() + own)):
                gain -= _xlogx(sums + mine) - _xlogx(sums)
            new = int(gain.argmax())
            moved += new != old
            kind[w] = new
            table[new] += right
            table[:, new] += left
            table[new, new] += own
        if not moved:
            break
    return kind


def contexts(docs: DataFrame, head: Vocabulary) -> DataFrame:
    """(word, codes, times) of every word beyond the head: the classes before it (``OTHER`` for words
    beyond the head), and after it plus ``TOTAL``, with how often they are there.

    A word has one row for each slice of text with it; its rows stand one behind the other in one
    partition, so they are summed as they pass and no list grows with the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(head)
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [T.StructField("word", T.StringType()), T.StructField("codes", numbers), T.StructField("times", numbers)]
    )

    def work(batch: pa.RecordBatch) -> dict:
        words = split_words(plain(batch["text"]), SPACED_FOLDED)
        kind = shared.value.per_word(words.distinct, shared.value.kind, OTHER)
        before, now = _sequence(kind, words, END_CLASS)
        at = np.arange(len(words.codes)) + words.owner
        mine = np.flatnonzero(kind[words.codes] == OTHER)
        code, at = words.codes[mine] * (2 * TOTAL), at[mine]
        pairs, times = np.unique(np.concatenate([code + before[at], code + TOTAL + now[at + 1]]), return_counts=True)
        own, first = np.unique(pairs // (2 * TOTAL), return_index=True)
        offsets = pa.array(np.append(first, len(pairs)), pa.int32())
        return {
            "word": words.distinct.take(pa.array(own)),
            "codes": pa.ListArray.from_arrays(offsets, pa.array(pairs % (2 * TOTAL), pa.int32())),
            "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
        }

    return map_slices(docs.select("text"), "text", work, schema).repartition("word").sortWithinPartitions("word")


def gains(table: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What words without a class would gain in each class, a row for each word; ``left`` and ``right``
    are their counts of the classes before and after, ``table`` that of the class bigrams."""
    total = np.zeros((len(left), CLASSES))
    for counts, cells in ((right, table[:CLASSES].T), (left, table[:, :CLASSES])):
        word, context = np.nonzero(counts)
        more = _xlogx(cells[context] + counts[word, context][:, None]) - _xlogx(cells)[context]
        own, first = np.unique(word, return_index=True)
        total[own] += np.add.reduceat(more, first) if len(first) else 0
    # The cell of a class with itself gets both parts.
    word, kind = np.nonzero((left[:, :CLASSES] > 0) & (right[:, :CLASSES] > 0))
    cell, a, b = np.diagonal(table)[kind], left[word, kind], right[word, kind]
    total[word, kind] += _xlogx(cell + a + b) + _xlogx(cell) - _xlogx(cell + a) - _xlogx(cell + b)
    for sums, mine in ((table.sum(1), right.sum(1)), (table.sum(0), left.sum(1))):
        total -= _xlogx(sums[None, :CLASSES] + mine[:, None]) - _xlogx(sums[:CLASSES])
    return total


def assign(found: DataFrame, table: np.ndarray) -> DataFrame:
    """(word, n, kind): the class of best gain of every word of :func:`contexts`."""
    shared = found.sparkSession.sparkContext.broadcast(table)

    def judged(words: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        kind = gains(shared.value, counts[:, 0], counts[:, 1]).argmax(1)
        n = counts[:, 1].sum(1).astype(np.int64)
        return pa.RecordBatch.from_arrays([words, pa.array(n), pa.array(kind, pa.int32())], names=["word", "n", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last word may go on in the next rows.
        word, sums = None, None
        for whole in batches:
            for start in range(0, whole.num_rows, _CHUNK):
                batch = whole.slice(start, _CHUNK)
                coded = batch["word"].dictionary_encode()
                words = coded.dictionary
                owner = np.repeat(np.asarray(coded.indices), np.asarray(pc.list_value_length(batch["codes"])))
                codes, times = (np.asarray(batch[c].flatten()) for c in ("codes", "times"))
                size = len(words) * 2 * TOTAL
                counts = np.bincount(owner.astype(np.int64) * (2 * TOTAL) + codes, times, size).reshape(-1, 2, TOTAL)
                if sums is not None:
                    if words[0].as_py() == word:
                        counts[0] += sums
                    else:
                        yield judged(pa.array([word]), sums[None])
                word, sums = words[-1].as_py(), counts[-1].copy()
                if len(words) > 1:
                    yield judged(words[:-1], counts[:-1])
        if sums is not None:
            yield judged(pa.array([word]), sums[None])

    return found.mapInArrow(run, "word string, n long, kind int")


PAIR = T.StructType(
    [
        T.StructField("w1", T.StringType()),
        T.StructField("w2", T.StringType()),
        T.StructField("a", T.IntegerType()),
        T.StructField("b", T.IntegerType()),
        T.StructField("times", T.LongType()),
    ]
)


def _pairs(words: Words, kind: np.ndarray, by_text: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """All neighbours by class; ``kind`` is that of each distinct word, -1 for those not told.

    The text, and the two classes, of the pairs without such words; the texts, and the columns of
    ``PAIR``, of the others, each with its words (and classes where they are known) once for each
    text, or once at all.
    """
    n, many = len(words.starts) - 1, len(words.distinct)
    # Classes come first, then the words that are not told.
    symbol = np.where(kind < 0, TOTAL + np.arange(many), kind)
    before, now = _sequence(symbol, words, END_CLASS)
    owner = np.insert(words.owner, words.starts[1:], np.arange(n))
    near = (before < TOTAL) & (now < TOTAL)
    far = np.flatnonzero(~near)
    width = TOTAL + many
    key = before[far] * width + now[far]
    order = np.lexsort((key, owner[far])) if by_text else np.argsort(key, kind="stable")
    key, of = key[order], owner[far][order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | ((of[1:] != of[:-1]) if by_text else False)
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(key)))
    columns = {}
    for name, x in (("1", key[first] // width), ("2", key[first] % width)):
        told = x < TOTAL
        columns["w" + name] = words.distinct.take(pa.array(np.where(told, 0, x - TOTAL), mask=told))
        columns["ab"[int(name) - 1]] = pa.array(np.where(told, x, 0).astype(np.int32), mask=~told)
    columns = {c: columns[c] for c in ("w1", "w2", "a", "b")} | {"times": pa.array(times, pa.int64())}
    return owner[near], np.stack([before[near], now[near]]), of[first], columns


def with_classes(pairs: DataFrame, words: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, times, a, b and n (of the first word if it is not told, else null) of the pairs."""
    known = words.select(F.col("word").alias("w"), F.col("n"), F.col("kind"))
    none = F.lit(None).cast("long")
    kind, n = F.coalesce("kind", F.lit(OTHER)), F.coalesce("n", F.lit(0).cast("long"))
    first = pairs.where("w1 IS NOT NULL").join(known, F.col("w1") == F.col("w"), "left")
    first = first.select(*keep, "times", kind.alias("a"), "w2", "b", n.alias("n1"))
    both = first.where("w2 IS NOT NULL").join(known, F.col("w2") == F.col("w"), "left")
    second = pairs.where("w1 IS NULL").join(known, F.col("w2") == F.col("w"), "left")
    return (
        first.where("w2 IS NULL").select(*keep, "times", "a", "b", F.col("n1").alias("n"))
        .unionByName(both.select(*keep, "times", "a", kind.alias("b"), F.col("n1").alias("n")))
        .unionByName(second.select(*keep, "times", "a", kind.alias("b"), none.alias("n")))
    )


def class_bigrams(docs: DataFrame, known: Vocabulary, words: DataFrame) -> np.ndarray:
    """Counts of all neighbouring classes, with the class of every word."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(TOTAL * TOTAL, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                split = split_words(plain(part["text"]), SPACED_FOLDED)
                kind = shared.value.per_word(split.distinct, shared.value.kind, -1)
                _, (before, now), _, columns = _pairs(split, kind, False)
                table += np.bincount(before * TOTAL + now, minlength=len(table))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        at = np.flatnonzero(table)
        empty = pa.nulls(len(at), pa.string())
        classes = [pa.array(x.astype(np.int32)) for x in (at // TOTAL, at % TOTAL)]
        yield pa.RecordBatch.from_arrays([empty, empty, *classes, pa.array(table[at])], names=PAIR.names)

    pairs = stage(docs.select("text").mapInArrow(run, PAIR), "class-pairs").df
    told = F.col("w1").isNull() & F.col("w2").isNull()
    rows = (
        pairs.where(told).select("a", "b", "times")
        .unionByName(with_classes(pairs.where(~told), words, []).select("a", "b", "times"))
        .groupBy("a", "b").agg(F.sum("times").alias("n")).toArrow()
    )
    table = np.zeros((TOTAL, TOTAL))
    table[rows["a"].to_numpy(), rows["b"].to_numpy()] = rows["n"].to_numpy()
    return table


class Model(NamedTuple):
    """What a task needs to score a text, but for the words that are not in ``known``."""

    known: Vocabulary
    transition: np.ndarray
    word_score: np.ndarray
    #: The sum of a class and what is added to it.
    below: np.ndarray
    tokens: int
    base_total: int
    ends: int


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts, and the staged table (word, n, kind) of all their words."""
    counts = word_counts(docs)
    tokens, distinct = counts.metrics["tokens"] or 0, counts.rows
    head = vocabulary(counts.df.where("word IS NOT NULL"), CLUSTERED)
    size = CLUSTERED + 2
    matrix = np.zeros((size, size))
    if tokens:
        pairs = bigram_counts(docs, head).toArrow()
        matrix[pairs["a"].to_numpy(), pairs["b"].to_numpy()] = pairs["n"].to_numpy()
    # Without enough words the places up to ``CLUSTERED`` stay empty and never move.
    kind = exchange(matrix, CLUSTERED)
    one = np.zeros((size, TOTAL))
    one[np.arange(size), kind] = 1
    seeds = one.T @ matrix @ one
    del matrix, one
    head = head._replace(kind=kind[: len(head.words)])
    first = docs.sparkSession.createDataFrame(
        pa.table({"word": head.words, "n": head.counts, "kind": pa.array(head.kind, pa.int32())}),
        "word string, n long, kind int",
    )
    words = stage(assign(contexts(docs, head), seeds).unionByName(first), "word-classes").df
    known = vocabulary(words, TOP)
    table = class_bigrams(docs, known, words)
    transition = np.log10((table + ADD_BIGRAM) / (table.sum(1, keepdims=True) + ADD_BIGRAM * TOTAL))
    below = np.ones(TOTAL)
    for r in words.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        below[r["kind"]] = r["n"] + ADD_WORD * r["words"]
    ends = counts.df.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    score = np.log10((known.counts + ADD_WORD) / below[known.kind])
    return Model(known, transition, score, below, tokens, tokens + distinct + 1, ends), words


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """The columns given but the text, and the parts of the score that need no further counts.

    ``rest`` has the pairs with words that are not in the vocabulary. Each such word is the first of
    as many pairs as the text has it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema if f.name != "text"]
    schema = T.StructType(
        [
            *keep,
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("base", T.DoubleType()),
            T.StructField("part", T.DoubleType()),
            T.StructField("rest", T.ArrayType(PAIR)),
        ]
    )

    def work(batch: pa.RecordBatch) -> dict:
        m: Model = shared.value
        words = split_words(plain(batch["text"]), SPACED_FOLDED)
        owner, n = words.owner, batch.num_rows
        place = m.known.per_word(words.distinct, np.arange(len(m.known.words)), -1)
        base = np.append(np.log10((m.known.counts + 1) / m.base_total), 0.0)[place]
        own = np.append(m.word_score, 0.0)[place]
        near, (before, now), far, columns = _pairs(words, np.append(m.known.kind, -1)[place], True)
        steps = np.bincount(near, m.transition[before, now], n)
        end = np.log10((m.ends + 1) / m.base_total)

        def total(x: np.ndarray) -> np.ndarray:
            return np.bincount(owner, x[words.codes], n) if len(owner) else np.zeros(n)

        structs = pa.StructArray.from_arrays(list(columns.values()), list(columns))
        return {
            **{f.name: batch[f.name] for f in keep},
            "n_tokens": words.counts + 1,
            "n_known": total((place >= 0).astype(float)).astype(np.int64) + int(m.ends > 0),
            "base": total(base) + end,
            "part": total(own) + steps,
            "rest": pa.ListArray.from_arrays(pa.array(np.searchsorted(far, np.arange(n + 1)), pa.int32()), structs),
        }

    return map_slices(docs, "text", work, schema)


def score(docs: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity).

    The model learns from the rows where ``learn`` is true; all rows are scored.
    """
    named = docs.select(docs[doc_id].alias("doc_id"), (~learn).alias("held_out"), docs[text].alias("text"))
    model, words = fit(named.where(~F.col("held_out")).select("text"))
    # The row number is staged with the rows, so it stays the same if a task has to run again.
    scored = stage(
        score_texts(named.withColumn("row", F.monotonically_increasing_id()), model), "scored"
    ).df
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.*")
    steps = docs.sparkSession.createDataFrame(
        [(a, b, float(model.transition[a, b]), float(model.below[a])) for a in range(TOTAL) for b in range(TOTAL)],
        "a int, b int, step double, below double",
    )
    n = F.col("n")
    # Words of no training text are all there is in their class.
    own = F.when(F.col("a") == OTHER, 0.0).otherwise(F.log10((n + ADD_WORD) / F.col("below")))
    parts = (
        with_classes(rest, words, ["row"])
        .join(F.broadcast(steps), ["a", "b"])
        .groupBy("row")
        .agg(
            F.sum(F.when(n > 0, F.col("times"))).alias("more_known"),
            F.sum(F.when(n.isNotNull(), F.col("times") * F.log10((n + 1) / F.lit(model.base_total)))).alias("more_base"),
            F.sum(F.col("times") * (F.col("step") + F.when(n.isNotNull(), own).otherwise(0.0))).alias("more_part"),
        )
    )
    whole = F.col("part") + F.coalesce("more_part", F.lit(0.0))
    return scored.join(parts, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        whole.alias("score"),
        F.pow(F.lit(10.0), -whole / F.col("n_tokens")).alias("perplexity"),
    )
